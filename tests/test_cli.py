from newtonmill import cli
from newtonmill.sources import runs_log, svm


def test_generate_split_and_train(spark, tmp_path):
    data, parts, log = str(tmp_path / "data"), str(tmp_path / "parts"), tmp_path / "log.bin"
    assert cli.main(["generate", "-d", "4", "--samples", "203", "--seed", "5", "--out", data], spark) == cli.OK
    assert svm.read_text(spark, data).count() == 203
    assert cli.main(["split", "-train_dataset", data, "-clients", "4", "-out", parts], spark) == cli.OK
    sizes = spark.read.text(parts).groupBy("client_id").count().collect()
    assert [r["count"] for r in sizes] == [50] * 4
    args = ["train", "--train_dataset", data, "--clients", "4", "--lambda", "0.01", "--rounds", "6", "--option-b", "--compressor", "identical", "--add_intercept", "--check_split", "--reshuffle_train", "--out", str(log)]
    assert cli.main(args, spark) == cli.OK
    run, rounds = runs_log.decode(log.read_bytes())
    assert (run.n_clients, run.d, run.total_samples) == (4, 5, 200) and len(rounds) == 6
    assert rounds[-1][1] < 1e-6


def test_return_codes(spark, tmp_path):
    (tmp_path / "one").write_text("1 0:1\n1 0:2\n")
    (tmp_path / "two").write_text("1 0:1\n-1 0:2\n")
    (tmp_path / "torn").write_text("1 0:1\n-1 0:x\n")
    base = ["train", "--train_dataset", str(tmp_path / "two"), "--lambda", "1", "--rounds", "1", "--silent", "--k_compressor_as_d_mult", "1"]
    code = lambda *args: cli.main([*args], spark)
    assert code("version") == code(*base, "--option-a") == code(*base, "-option-b", "--x0_seed", "3", "--compute-L-smooth", "--debug", "meminfo;crc32fordata") == cli.OK == 0
    assert code("train", "--rounds", "1") == code(*base) == code(*base, "--option-a", "--iam", "who") == code(*base, "--option-a", "--tracking") == cli.MISSING_ARGUMENT == -1
    assert code("train", "--rounds", "x") == code(*base, "--option-a", "--compressor", "none") == code(*base, "--option-a", "--iam", "client:x") == code(*base, "--option-a", "--master", "nowhere") == cli.WRONG_ARGUMENT == -2
    assert code("train", "--train_dataset", str(tmp_path / "absent"), *base[3:], "--option-a") == cli.NO_DATASET == -3
    assert [code("train", "--train_dataset", str(tmp_path / f), *base[3:], "--option-a") for f in ("one", "torn")] == [cli.BAD_DATASET] * 2 == [-4] * 2
    assert code(*base, "--option-a", "--clients", "3") == cli.SPLIT_ERROR == -5
    assert code(*base, "--option-a", "--out", str(tmp_path / "no" / "folder" / "log")) == cli.NOT_SAVED == -6
    assert code(*base[:-1], "50", "--option-a") == cli.INTERNAL_ERROR == -7
    assert code(*base, "--option-a", "--debug", "meminfo,all") == cli.UNKNOWN_DEBUG_MODE == -8
    assert code(*base, "--option-a", "--iam", "c:3", "--master", "tcpv4:host:80") == cli.OK


def test_lines_are_dealt_in_file_order(spark, tmp_path):
    (tmp_path / "data").write_text("".join(f"{1 if k % 2 else -1} 1:{k + 1}\n" for k in range(101)))
    rows = cli.dealt(cli.read(spark, str(tmp_path / "data"), False, places=True), 4, False, 0).collect()
    assert sorted((r.sample_id, r.client_id, r.features) for r in rows if r.client_id is not None) == [(k, k // 25, [k + 1.0]) for k in range(100)]
    again = cli.dealt(cli.read(spark, str(tmp_path / "data"), False, places=True), 4, True, 7).collect()
    assert sorted(r.features for r in again) == sorted(r.features for r in rows) and [r.features for r in sorted(again, key=lambda r: r.sample_id)][:5] != [[k + 1.0] for k in range(5)]
