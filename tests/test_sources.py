import zlib

import pytest
from pyspark.sql import functions as F

from newtonmill.functions import scalar as S
from newtonmill.sources import files, plots, runs_log, svm
from newtonmill.sources.synthetic import federated, uniform_classes


def test_text_round_trip(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("2 0:1.5 3:-2\r\n\n1\t1:1 2:4\n2\n")
    t = svm.read_dataset(spark, str(path), intercept=True)
    rows = sorted((r.label, r.features) for r in t.collect())
    assert rows == [(-1.0, [0.0, 1.0, 4.0, 0.0, 1.0]), (1.0, [0.0, 0.0, 0.0, 0.0, 1.0]), (1.0, [1.5, 0.0, 0.0, -2.0, 1.0])]
    svm.write_text(t, str(tmp_path / "out"))
    again = svm.read_dataset(spark, str(tmp_path / "out"), intercept=False)
    assert sorted((r.label, r.features) for r in again.collect()) == rows


def test_one_label_is_refused(spark, tmp_path):
    (tmp_path / "one.txt").write_text("1 1:2\n1 2:3\n")
    with pytest.raises(ValueError):
        svm.read_dataset(spark, str(tmp_path / "one.txt"))


def test_profile_of_nothing(spark):
    empty = svm.parse(spark.createDataFrame([], "line string"))
    r = svm.profile(empty).first()
    assert (r.samples, r.min_index, r.ok) == (0, None, False)


def test_log_round_trip(spark, tmp_path):
    run = runs_log.Run("d", "newton", "topk", 10, 50, 2, 5, 6, 12, 2.0, 0.1, 1.0, 1e-3)
    rounds = [(0, 1.0, 0.7, 0.0, 0.0, 0.0, 0.1), (1, 0.5, 0.6, 0.2, 160.0, 80.0, 0.2)]
    assert runs_log.decode(runs_log.encode(run, rounds)) == (run, rounds)
    (tmp_path / runs_log.file_name("{run_id}_{algorithm}_{kmultiplier}.bin", run, "r")).write_bytes(runs_log.encode(run, rounds))
    t = runs_log.read_rounds(spark, str(tmp_path))
    assert [(r["round"], r.bytes_indices, r.n_clients) for r in t.orderBy("round").collect()] == [(0, 0.0, 5), (1, 80.0, 5)]


def test_synthetic_is_the_same_however_it_is_dealt(spark):
    one = uniform_classes(spark, 101, 3, 9, [(0.0, 0.5), (1.0, 0.5)])
    rows = {r.sample_id: (r.label, r.features) for r in one.collect()}
    assert rows == {r.sample_id: (r.label, r.features) for r in one.repartition(5).collect()}
    assert sum(v[0] == 0.0 for v in rows.values()) == 50
    assert all(-1 <= x < 1 for v in rows.values() for x in v[1])
    a = federated(spark, 3, 4, 2, 1).orderBy("client_id", "features").collect()
    assert a == federated(spark, 3, 4, 2, 1).repartition(4).orderBy("client_id", "features").collect() and len(a) == 12


def test_digests_and_parsing(spark):
    t = spark.createDataFrame([("hello world!",), ("",), ("Wow!",)], "s string").select(S.crc32_open(F.col("s").cast("binary")).alias("c"))
    assert [r.c for r in t.collect()] == [0xFC4B3D92, 0xFFFFFFFF, 0xE7FD648A]
    assert zlib.crc32(b"Wow!") ^ 0xFFFFFFFF == 0xE7FD648A
    t = spark.createDataFrame([("+111",), ("--0",), ("-1+",), ("-123.456e+1",)], "s string")
    got = t.select(S.parse_int(F.col("s")).alias("i"), S.parse_double(F.col("s")).alias("d")).collect()
    assert [r.i for r in got] == [111, None, None, None] and [r.d for r in got] == [111.0, None, None, -1234.56]
    shown = spark.range(1).select(S.array_text(F.array(F.lit(1), F.lit(222), F.lit(3))).alias("s")).first().s
    assert shown == "[1,222,3]"


def test_files_of_a_store(spark, tmp_path):
    folder = f"file://{tmp_path}/a/b"
    assert not files.exists(spark, folder)
    files.make_folder(spark, folder)
    files.make_folder(spark, folder)
    files.write_text(spark, f"{folder}/x.txt", "é\n")
    files.write_text(spark, f"{folder}/x.txt", "two é\n")
    files.make_folder(spark, f"{folder}/c")
    assert [(r.name, r.is_folder, r.bytes) for r in files.listed(spark, folder).collect()] == [("c", True, 0), ("x.txt", False, 7)]
    assert files.read_text(spark, f"{folder}/x.txt") == "two é\n" and files.size(spark, folder) == 7
    assert files.remove(spark, folder) and not files.remove(spark, folder) and not files.exists(spark, folder)


def test_plots_of_logs(spark):
    import xml.etree.ElementTree as ET

    rows = [(k, 10.0**-k, run) for run in ("one", "<two>") for k in range(6)] + [(6, 0.0, "one"), (7, None, "one")]
    text = plots.plot(spark.createDataFrame(rows, "round int, gap double, run string"), "round", "gap", "run", "gap & round")
    lines = [e for e in ET.fromstring(text) if e.tag.endswith("polyline")]
    assert [len(e.get("points").split()) for e in lines] == [6, 6] and len({e.get("stroke") for e in lines}) == 2
    first = [tuple(map(float, p.split(","))) for p in lines[0].get("points").split()]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(first, first[1:]))
    ET.fromstring(plots.svg({}, "x", "y"))
    ET.fromstring(plots.svg({"flat": ([1.0, 1.0], [2.0, 2.0])}, "x", "y", log_x=True))


def test_bytes_of_several_runs(spark):
    rounds = spark.createDataFrame([(r, k, 8, 4) for r in ("a", "b") for k in range(3)], "run string, round int, scalars long, indices long")
    found = sorted(map(tuple, runs_log.cumulative_bytes(rounds, "run").collect()))
    assert found == [(r, k, 8 * (k + 1), 4 * (k + 1), 8 * k) for r in ("a", "b") for k in range(3)]


def test_class_counts_of_very_many_rows(spark):
    """The order of rows is worked out without overflow: the first rows of four thousand million."""
    t = uniform_classes(spark, 4_000_000_007, 1, 3, [(-1.0, 0.5), (1.0, 0.5)]).where("sample_id < 2000")
    n = t.where("label < 0").count()
    assert 0.4 < n / t.count() < 0.6
