"""Command line: train, split, generate and plot-ready logs. One or two leading dashes are equal."""

import argparse
import re
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import partition
from .plans.compressors import Lcg
from .plans.training import TrainConfig, TrainResult, smoothness, train
from .scratch import save
from .sources import runs_log, svm, synthetic

#: Return codes.
OK, MISSING_ARGUMENT, WRONG_ARGUMENT, NO_DATASET, BAD_DATASET, SPLIT_ERROR, NOT_SAVED, INTERNAL_ERROR, UNKNOWN_DEBUG_MODE = range(0, -9, -1)
#: What the debug flag may ask for, between commas or semicolons.
DEBUG_MODES = ("notracingprint", "meminfo", "forcesequpdate", "crc32fordata", "printtrain")
ADDRESS = r"(?:(?:tcp|udp)v[46]:)?(?:\[[0-9A-Fa-f:]+\]|[^:\s]+):[0-9]{1,5}"


class Refused(Exception):
    """An end with a return code of its own."""

    def __init__(self, code: int, why: str) -> None:
        super().__init__(why)
        self.code = code


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Refused(MISSING_ARGUMENT if "required" in message or "expected" in message else WRONG_ARGUMENT, message)


def parser() -> argparse.ArgumentParser:
    top = Parser(prog="newtonmill")
    actions = top.add_subparsers(dest="action", required=True)
    t = actions.add_parser("train")
    t.add_argument("--train_dataset", required=True)
    t.add_argument("--client_train_dataset", action="append", help="one path for each client, instead of dealing train_dataset out")
    t.add_argument("--clients", type=int, default=1)
    t.add_argument("--reshuffle_train", action="store_true")
    t.add_argument("--reshuffle_train_seed", type=int, default=123)
    t.add_argument("--add_intercept", action="store_true")
    t.add_argument("--check_split", action="store_true")
    t.add_argument("--lambda", dest="lam", type=float, required=True)
    t.add_argument("--rounds", type=int, required=True)
    t.add_argument("--algorithm", choices=("gd", "newton"), default="newton")
    t.add_argument("--option-a", action="store_true")
    t.add_argument("--option-b", action="store_true")
    t.add_argument("--project", action="store_true")
    t.add_argument("--compressor", choices=("identical", "natural", "randk", "topk", "toplek", "seqk"), default="topk")
    t.add_argument("--k_compressor_as_d_mult", type=float, default=8.0)
    t.add_argument("--theoretical_alpha", action="store_true")
    t.add_argument("--use_theoretical_alpha_option_1", action="store_true")
    t.add_argument("--use_theoretical_alpha_option_2", action="store_true")
    t.add_argument("--alpha_step_size", type=float)
    t.add_argument("--line_search", action="store_true")
    t.add_argument("--c_line_search", type=float, default=0.5)
    t.add_argument("--gamma_line_search", type=float, default=0.5)
    t.add_argument("--max_line_search_steps", type=int, default=5)
    t.add_argument("--global_lr", type=float)
    t.add_argument("--global_step_size_multiplier", type=float, default=1.0)
    t.add_argument("--clients-per-round", type=int)
    t.add_argument("--transfer_indicies_for_randk", action="store_true")
    t.add_argument("--tracking", action="store_true")
    t.add_argument("--x0_seed", type=int, help="draws the first iterate from [0, 1]; without it training starts from 0")
    t.add_argument("--theoretical_global_lr", action="store_true")
    t.add_argument("--compute-L-smooth", action="store_true")
    t.add_argument("--selection_seed", type=int, default=1234)
    t.add_argument("--debug", default="", help=", ".join(DEBUG_MODES))
    t.add_argument("--workers", type=int, default=1, help="Spark decides on these three")
    t.add_argument("--server_grad_workers", type=int, default=0)
    t.add_argument("--server_hessian_workers", type=int, default=0)
    t.add_argument("--iam", default="master", help="server, master or m; client:i or c:i has nothing to run, as Spark's executors are the clients")
    t.add_argument("--master", help="host:port; checked, and not needed: Spark is the transport")
    t.add_argument("--out", default="")
    t.add_argument("--run_id", default="run")
    t.add_argument("--silent", action="store_true")
    s = actions.add_parser("split")
    s.add_argument("--train_dataset", required=True)
    s.add_argument("--clients", type=int, required=True)
    s.add_argument("--reshuffle_train", action="store_true")
    s.add_argument("--reshuffle_train_seed", type=int, default=123)
    s.add_argument("--add_intercept", action="store_true")
    s.add_argument("--out", required=True)
    s.add_argument("--show-stats", action="store_true")
    g = actions.add_parser("generate")
    g.add_argument("--d", type=int, required=True)
    g.add_argument("--samples", type=int, required=True)
    g.add_argument("--seed", type=int, default=123)
    g.add_argument("--rule", choices=tuple(synthetic.RULES), default="signed")
    g.add_argument("--classes", default="-1:0.5,1:0.5", help="label:share, the last takes the rest")
    g.add_argument("--out", required=True)
    actions.add_parser("version")
    return top


def two_dashes(argv: list[str]) -> list[str]:
    return [f"-{a}" if a[:1] == "-" and a[1:2].isalpha() else a for a in argv]


def dealt(df: DataFrame, clients: int, reshuffle: bool, seed: int) -> DataFrame:
    """Samples (place, label, features) with sample_id and client_id, in the order of their lines, or in a seeded order of what they hold."""
    order = partition.shuffled_order(F.xxhash64("label", "features"), seed) if reshuffle else F.col("place")
    df = partition.row_index(df, order, "place").drop("place")
    return partition.assign_clients(df, clients, df.count())


def checked(a: argparse.Namespace) -> list[str]:
    """The debug modes; refuses flags that contradict each other or that lack another."""
    modes = [m for m in re.split("[,;]", a.debug) if m]
    for m in modes:
        if m not in DEBUG_MODES:
            raise Refused(UNKNOWN_DEBUG_MODE, f"unknown debug mode {m}")
    if a.algorithm == "newton" and not (a.option_a or a.option_b):
        raise Refused(MISSING_ARGUMENT, "one of --option-a and --option-b is needed")
    if a.iam not in ("server", "master", "m") and not re.fullmatch(r"(?:client|c|host):[0-9]+", a.iam):
        raise Refused(WRONG_ARGUMENT if re.match("(?:client|c|host):", a.iam) else MISSING_ARGUMENT, f"--iam is master or client:number, not {a.iam}")
    if a.master is not None and not re.fullmatch(ADDRESS, a.master):
        raise Refused(WRONG_ARGUMENT, f"{a.master} is no host:port")
    if a.tracking and not a.out:
        raise Refused(MISSING_ARGUMENT, "--tracking needs --out")
    if a.clients < 1 or a.rounds < 0 or a.clients_per_round is not None and not 0 < a.clients_per_round <= a.clients:
        raise Refused(WRONG_ARGUMENT, "clients, rounds or clients-per-round out of range")
    return modes


def read(spark: SparkSession, path: str, intercept: bool, places: bool = False) -> DataFrame:
    try:
        return svm.read_dataset(spark, path, intercept, places=places)
    except AnalysisException as e:
        raise Refused(NO_DATASET, f"{path} cannot be read: {e.getCondition()}") from e
    except Exception as e:
        raise Refused(BAD_DATASET, f"{path}: {str(e).splitlines()[0]}") from e


def run_train(spark: SparkSession, a: argparse.Namespace) -> TrainResult:
    modes = checked(a)
    if a.client_train_dataset:
        parts = [read(spark, p, a.add_intercept).withColumn("client_id", F.lit(k)) for k, p in enumerate(a.client_train_dataset)]
        samples = parts[0]
        for p in parts[1:]:
            samples = samples.unionByName(p)
    else:
        samples = save(dealt(read(spark, a.train_dataset, a.add_intercept, places=True), a.clients, a.reshuffle_train, a.reshuffle_train_seed))
        if a.check_split:
            n = samples.count()
            if not partition.check_split(samples.select("sample_id"), samples.where("client_id is not null"), n - n // a.clients * a.clients).first().ok:
                raise Refused(SPLIT_ERROR, "the split is not consistent")
        if samples.where("client_id is not null").isEmpty():
            raise Refused(SPLIT_ERROR, "there are fewer samples than clients")
        samples = samples.where("client_id is not null")
    if "crc32fordata" in modes:
        print("crc32 of the data:", samples.agg(F.sum(F.crc32(F.to_json(F.struct("label", "features")).cast("binary")))).first()[0])
    if "printtrain" in modes:
        samples.show(samples.count(), truncate=False)
    folded = samples.select("client_id", F.transform("features", lambda v: v * F.col("label")).alias("features"))
    folded = save(folded)
    if a.compute_L_smooth and not a.silent:
        print("L smooth:", smoothness(folded, a.lam))
    first = folded.select(F.size("features").alias("d")).first()
    draws = Lcg(a.x0_seed) if a.x0_seed is not None else None
    config = TrainConfig(
        rounds=a.rounds, lam=a.lam, algorithm=a.algorithm, option="a" if a.option_a else "b", project=a.project, compressor=a.compressor, k_mult=a.k_compressor_as_d_mult,
        alpha=None if a.theoretical_alpha else a.alpha_step_size, alpha_option=1 if a.use_theoretical_alpha_option_1 else 2, line_search=a.line_search, c=a.c_line_search, gamma=a.gamma_line_search,
        max_line_search_steps=a.max_line_search_steps, global_lr=None if a.theoretical_global_lr else a.global_lr, selection_seed=a.selection_seed, x0=None if draws is None else [draws.unit() for _ in range(first.d)], step_multiplier=a.global_step_size_multiplier, clients_per_round=a.clients_per_round, send_indices=a.transfer_indicies_for_randk,
    )
    result = train(folded, config)
    if a.out:
        n = folded.count()
        run = runs_log.Run(Path(a.train_dataset).name, a.algorithm, a.compressor, n // max(1, result.clients), n, a.rounds, result.clients, result.d, int(a.k_compressor_as_d_mult * result.d), a.k_compressor_as_d_mult, a.global_lr or 0.0, a.alpha_step_size or 0.0, a.lam)
        try:
            Path(runs_log.file_name(a.out, run, a.run_id)).write_bytes(runs_log.encode(run, result.log))
        except OSError as e:
            raise Refused(NOT_SAVED, str(e)) from e
    if "notracingprint" in modes:
        result.log.clear()
    return result


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(two_dashes(sys.argv[1:] if argv is None else argv))
        if a.action == "version":
            import pyspark

            print(f"newtonmill on Spark {pyspark.__version__}")
            return OK
        if a.action == "train":
            checked(a)
            if a.iam not in ("server", "master", "m"):
                print("clients are Spark's executors: start the master alone")
                return OK
        run(a, spark or SparkSession.builder.appName("newtonmill").getOrCreate())
    except SystemExit as e:
        return OK if e.code in (0, None) else WRONG_ARGUMENT
    except Refused as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code
    except Exception as e:  # the code says that the fault is not the caller's
        print(f"internal error: {e}", file=sys.stderr)
        return INTERNAL_ERROR
    return OK


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.action == "train":
        result = run_train(spark, a)
        for r in [] if a.silent else result.log:
            print(f"round {r[0]}: |g| {r[1]:.6e}, f {r[2]:.12g}")
    elif a.action == "split":
        samples = dealt(read(spark, a.train_dataset, a.add_intercept, places=True), a.clients, a.reshuffle_train, a.reshuffle_train_seed).where("client_id is not null")
        svm.write_text(samples, a.out, by_client=True)
        if a.show_stats:
            partition.class_balance(samples).orderBy("client_id").show(a.clients)
    else:
        try:
            classes = [(float(x), float(y)) for x, y in (c.split(":") for c in a.classes.split(","))]
        except ValueError as e:
            raise Refused(WRONG_ARGUMENT, f"{a.classes} is no list of label:share") from e
        svm.write_text(synthetic.uniform_classes(spark, a.samples, a.d, a.seed, classes, a.rule), a.out)


if __name__ == "__main__":
    sys.exit(main())
