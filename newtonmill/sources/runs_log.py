"""Results logs: a binary file of one run with a record for each round, as tables runs and rounds, and back."""

import struct
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Little-endian layouts of header numbers and of a round. Fixed values of the format.
HEADER, ROUND = struct.Struct("<6i4d"), struct.Struct("<i6d")
NUMBERS = ("samples_per_client", "total_samples", "rounds", "n_clients", "d", "k", "k_mult", "global_lr", "alpha", "lambda_")
FIELDS = ("round", "grad_norm", "f", "x_norm", "bytes_scalars", "bytes_indices", "seconds")


@dataclass
class Run:
    dataset: str
    algorithm: str
    compressor: str
    samples_per_client: int
    total_samples: int
    rounds: int
    n_clients: int
    d: int
    k: int
    k_mult: float
    global_lr: float
    alpha: float
    lambda_: float


def encode(run: Run, rounds: list[tuple]) -> bytes:
    names = b"".join(x.encode() + b"\0" for x in (run.dataset, run.algorithm, run.compressor))
    return names + HEADER.pack(*(asdict(run)[n] for n in NUMBERS)) + b"".join(ROUND.pack(*r) for r in rounds)


def decode(data: bytes) -> tuple[Run, list[tuple]]:
    names, at = [], 0
    for _ in range(3):
        end = data.index(b"\0", at)
        names.append(data[at:end].decode())
        at = end + 1
    run = Run(*names, *HEADER.unpack_from(data, at))
    at += HEADER.size
    return run, [ROUND.unpack_from(data, k) for k in range(at, len(data) - ROUND.size + 1, ROUND.size)]


def file_name(template: str, run: Run, run_id: str) -> str:
    """Fills {run_id}, {algorithm}, {dataset} and {kmultiplier}."""
    return template.replace("{run_id}", run_id).replace("{algorithm}", run.algorithm).replace("{dataset}", run.dataset).replace("{kmultiplier}", f"{run.k_mult:g}")


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """(path, dataset, algorithm, compressor, n_clients, d, k, round, ...): the rounds of all log files under path."""
    schema = "path string, dataset string, algorithm string, compressor string, n_clients int, d int, k int, round int, grad_norm double, f double, x_norm double, bytes_scalars double, bytes_indices double, seconds double"

    def kernel(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for name, content in zip(frame.path, frame.content):
                run, rounds = decode(bytes(content))
                rows += [(name, run.dataset, run.algorithm, run.compressor, run.n_clients, run.d, run.k, *r) for r in rounds]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(kernel, schema)


def cumulative_bytes(rounds: DataFrame, *run: str) -> DataFrame:
    """(run, round, bytes_scalars, bytes_indices, bytes_scalars_lagged) from bytes by round; the lagged one leaves out the round itself. Each run's rounds meet in one task."""
    w = Window.partitionBy(*(run or (F.lit(0),))).orderBy("round")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return rounds.select(
        *run, "round", F.sum("scalars").over(so_far).alias("bytes_scalars"), F.sum("indices").over(so_far).alias("bytes_indices"),
        F.coalesce(F.sum("scalars").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bytes_scalars_lagged"),
    )


def bits_per_client(scalars: Column, indices: Column, clients: int) -> Column:
    return (scalars + indices) * 8.0 / clients


def gaps(rounds: DataFrame, best: float) -> DataFrame:
    """rounds with the gap to the best value and the squared gradient norm, as plotted."""
    return rounds.withColumns({"value_gap": F.col("f") - best, "grad_norm_squared": F.col("grad_norm") * F.col("grad_norm")})
