"""Distributed rounds of gradient descent and of Newton-type methods with learned, compressed client Hessians.

A round is one job that writes the clients' messages and states, and one that sums the messages. Rows stay where they
are: partitions send sums for each client, clients send a gradient, a compressed Hessian correction and two numbers. The
driver keeps the iterate, the mean Hessian and its shift, all bounded by the number of features.
"""

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, save
from . import solvers
from .compressors import NAMES, Compressor, Lcg, compressor, frobenius, packed, unpacked

#: Tasks that share the sums of one client before the last sum.
SPREAD = 16


@dataclass
class TrainConfig:
    """Names and defaults follow the command line."""

    rounds: int
    lam: float
    algorithm: str = "newton"  # or gd
    option: str = "b"  # a: shift by lam or project; b: shift by the mean error
    project: bool = False
    compressor: str = "topk"
    k_mult: float = 8.0
    alpha: float | None = None
    alpha_option: int = 2
    line_search: bool = False
    c: float = 0.5
    gamma: float = 0.5
    max_line_search_steps: int = 5
    clients_per_round: int | None = None
    selection_seed: int = 1234
    seed: int = 123
    global_lr: float | None = None
    step_multiplier: float = 1.0
    update_then_solve: bool = True
    send_indices: bool = False
    tolerance: float = 0.0
    x0: list[float] | None = None

    def __post_init__(self) -> None:
        if self.algorithm not in ("gd", "newton") or self.option not in ("a", "b") or self.compressor not in NAMES:
            raise ValueError(f"unknown algorithm, option or compressor: {self.algorithm}, {self.option}, {self.compressor}")


@dataclass
class TrainResult:
    x: np.ndarray
    d: int
    clients: int
    log: list[tuple] = field(default_factory=list)

    COLUMNS = "round int, grad_norm double, f double, x_norm double, bytes_scalars double, bytes_indices double, seconds double"

    def rounds(self, spark) -> DataFrame:
        return spark.createDataFrame(self.log, self.COLUMNS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _doubles(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<f8")


def client_sums(samples: DataFrame, x: np.ndarray, second: bool = True) -> DataFrame:
    """(client_id, n, loss, g, h): sums over each client's samples of the loss, its gradient and its Hessian (packed), g and h as binary doubles.

    samples: client_id and features, already multiplied by their labels. Each partition sums for itself; a client's sums
    then meet in two steps, so a client with very many partitions does not burden one task."""
    d = len(x)

    def kernel(batches):
        held: dict[int, list] = {}
        for batch in batches:
            # a batch is put in the order of its clients once, and each client's samples are a slice of it
            owner, a = batch.column(0).to_numpy(), _matrix(batch.column(1))
            order = np.argsort(owner, kind="stable")
            owner, a = owner[order], a[order]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
            margins = a @ x
            sigmoid = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
            losses = np.add.reduceat(np.maximum(-margins, 0) + np.log1p(np.exp(-np.abs(margins))), first) if len(first) else ()
            for c, i, j, loss in zip(owner[first].tolist(), first, [*first[1:], len(owner)], losses):
                own, s = a[i:j], sigmoid[i:j]
                parts = [len(own), float(loss), -((1 - s) @ own), packed((own * (s * (1 - s))[:, None]).T @ own) if second else np.zeros(0)]
                held[c] = [p + q for p, q in zip(held[c], parts)] if c in held else parts
        if held:
            yield pa.RecordBatch.from_pydict({"client_id": pa.array(held, pa.int32()), "n": pa.array([p[0] for p in held.values()], pa.int64()), "loss": [p[1] for p in held.values()], "g": [p[2].tobytes() for p in held.values()], "h": [p[3].tobytes() for p in held.values()]})

    def add(table: pa.Table) -> pa.Table:
        total = [np.sum([_doubles(v) for v in table.column(c).to_pylist()], axis=0).tobytes() for c in ("g", "h")]
        return pa.table({"client_id": table.column("client_id")[:1].cast(pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "loss": [sum(table.column("loss").to_pylist())], "g": pa.array(total[:1], pa.binary()), "h": pa.array(total[1:], pa.binary())})

    schema = "client_id int, n long, loss double, g binary, h binary"
    parts = samples.select("client_id", "features").mapInArrow(kernel, schema)
    spread = parts.groupBy("client_id", F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("part"))
    return spread.applyInArrow(add, schema).groupBy("client_id").applyInArrow(add, schema)


def mean_losses(samples: DataFrame, points: list[np.ndarray], lam: float) -> np.ndarray:
    """The mean over clients of the objective at each point, all in one pass."""
    grid = np.array(points).T

    def kernel(batches):
        for batch in batches:
            owner, m = batch.column(0).to_numpy(), _matrix(batch.column(1)) @ grid
            loss = np.maximum(-m, 0) + np.log1p(np.exp(-np.abs(m)))
            for c in np.unique(owner).tolist():
                own = loss[owner == c]
                yield pa.RecordBatch.from_pydict({"client_id": pa.array([c], pa.int32()), "n": pa.array([len(own)], pa.int64()), "s": pa.array([own.sum(axis=0).tolist()], pa.list_(pa.float64()))})

    sums = samples.select("client_id", "features").mapInArrow(kernel, "client_id int, n long, s array<double>")
    by_client = sums.groupBy("client_id").agg(*((F.sum(F.col("s")[k]) / F.sum("n")).alias(f"f{k}") for k in range(len(points))))
    row = by_client.agg(*(F.avg(f"f{k}") for k in range(len(points)))).first()
    return np.array(row) + lam / 2 * np.sum(grid * grid, axis=0)


STATE = "client_id int, h binary, l double, g binary, rng long"


def _first_states(sums: DataFrame, d: int, lam: float, seed: int, x: np.ndarray) -> DataFrame:
    """Each client's learned Hessian is its true one at the start."""

    def kernel(batches):
        for batch in batches:
            for c, n, g, h in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                own = _doubles(h) / n + lam * packed(np.eye(d))
                grad = _doubles(g) / n + lam * x
                yield pa.RecordBatch.from_pydict({"client_id": pa.array([c], pa.int32()), "h": [own.tobytes()], "l": [0.0], "g": [(unpacked(own, d) @ x - grad).tobytes()], "rng": pa.array([seed + c], pa.int64())})

    return sums.mapInArrow(kernel, STATE)


def _step(sums: DataFrame, states: DataFrame, x: np.ndarray, config: TrainConfig, comp: Compressor, chosen: list[int] | None) -> DataFrame:
    """Message and next state of every client; those not chosen keep their state and send nothing."""
    d, lam, partial = len(x), config.lam, chosen is not None
    chosen_set = set(chosen or ())
    joined = states.join(sums.select("client_id", "n", "loss", F.col("g").alias("sum_g"), F.col("h").alias("sum_h")), "client_id")

    def kernel(batches):
        for batch in batches:
            for c, h, shift, g_i, rng, n, loss, sum_g, sum_h in zip(*(batch.column(k).to_pylist() for k in range(9))):
                grad = _doubles(sum_g) / n + lam * x
                f = loss / n + lam / 2 * float(x @ x)
                state, draws = _doubles(h), Lcg(rng)
                at, value, sent, kept_shift, kept_g, scalars, indices = np.zeros(0, int), np.zeros(0), grad, shift, _doubles(g_i), 0, 0
                if not partial or c in chosen_set:
                    true = _doubles(sum_h) / n + lam * packed(np.eye(d))
                    at, value = comp.apply(true - state, draws)
                    error = frobenius(true - state, d)
                    state = state.copy()
                    state[at] += comp.alpha * value
                    if partial:
                        kept_shift = frobenius(true - state, d)
                        kept_g = unpacked(state, d) @ x + kept_shift * x - grad
                        sent, error = kept_g - _doubles(g_i), kept_shift - shift
                    scalars, indices = comp.message_bytes(len(at), config.send_indices)
                    scalars += 8 * (d + 2)
                elif partial:
                    sent, error = np.zeros(d), 0.0
                yield pa.RecordBatch.from_pydict({
                    "client_id": pa.array([c], pa.int32()), "h": [state.tobytes()], "l": [float(kept_shift)], "g": [np.asarray(kept_g).tobytes()], "rng": pa.array([draws.state], pa.int64()),
                    "f": [float(f)], "error": [float(error)], "sent": pa.array([sent.tolist()], pa.list_(pa.float64())), "grad": pa.array([grad.tolist()], pa.list_(pa.float64())), "at": pa.array([at.tolist()], pa.list_(pa.int32())),
                    "value": pa.array([(comp.alpha * value).tolist()], pa.list_(pa.float64())), "scalars": pa.array([scalars], pa.int64()), "indices": pa.array([indices], pa.int64()),
                })

    out = f"{STATE}, f double, error double, sent array<double>, grad array<double>, at array<int>, value array<double>, scalars long, indices long"
    return joined.select("client_id", "h", "l", F.col("g"), "rng", "n", "loss", "sum_g", "sum_h").mapInArrow(kernel, out)


def _gathered(messages: DataFrame, d: int, n: int, clients: int) -> dict[str, np.ndarray]:
    """Means over clients, summed on the cluster entry by entry: at most d(d+1)/2 numbers come to the driver."""
    entry = lambda kind, pos, v: F.struct(F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), v.cast("double").alias("v"))
    ones = F.array(*(entry(kind, F.lit(0), F.col(kind)) for kind in ("f", "error", "scalars", "indices")))
    arrays = [F.transform(kind, _entry(kind)) for kind in ("sent", "grad")]
    sparse = F.zip_with("at", "value", lambda p, v: entry("h", p, v))
    rows = messages.select(F.explode(F.concat(ones, *arrays, sparse)).alias("e")).groupBy("e.kind", "e.pos").agg(F.sum("e.v").alias("v")).collect()
    out = {"f": np.zeros(1), "error": np.zeros(1), "scalars": np.zeros(1), "indices": np.zeros(1), "sent": np.zeros(d), "grad": np.zeros(d), "h": np.zeros(n)}
    for r in rows:
        out[r.kind][r.pos] = r.v
    return {k: v if k in ("scalars", "indices") else v / clients for k, v in out.items()}


def _entry(kind: str):
    return lambda v, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("pos"), v.cast("double").alias("v"))


def _mean_state(states: DataFrame, size: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Mean Hessian and mean g of the states, and the number of clients; one partial sum for each task comes to the driver."""

    def kernel(batches):
        h = g = None
        n = 0
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, g, n = (_doubles(x) + (0 if h is None else h), _doubles(y) + (0 if g is None else g), n + 1)
        if n:
            yield pa.RecordBatch.from_pydict({"h": [h.tobytes()], "g": [g.tobytes()], "n": pa.array([n], pa.int64())})

    h, g, n = np.zeros(size), 0.0, 0
    for r in states.select("h", "g").mapInArrow(kernel, "h binary, g binary, n long").toLocalIterator():
        h, g, n = h + _doubles(bytes(r.h)), g + _doubles(bytes(r.g)), n + r.n
    return h / n, n, g / n


def _select(rng: Lcg, clients: int, k: int) -> list[int]:
    return rng.first_of_shuffle(clients, k).tolist()


def train(samples: DataFrame, config: TrainConfig) -> TrainResult:
    """Trains on samples (client_id from 0, features times label); clients must have equal numbers of samples.

    The mean Hessian takes in a round's corrections before the system is solved, or after it with update_then_solve off."""
    first = samples.select(F.size("features").alias("d")).first()
    if first is None:
        raise ValueError("there are no samples")
    d, lam = first.d, config.lam
    x = np.zeros(d) if config.x0 is None else np.array(config.x0, float)
    size = d * (d + 1) // 2
    began, result = time.time(), TrainResult(x, d, 0)
    total = np.zeros(2)
    if config.algorithm == "gd":
        return _gradient_descent(samples, config, x)
    comp = compressor(config.compressor, d, config.k_mult, config.alpha, config.alpha_option)
    states = save(_first_states(client_sums(samples, x), d, lam, config.seed, x))
    mean_h, clients, mean_g = _mean_state(states, size)
    result.clients, shift = clients, 0.0
    partial, draws = config.clients_per_round is not None, Lcg(config.selection_seed)
    for k in range(config.rounds):
        if partial:
            x = solvers.solve(unpacked(mean_h, d), mean_g, shift)
        chosen = _select(draws, clients, config.clients_per_round) if partial else None
        done = save(_step(client_sums(samples, x), states, x, config, comp, chosen))
        got = _gathered(done, d, size, clients)
        drop(states)
        states = done.select("client_id", "h", "l", "g", "rng")
        grad_norm = float(np.linalg.norm(got["grad"]))
        result.log.append((k, grad_norm, float(got["f"][0]), float(np.linalg.norm(x)), *map(float, total), time.time() - began))
        total = total + [got["scalars"][0], got["indices"][0]]
        before = mean_h
        mean_h = mean_h + got["h"]
        if partial:
            mean_g, shift = mean_g + got["sent"], shift + float(got["error"][0])
        else:
            used = unpacked(mean_h if config.update_then_solve else before, d)
            if config.option == "b":
                dx = solvers.solve(used, got["grad"], float(got["error"][0]))
            elif config.project:
                dx = solvers.solve(solvers.project_above(used, lam), got["grad"])
            else:
                dx = solvers.solve(used, got["grad"], lam)
            step = 1.0
            if config.line_search:
                trials = [config.gamma**i for i in range(config.max_line_search_steps)]
                f = mean_losses(samples, [x - t * dx for t in trials], lam)
                slope = float(dx @ got["grad"])
                passed = [t for t, v in zip(trials, f) if v <= got["f"][0] - config.c * t * slope]
                step = passed[0] if passed else trials[-1]
            x = x - step * dx
        result.x = x
        if grad_norm <= config.tolerance:
            break
    return result


def _gradient_descent(samples: DataFrame, config: TrainConfig, x: np.ndarray) -> TrainResult:
    began, lam, d = time.time(), config.lam, len(x)
    rate = config.global_lr if config.global_lr is not None else 2 / (lam + smoothness(samples, lam))
    result = TrainResult(x, d, 0)
    for k in range(config.rounds):
        result.clients, f, g = mean_gradient(samples, x, lam)
        result.log.append((k, float(np.linalg.norm(g)), f, float(np.linalg.norm(x)), 8.0 * d * result.clients * k, 0.0, time.time() - began))
        x = x - rate * config.step_multiplier * g
        result.x = x
    return result


def mean_gradient(samples: DataFrame, x: np.ndarray, lam: float) -> tuple[int, float, np.ndarray]:
    """Clients, and the means over them of the objective and its gradient. Each task adds up its clients, so a row for each task comes to the driver."""

    def kernel(batches):
        n, f, g = 0, 0.0, np.zeros(len(x))
        for batch in batches:
            for size, loss, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n, f, g = n + 1, f + loss / size, g + _doubles(own) / size
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "f": [f], "g": [g.tobytes()]})

    n, f, g = 0, 0.0, np.zeros(len(x))
    for r in client_sums(samples, x, second=False).select("n", "loss", "g").mapInArrow(kernel, "n long, f double, g binary").toLocalIterator():
        n, f, g = n + r.n, f + r.f, g + _doubles(bytes(r.g))
    return n, f / max(1, n) + lam / 2 * float(x @ x), g / max(1, n) + lam * x


def gram_times(samples: DataFrame, v: np.ndarray) -> tuple[np.ndarray, int]:
    """Samples' transpose times samples times v, and the number of samples: one pass, a vector for each task comes to the driver."""

    def kernel(batches):
        total, n = np.zeros(len(v)), 0
        for batch in batches:
            a = _matrix(batch.column(0))
            total, n = total + (a @ v) @ a, n + len(a)
        yield pa.RecordBatch.from_pydict({"w": [total.tobytes()], "n": pa.array([n], pa.int64())})

    w, n = np.zeros(len(v)), 0
    for r in samples.select("features").mapInArrow(kernel, "w binary, n long").toLocalIterator():
        w, n = w + _doubles(bytes(r.w)), n + r.n
    return w, n


def gram(samples: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Sum of the samples' outer products and their number; one packed triangle for each task comes to the driver."""

    def kernel(batches):
        total, n = np.zeros(d * (d + 1) // 2), 0
        for batch in batches:
            a = _matrix(batch.column(0))
            total, n = total + packed(a.T @ a), n + len(a)
        yield pa.RecordBatch.from_pydict({"h": [total.tobytes()], "n": pa.array([n], pa.int64())})

    total, n = np.zeros(d * (d + 1) // 2), 0
    for r in samples.select("features").mapInArrow(kernel, "h binary, n long").toLocalIterator():
        total, n = total + _doubles(bytes(r.h)), n + r.n
    return unpacked(total, d), n


#: Features up to which the Gram matrix goes to the driver; beyond, each step of a power iteration is a pass over the samples.
GRAM_FEATURES = 2048


def smoothness(samples: DataFrame, lam: float, eps: float = 1e-10, most: int = 1000, gram_features: int = GRAM_FEATURES) -> float:
    """The greatest eigenvalue of the Gram matrix over 4 m by power iteration, plus lam."""
    d = samples.select(F.size("features").alias("d")).first().d
    if d <= gram_features:
        m, n = gram(samples, d)
        times = lambda v: m @ v / (4 * n)
    else:

        def times(v: np.ndarray) -> np.ndarray:
            w, n = gram_times(samples, v)
            return w / (4 * n)

    v, value = np.ones(d), 0.0
    for _ in range(most):
        w = times(v)
        top = float(np.abs(w).max())
        if top == 0 or abs(top - value) <= eps * top:
            value = top
            break
        v, value = w / top, top
    return value + lam
