"""Near-duplicate documents: MinHash bands propose pairs, odd sketches weed them, full shingle sets confirm them.

An odd sketch keeps, for every bit, the parity of the MinHash samples that fall on it. The XOR of two sketches is
the sketch of the samples in which two documents differ, so its population count estimates their similarity, the
more precisely the higher that is. A banded pair goes on to the exact comparison of sets unless the estimate
lies far below the threshold.

Copies: documents with the same shingle set are one node, so copies are never paired. Within a band's bucket every
node meets the least node first; what the confirmed links already join is settled. Nodes that led to the same least
node are a family. Where it still holds several components, blocks of its sketches meet, of a few dozen bytes a node:
each node goes to the exact comparison with the one it is likeliest to be linked with, and what this does not settle, the
nodes whose sketches leave another component open, meets again with texts, in blocks of bounded size from which the exact
links come out, never the pairs. Where a bucket still holds several families and components, the sketches choose the
pairs. So no pair that shares a bucket goes untested unless it is joined anyway or its sketches rule it out. With 40
bands of 4 samples a pair of similarity 0.75 shares no bucket once in four million.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .store import drop, save, small

U = np.uint64
#: MinHash samples, all of which enter the odd sketch; the first BANDS * ROWS also make the bands.
SAMPLES, BANDS, ROWS, BITS = 256, 40, 4, 512
LONGS = BITS // 64
#: Standard deviations by which a sketch may stray from what a pair at the threshold shows.
SLACK = 5.5
#: Members of a bucket or family in a block, at least, and at most where it has very many; members at most and bytes in a block of texts.
BLOCK, WIDE, TEXTS, BLOCK_BYTES = 64, 4096, 256, 8 << 20
#: Shared shingles in one product of indicator matrices.
COLUMNS = 4096
_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.int64) * 2 + 1).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.int64).astype(np.uint32)[:, None]
_SALT = W.mix(np.arange(1, SAMPLES + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of 64-bit hashes."""
    h, least = (shingles >> U(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(least, (h[i : i + 1024] * _A + _B).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parities of the samples over BITS bits, as signed 64-bit words."""
    at = (W.mix(least.astype(U) + _SALT) >> U(11)).astype(np.int64) % BITS
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].astype(U).reshape(BANDS, ROWS)
    key = _SALT[:BANDS].copy()
    for k in range(ROWS):
        key = W.mix(key + rows[:, k])
    return key.view(np.int64)


def most_differing_bits(threshold: float) -> int:
    """The population count of the XOR that a pair at the threshold exceeds only by a chance of SLACK deviations."""
    differ = SAMPLES * (1 - threshold)
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differ))
    by_samples = (1 - 2 / BITS) ** (2 * differ) * 2 * (SAMPLES * threshold * (1 - threshold)) ** 0.5
    by_bits = (BITS / 4 * (1 - (1 - 2 / BITS) ** (4 * differ))) ** 0.5
    return min(BITS, int(mean + SLACK * (by_samples**2 + by_bits**2) ** 0.5) + 1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarities estimated from the population counts of XORs of sketches, the more precisely the higher they are."""
    share = np.minimum(1 - 1 / BITS, 2 * np.asarray(differing) / BITS)
    return np.maximum(0.0, 1 - np.log1p(-share) / np.log1p(-2 / BITS) / (2 * SAMPLES))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, text_key, n_shingles, set_a, set_b, bands, sketch) of each row; set_a and set_b hash the shingle set. Sets without members have no bands."""

    def kernel(batches):
        for batch in small(batches):
            sets = W.shingle_sets(W.scan(batch.column(1), fold=True), shingle)
            whole = [(W.whole(s), W.whole(W.mix(s))) for s in sets]
            least = [samples(s) if len(s) else None for s in sets]
            lists = lambda f, n: pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(n if x is not None else 0 for x in least)]), pa.int32()),
                pa.array(np.concatenate([f(x) for x in least if x is not None] or [np.zeros(0, np.int64)]), pa.int64()),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([a for a, _ in whole], U).view(np.int64), pa.int64()),
                    pa.array(np.array([b for _, b in whole], U).view(np.int64), pa.int64()),
                    lists(band_keys, BANDS),
                    lists(odd_sketch, LONGS),
                ],
                ["id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(kernel, "id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _differing(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(LONGS)]
    return sum(bits[1:], bits[0])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union; texts: (id, text) of the nodes."""

    def kernel(batches):
        last, held = None, None
        for batch in small(batches):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left = W.shingle_sets(W.scan(batch.column(2), fold=True), shingle)
            fresh = [i for i, x in enumerate(b) if x != (b[i - 1] if i else last)]
            right = iter(W.shingle_sets(W.scan(batch.column(3).take(pa.array(fresh, pa.int64())), fold=True), shingle))
            fresh, keep = set(fresh), []
            for i, s in enumerate(left):
                held = next(right) if i in fresh else held
                both = W.common(s, held)
                if 100 * both >= percent * (len(s) + len(held) - both) and both:
                    keep.append(i)
            last = b[-1] if b else last
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b)], ["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(kernel, "a long, b long").distinct()


def _dealt(members: DataFrame, by: str, blocks: Column) -> DataFrame:
    """Every pair of blocks (lo, hi) of each group `by` gets the rows of both; blocks: an aggregate that gives their number."""
    # a table of its own, so that Spark can split a hot group's rows in the join
    groups = save(members.groupBy(by).agg(F.ceil(blocks).cast("int").alias("blocks")))
    dealt = members.join(groups, by).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")


def _blocks(widest: int) -> Column:
    """How many blocks a group has: small ones, so that their pairs spread over all tasks, and larger ones, `widest` at most, where it has so many that their pairs would be too many."""
    n = F.count("*")
    return n / F.least(F.greatest(n / BLOCK, F.lit(BLOCK)), F.lit(widest))


def _open_pairs(table: pa.Table, worst: int):
    """For each row of two blocks, the rows of the other in another component that the sketches leave, and by how many bits they differ."""
    part, block = (table.column(c).to_numpy() for c in ("component", "block"))
    bits = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, LONGS).view(U)
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    sides = {(lo, hi), (hi, lo)}
    for x, y in sides:
        rows, cols = np.flatnonzero(block == x), np.flatnonzero(block == y)
        for r in rows.tolist():
            c = cols[part[cols] != part[r]]
            far = np.bitwise_count(bits[c] ^ bits[r]).sum(axis=1)
            if np.any(far <= worst):
                yield r, c[far <= worst], far[far <= worst]


def _nearest(families: DataFrame, worst: int) -> DataFrame:
    """(node, far, other): the node of another component in its family whose sketch differs least, for each node that the sketches leave one; families: (family, node, component, sketch)."""

    def kernel(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        found = [(int(node[r]), int(far.min()), int(node[c[far == far.min()]].min())) for r, c, far in _open_pairs(table, worst)]
        return pa.table({k: pa.array([x[i] for x in found], t) for i, (k, t) in enumerate((("node", pa.int64()), ("far", pa.int32()), ("other", pa.int64())))})

    near = _dealt(families, "family", _blocks(WIDE)).groupBy("family", "lo", "hi").applyInArrow(kernel, "node long, far int, other long")
    return near.groupBy("node").agg(F.min(F.struct("far", "other")).alias("x")).select("node", "x.far", "x.other")


def _within(families: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Confirmed links (a, b) between members of a family that lie in different components; families: (family, node, component, text).

    Two blocks of texts meet in each task. Their shared shingles make two indicator matrices, whose product has the size
    of every intersection, so that no pair is emitted that is not a link."""

    def kernel(table: pa.Table) -> pa.Table:
        node, part, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
        found: list[tuple[int, int]] = []
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        rows, cols = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        if len(np.unique(part)) > 1 and len(rows) and len(cols):
            sets = W.shingle_sets(W.scan(table.column("text"), fold=True), shingle)
            n = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
            code, owner = code[seen[code] > 1], owner[seen[code] > 1]
            both = np.zeros((len(rows), len(cols)), np.float32)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            place = np.full(len(sets), -1)
            place[rows] = np.arange(len(rows))
            across = np.full(len(sets), -1)
            across[cols] = np.arange(len(cols))
            dense = np.cumsum(np.concatenate([[0], np.diff(code) != 0]))
            for k in range(0, int(dense[-1]) + 1 if len(dense) else 0, COLUMNS):
                i, j = np.searchsorted(dense, [k, k + COLUMNS])
                left, right = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(cols), COLUMNS), np.float32)
                o, d = owner[i:j], dense[i:j] - k
                left[place[o][place[o] >= 0], d[place[o] >= 0]] = 1
                right[across[o][across[o] >= 0], d[across[o] >= 0]] = 1
                both += left @ right.T
            both = np.rint(both).astype(np.int64)
            linked = (100 * both >= percent * (n[rows][:, None] + n[cols][None, :] - both)) & (part[rows][:, None] != part[cols][None, :])
            found = [(node[rows[r]], node[cols[c]]) for r, c in zip(*np.nonzero(linked))]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    rows = _dealt(families, "family", F.greatest(_blocks(TEXTS), F.sum(F.octet_length("text")) / BLOCK_BYTES))
    return rows.groupBy("family", "lo", "hi").applyInArrow(kernel, "a long, b long")


def _across(members: DataFrame, worst: int) -> DataFrame:
    """Pairs (a, b) of one bucket but different families and components that the sketches leave; members: (key, node, family, component, sketch)."""

    def kernel(table: pa.Table) -> pa.Table:
        node, family = (table.column(c).to_numpy() for c in ("node", "family"))
        found = {(max(node[r], x), min(node[r], x)) for r, c, _ in _open_pairs(table, worst) for x in node[c[family[c] != family[r]]]}
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return _dealt(members, "key", _blocks(WIDE)).groupBy("key", "lo", "hi").applyInArrow(kernel, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = 5) -> DataFrame:
    """(id_col, n_shingles, component_id, kept, text_key) for each row of docs; text_key is the xxhash64 of its text.

    Documents are linked where 100 * intersection >= percent * union of their sets of `shingle`-word shingles;
    component_id is the least id that links reach, kept says that it is the row's own. Rows that share an id are
    one document. A null or wordless text has no shingles and is linked with nothing; a row without an id is linked
    with nothing, has no component and is kept. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    signed = save(signatures(docs, id_col, text_col, shingle))
    nodes = save(signed.where("id is not null and n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("id", "bands", "sketch")).alias("x")).select("set_a", "set_b", F.col("x.id").alias("node"), "x.bands", "x.sketch"))
    worst = most_differing_bits(percent / 100)
    sketches = nodes.select("node", "sketch")
    members = nodes.select("node", F.explode("bands").alias("key"))
    hubs = save(members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub"))
    buckets = save(members.join(hubs, "key"))
    met = save(buckets.where("node > hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    one, two = sketches.toDF("a", "sketch_a"), sketches.toDF("b", "sketch_b")
    pairs = save(met.join(one, "a").join(two, "b").where(_differing("sketch_a", "sketch_b") <= worst).select("a", "b"))
    wanted = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted.hint("merge"), "id", "left_semi"))
    links = save(confirm(pairs, texts, percent, shingle))
    joined = save(components(links))

    # a node's family: the least hub that it or its hubs have met
    first = save(pairs.groupBy("a").agg(F.min("b").alias("family")))
    second = pairs.join(first.select(F.col("a").alias("b"), F.col("family").alias("further")), "b", "left").groupBy("a").agg(F.min(F.least("b", F.coalesce("further", "b"))).alias("family"))
    family = second.unionAll(pairs.select("b", "b")).groupBy(F.col("a").alias("node")).agg(F.min("family").alias("family"))
    family = save(buckets.select("node").distinct().join(family, "node", "left").select("node", F.coalesce("family", "node").alias("family")))

    def split(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, component, family) of all nodes in buckets, and of the families with several components alone, with their sketches."""
        known = save(family.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "family"))
        open_ = known.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("family")
        return known, known.join(save(open_), "family").join(sketches, "node")

    known, families = split(joined)
    nearest = save(_nearest(families, worst))
    likely = nearest.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    links = save(links.unionAll(confirm(likely, texts, percent, shingle)))
    known, families = split(save(components(links)))
    left = save(_nearest(families, worst)).select("node")
    texts_of = texts.select(F.col("id").alias("node"), "text")
    links = save(links.unionAll(_within(families.drop("sketch").join(left, "node").join(texts_of, "node"), percent, shingle)))
    parts = buckets.select("key", "node").join(known, "node")
    several = parts.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("family").alias("v"), F.max("family").alias("w")).where("x < y and v < w").select("key")
    rest = _across(parts.join(save(several), "key").join(sketches, "node"), worst).join(met, ["a", "b"], "left_anti")
    joined = save(components(links.unionAll(confirm(save(rest), texts, percent, shingle))))
    ids = nodes.join(joined, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("c"))
    ids = save(ids)
    for used in (hubs, buckets, met, pairs, texts, first, family):
        drop(used)
    # rows that share an id but not a text are one document
    doc = signed.join(ids, ["set_a", "set_b"], "left").select("id", "text_key", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))
    return doc.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")
