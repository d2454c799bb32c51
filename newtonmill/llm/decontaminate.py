"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the number of their shingles. In a partition every item is sketched by its smallest MinHash
values (a bottom-k sketch), k just over the share of shingles that a match may lack for the partition's largest item:
a document that holds the required share of an item then holds at least one value of its sketch, so the search loses no
match however long the document is. A document is searched by looking its own shingles up among the sketch values, and
each item found is verified by counting all of its shingles in the document.

The sketches are made once and saved as a table. Where that table is small, and its size is counted first, every task
gets it whole and looks its documents up in one pass. A larger one is joined: a screen of bounded size, which every task
gets, leaves the documents' shingles that may be sketch values; those meet the table by value, and the pairs found are
verified. Either way the documents' shingles are looked up in one pass, whatever the size of the benchmark.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import save, small

U = np.uint64
#: Shingles of all items together up to which their table is sent to every task: 8 bytes each, and as many for sketches.
SENT_SHINGLES = 4 << 20
#: Bits of the tables that screen a document's shingles: of the items sent, and at most of those joined.
SCREEN_BITS, JOINED_BITS = 20, 27


def _hidden(grams: np.ndarray) -> np.ndarray:
    """MinHash values of shingles, by one permutation."""
    return W.mix(grams ^ U(0xA5A5A5A5))


def sketch(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The smallest MinHash values of an item, as many as its partition asks for."""
    largest = 2 ** math.ceil(math.log2(len(shingles)))  # of the partition of sizes up to a power of two
    return np.sort(_hidden(shingles))[: largest * (100 - percent) // 100 + 1]


def sketched(items: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(item, length, shingles, sketch) of each row of items (item, text): length is the words of its shingles. Rows without an id, without words or equal to another are left out."""

    def kernel(batches):
        for batch in small(batches):
            words = W.scan(batch.column(1), fold=True)
            sets = W.shingle_sets(words, shingle)
            kept = [i for i, s in enumerate(sets) if len(s)]
            lists = lambda rows: pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64()))
            length = np.minimum(np.diff(words.first), shingle)[kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(length, pa.int32()), lists([sets[i] for i in kept]), lists([sketch(sets[i], percent) for i in kept])], ["item", "length", "shingles", "sketch"])

    rows = items.where("item is not null and text is not null").distinct()
    return rows.mapInArrow(kernel, "item long, length int, shingles array<long>, sketch array<long>").dropDuplicates(["item", "length", "shingles"])


def grams_of(words: W.Words, n: int, shingle: int) -> np.ndarray:
    """Hash of the n words from each word on, as in a set of shingles."""
    if n == shingle:
        return W.runs(words.hashes, n)
    return W.wholes(words.hashes, n) if len(words.hashes) >= n else np.zeros(0, U)


class Items:
    """Benchmark items: their shingle sets, and the sketches of all partitions as one sorted table."""

    def __init__(self, rows: list, percent: int, shingle: int) -> None:
        self.ids, self.percent, self.shingle = [r.item for r in rows], percent, shingle
        #: words in the only shingle of a short item; shingle for others
        self.length = np.array([r.length for r in rows], np.int64)
        self.sets = [np.array(r.shingles, np.int64).view(U) for r in rows]
        values = [np.array(r.sketch, np.int64).view(U) for r in rows]
        self.values = np.concatenate(values) if values else np.zeros(0, U)
        order = np.argsort(self.values, kind="stable")
        self.owners = np.repeat(np.arange(len(values)), list(map(len, values)))[order] if values else np.zeros(0, int)
        self.values = self.values[order]
        self.screen = np.zeros(1 << SCREEN_BITS, bool)
        self.screen[(self.values >> U(64 - SCREEN_BITS)).astype(np.int64)] = True

    def matches(self, words: W.Words) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all matches among the texts."""
        owner = np.repeat(np.arange(len(words)), np.diff(words.first))
        found: set[tuple[int, int]] = set()
        for n in np.unique(self.length[self.length > 0]).tolist():
            grams = grams_of(words, n, self.shingle)
            if not len(grams):
                continue
            hashed = _hidden(grams)
            at = np.flatnonzero(self.screen[(hashed >> U(64 - SCREEN_BITS)).astype(np.int64)])
            at = at[owner[at] == owner[at + n - 1]]
            lo, hi = np.searchsorted(self.values, hashed[at], "left"), np.searchsorted(self.values, hashed[at], "right")
            for a, i, j in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                found |= {(int(owner[a]), int(x)) for x in self.owners[i:j] if self.length[x] == n}
        out, last, have = [], None, {}
        for text, item in sorted(found):
            if text != last:
                last, have = text, {}
            n = int(self.length[item])
            if n not in have:
                a, b = words.first[text], words.first[text + 1]
                have[n] = np.unique(grams_of(W.Words(words.data, words.starts, words.ends, np.array([0, b - a]), words.hashes[a:b]), n, self.shingle))
            shared = W.common(self.sets[item], have[n])
            if 100 * shared >= self.percent * len(self.sets[item]):
                out.append((text, item, shared))
        return out


def _sent(items: DataFrame, percent: int, shingle: int):
    """A function that gives the Items in a task, made once in each Python process; None if the items are too many to be sent."""
    if (items.agg(F.sum(F.size("shingles"))).first()[0] or 0) > SENT_SHINGLES:
        return None
    sent = items.sparkSession.sparkContext.broadcast(items.orderBy("item").collect())  # SENT_SHINGLES at most
    return lambda: _made(sent, percent, shingle)


_last: dict[tuple, Items] = {}


def _made(sent, percent: int, shingle: int) -> Items:
    key = (id(sent.value), percent, shingle)
    if key not in _last:
        _last.clear()
        _last[key] = Items(sent.value, percent, shingle)
        _last[key].source = sent.value  # kept, so that its id stays its own
    return _last[key]


def _joined(rows: DataFrame, items: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(id, key, item, n_shared, n_item) of all matches; rows: (id, key, text), key a hash of the text."""
    values = save(items.select("item", "length", F.hash("shingles").alias("which"), F.explode("sketch").alias("value")))
    lengths = sorted(r[0] for r in values.select("length").distinct().collect())  # `shingle` numbers at most
    bits = min(JOINED_BITS, max(SCREEN_BITS, (16 * values.count()).bit_length()))

    def marks(batches):
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[(batch.column(0).to_numpy().view(U) >> U(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(seen).reshape(-1, 1 << 10)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([packed[k].tobytes() for k in some.tolist()], pa.binary())], ["at", "bits"])

    screen = np.zeros((1 << bits - 13, 1 << 10), np.uint8)
    for r in values.select("value").distinct().coalesce(8).mapInArrow(marks, "at long, bits binary").collect():  # eight screens at most
        screen[r.at] |= np.frombuffer(r.bits, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(screen.reshape(-1))  # 2 ** (JOINED_BITS - 3) bytes at most

    def lookup(batches):
        for batch in small(batches):
            words = W.scan(batch.column(2), fold=True)
            owner = np.repeat(np.arange(len(words)), np.diff(words.first))
            for n in lengths:
                hashed = _hidden(grams_of(words, n, shingle))
                slot = (hashed >> U(64 - bits)).astype(np.int64)
                at = np.flatnonzero(sent.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                at = at[owner[at] == owner[at + n - 1]]
                text, value = (x.astype(np.int64) for x in (owner[at], hashed[at].view(np.int64)))
                if len(at):
                    text, value = np.unique(np.stack([text, value]), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array(np.full(len(text), n), pa.int32()), pa.array(value, pa.int64())], ["id", "key", "length", "value"])

    def verify(batches):
        last, have = None, None
        for batch in small(batches):
            shared = []
            for key, n, text, own in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                if (key, n) != last:
                    last, have = (key, n), np.unique(grams_of(W.scan(pa.array([text.as_py()], pa.string()), fold=True), n, shingle))
                shared.append(W.common(np.sort(own.values.to_numpy().view(U)), have))
            size = [len(x) for x in batch.column(5)]
            kept = pa.array([100 * a >= percent * b for a, b in zip(shared, size)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shared, pa.int64()), pa.array(size, pa.int64())], ["id", "key", "item", "n_shared", "n_item"]).filter(kept)

    kind = rows.schema["id"].dataType.simpleString()
    hits = rows.mapInArrow(lookup, f"id {kind}, key long, length int, value long").join(values, ["length", "value"]).select("id", "key", "item", "length", "which").distinct()
    texts = rows.dropDuplicates(["id", "key"]).alias("r")
    pairs = save(hits).alias("h").join(texts, F.expr("h.id <=> r.id and h.key = r.key")).select("h.*", "r.text")
    pairs = pairs.join(items.withColumn("which", F.hash("shingles")), ["item", "length", "which"])
    return pairs.select("id", "key", "item", "length", "text", "shingles").sortWithinPartitions("key", "length").mapInArrow(verify, f"id {kind}, key long, item long, n_shared long, n_item long")


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, n_shared, n_item, containment) of each row of docs and item of which the row's text holds at least `percent` % of the shingles.

    Shingles are `shingle` words, A-Z lower-cased; an item with fewer words is one shingle, sought among runs of as many
    words. Wordless or null items and texts match nothing; items without an id are skipped. Rows of docs are handled one
    by one, so repeated or null ids do no harm. Texts of items that share an id are sought apart, and a row has the id
    once, with the text of which it holds most. Other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = save(sketched(items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")), percent, shingle))
    get = _sent(table, percent, shingle)
    if get is None:
        keyed = rows.withColumn("key", F.xxhash64("text")).select("id", "key", "text")
        found = _joined(keyed, table, percent, shingle)
        best = found.groupBy("id", "key", "item").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("x"))
        out = keyed.select("id", "key").alias("r").join(best.alias("f"), F.expr("r.id <=> f.id and r.key = f.key")).select("r.id", "item", "x.n_shared", "x.n_item", "x.containment")
        return out.withColumnsRenamed({"id": id_col, "item": item_col})

    def kernel(batches):
        table = get()
        for batch in small(batches):
            best: dict[tuple[int, int], tuple] = {}
            for t, i, n in table.matches(W.scan(batch.column(1), fold=True)):
                size = len(table.sets[i])
                key = (t, table.ids[i])
                best[key] = max(best.get(key, (0.0, 0, 0)), (n / size, n, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([t for t, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64()), *(pa.array([x[k] for x in best.values()], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (0, pa.float64())))],
                ["id", "item", "n_shared", "n_item", "containment"],
            )

    out = rows.mapInArrow(kernel, f"id {kind}, item long, n_shared long, n_item long, containment double")
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no item, by the rule of contaminated(); all columns stay."""
    table = save(sketched(items.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")), percent, shingle))
    get = _sent(table, percent, shingle)
    text = F.col(text_col).cast("string")
    if get is None:
        rows = docs.select(F.lit(0).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
        held = save(_joined(rows, table, percent, shingle).select(F.col("key").alias("held_key")).distinct())
        return docs.join(held, F.xxhash64(text) == F.col("held_key"), "left_anti")
    place = docs.columns.index(text_col)

    def kernel(batches):
        table = get()
        for batch in small(batches):
            held = {t for t, _, _ in table.matches(W.scan(batch.column(place), fold=True))}
            yield batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

    docs = docs.withColumn(text_col, text)
    return docs.mapInArrow(kernel, docs.schema)
