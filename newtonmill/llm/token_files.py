"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code, control bytes apart from data bytes.

An id is written as its rank by corpus frequency, low bytes first, in as few bytes as it needs; two bits in the control
stream give the number of bytes, four values to a control byte. Decoding looks each control byte up in a table of four
lengths and gathers all bytes at once with numpy.

A file set is a folder of two Parquet tables, so that any store that Spark can write holds it: `ranks` (rank, id), and
`blocks`, one row per block of documents in order, with the two streams as separate binary columns. Blocks are dealt to
shards by ranges of the id column; (shard, block) is the order of the file set.
"""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .chunks import WORDS, ChunkTable, groups, spaced_words, vocabulary_spec
from .store import drop, limits, save, scratch, small

#: Distinct chunks, and distinct pre-tokens, that a worker keeps.
KEPT = 700_000
#: Ids in a block, and in a shard, at least.
BLOCK_IDS, SHARD_IDS = 1 << 18, 1 << 23
#: Lengths of the four values behind each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative integers under 2**32."""
    r = ranks.astype("<u4")
    length = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers that pack() wrote."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(length) - length
    stream = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = stream[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(length > k)
        if len(longer):
            out[longer] |= stream[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, whose model is asked once for each distinct pre-token.

    For vocabularies of lower-case words with the pre-tokens of WORDS, which neither cross nor depend on white space."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        vocabulary_spec(path, "word")
        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, str.maketrans(byte_letters())
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.odd = regex.compile("[\x1c-\x1f]")  # white space to str.split() alone
        self.by_space, self.pretokens = regex.compile(r"\P{White_Space}+").findall, regex.compile(WORDS).findall
        self.kept: dict[str, list[int]] = {}
        self.table = ChunkTable(self._chunks, KEPT)

    def _chunks(self, chunks: list[str]) -> list:
        if len(self.kept) > KEPT:
            self.kept.clear()
        return [self._ids(c) if c.isalpha() else self._pieces(c) for c in chunks]

    def _ids(self, word: str) -> list[int]:
        plain = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(plain)]

    def _pieces(self, chunk: str) -> list[int]:
        """Ids of a chunk that is not one word; its pre-tokens are kept, as they stand in many chunks."""
        if chunk in self.special:
            return [self.special[chunk]]
        out: list[int] = []
        for word in self.pretokens(chunk):
            own = self.kept.get(word)
            if own is None:
                own = self.kept[word] = self._ids(word)
            out += own
        return out

    def _spaced(self, text: str) -> str:
        """The normalized text, its chunks between single spaces or other ASCII white space."""
        spaced = (lambda p: " ".join(self.by_space(p))) if self.odd.search(text) else spaced_words
        plain = lambda p: spaced(p.lower() if p.isascii() else unicodedata.normalize("NFC", p).replace("Σ", "σ").lower())
        return " ".join(p if p in self.special else plain(p) for p in self.specials(text)) if self.specials and "<|" in text else plain(text)

    def encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by end, and the border of each text."""
        codes, first = self.table.spaced([self._spaced(t) for t in texts])
        ids = self.table.gather(codes)
        borders = np.concatenate([[0], np.cumsum(self.table.length[codes])])[first]
        if end is not None:
            ids, borders = np.insert(ids, borders[1:], end), borders + np.arange(len(borders))
        return ids, borders


_open: dict[str, LibraryEncoder] = {}


def _column(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Runs of an integer array as binary values, without a copy of each."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer((borders * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def encode_ids(docs: DataFrame, path: str, end: int | None, width: str = "<u4", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids): ids as little-endian unsigned integers of the width given, in one binary value.

    Each task ends with one more row, n = -1, whose ids are how often it met each id, as 64-bit integers from id 0 on."""

    def kernel(batches):
        if path not in _open:
            _open[path] = LibraryEncoder(path)
        met = np.zeros(0, np.int64)
        for batch in small(batches, 1024):  # larger batches hold fewer distinct chunks for their size
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in groups(texts):
                ids, borders = _open[path].encode(texts[i:j], end)
                one = np.bincount(ids, minlength=len(met))
                one[: len(met)] += met
                met = one
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(borders), pa.int64()), _column(ids.astype(width), borders)], ["id", "n", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([met.tobytes()], pa.binary())], ["id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(kernel, "id long, n long, ids binary")


def ranks_by_frequency(encoded: DataFrame) -> np.ndarray:
    """The ids that occur, most frequent first, from the tasks' counts. There are at most as many as the vocabulary has, so the driver can hold them."""

    def kernel(batches):
        for batch in batches:
            for counts in batch.column(0):
                met = np.frombuffer(counts.as_buffer(), np.int64)
                found = np.flatnonzero(met)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(met[found])], ["token", "n"])

    rows = encoded.where("n < 0").select("ids").mapInArrow(kernel, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token")
    return np.array([r[0] for r in rows.select("token").collect()], np.int64)


def write_token_files(docs: DataFrame, folder: str, path: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the whole text of each row and writes a file set to folder, in ascending order of id_col.

    A null text is empty. Rows without an id come first; rows that share an id stand together, ordered by their ids.
    Other columns of docs are not looked at. An empty table gives a file set without blocks.
    """
    spark = docs.sparkSession
    width = "<u2" if max(LibraryEncoder(path).library.get_vocab_size(), (end or 0) + 1) <= 1 << 16 else "<u4"
    encoded = save(encode_ids(docs, path, end, width, id_col, text_col), 1024)
    order = ranks_by_frequency(encoded)
    rows = encoded.where("n >= 0")
    rank = np.zeros(int(order.max(initial=-1)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shards = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // SHARD_IDS))
    ranked = spark.sparkContext.broadcast(rank)  # four bytes for each id of the vocabulary

    def kernel(batches):
        from pyspark import TaskContext

        shard, block, at, rank = TaskContext.get().partitionId(), 0, 0, ranked.value
        held: list[tuple] = []

        def flush():
            nonlocal block, at, held
            ids = np.concatenate([np.frombuffer(x[2], width) for x in held])
            control, data = pack(rank[ids] if len(ids) else ids)
            row = {"shard": [shard], "block": [block], "at": [at], "n": [len(ids)], "docs": [[x[0] for x in held]], "lengths": [[x[1] for x in held]], "control": [control], "data": [data]}
            block, at, held = block + 1, at + len(ids), []
            return pa.RecordBatch.from_pydict(row, schema=BLOCKS)

        size = 0
        for batch in small(batches):
            for i, n, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.append((i, n, ids))
                size += n
                if size >= BLOCK_IDS:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    blocks = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", F.xxhash64("ids")).mapInArrow(kernel, "shard int, block int, at long, n long, docs array<long>, lengths array<long>, control binary, data binary")
    with limits(spark):
        blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    drop(encoded)
    spark.createDataFrame(enumerate(order.tolist()), "rank long, token long").coalesce(1).write.parquet(f"{folder}/ranks")


BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids) of each document of a file set: ids is binary, little-endian unsigned 32-bit; start counts the ids of all documents before it.

    A file set without blocks gives no rows. Documents come back as they were written: repeated and null ids stay, each
    with its own start.
    """
    ranks = spark.read.schema("rank long, token long").parquet(f"{folder}/ranks").orderBy("rank").collect()
    tokens = spark.sparkContext.broadcast(np.array([r[1] for r in ranks], np.uint32))
    blocks = spark.read.schema("shard int, block int, at long, n long, docs array<long>, lengths array<long>, control binary, data binary").parquet(f"{folder}/blocks")
    # one row for each shard, of which there is one for each SHARD_IDS ids
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))

    def kernel(batches):
        for batch in small(batches, 8):
            for base, at, n, docs, lengths, control, data in zip(*(batch.column(k).to_pylist() for k in range(7))):
                ids = tokens.value[unpack(control, data, n)] if n else np.zeros(0, np.uint32)
                borders = np.cumsum([0, *lengths])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + at + borders[:-1], pa.int64()), pa.array(lengths, pa.int64()), _column(ids.astype("<u4"), borders)], ["id", "start", "n_tokens", "ids"])

    return blocks.join(shards, "shard").select("base", "at", "n", "docs", "lengths", "control", "data").mapInArrow(kernel, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def token_file_index(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Writes a file set to the shared scratch folder and reads it back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = scratch(docs.sparkSession)
    write_token_files(docs, folder, path, end)
    return read_token_files(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
