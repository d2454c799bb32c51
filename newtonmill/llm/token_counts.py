"""Token counts without token ids: pieces are counted once per distinct pre-token, joined to documents' frequencies and summed.

A pre-token's number of pieces does not depend on what stands around it. Texts are taken apart in blocks of bounded
size: a block has a list of its distinct pre-tokens, and for each document how often it has which of them, by their
places in the list. The lists of all blocks meet by pre-token, equal ones side by side, and each is counted once with
the library; the counts go back to the blocks by block and place, and each block sums frequencies times counts. What is
shuffled are the lists, which are far smaller than the texts as a block names each pre-token once, the counts and the
frequencies, both packed; nothing is broadcast, and no group is larger than a block.
"""

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import vocabulary_spec
from .store import save, small
from .token_files import pack, unpack

#: The pattern of the byte-level vocabulary's pre-tokens, white space being what Unicode calls so. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Two characters of white space in a row, as RE2 says it, or the mark below.
DOUBLE = r"[\s\x0b\x{85}\p{Z}]{2}|\x00"
#: Marks a text's first chunk, before which no space stands.
FIRST = "\0"
#: Bytes of text in a block, at least, unless a task has fewer.
BLOCK_BYTES = 16 << 20
#: Counted pre-tokens that are put in the order of their blocks at a time.
TOLD_ROWS = 1 << 18


class PreTokens:
    """Takes texts apart into the pre-tokens of one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import regex

        self.special = {t["content"] for t in vocabulary_spec(path, "byte")["added_tokens"]}
        names = "|".join(map(regex.escape, sorted(self.special)))
        self.of = regex.compile(PATTERN).findall
        self.split = regex.compile(f"({names})").split if names else lambda t: [t]
        self.apart = DOUBLE + f"|{names}" * bool(names)

    def whole(self, text: str) -> list[str]:
        """The pre-tokens of any text; the special strings in it are pre-tokens of their own."""
        return [w for part in self.split(text) for w in ([part] if part in self.special else self.of(part))]

    def chunk(self, c: str) -> list[str]:
        """The pre-tokens of a chunk between single spaces, with the space before it."""
        if c.isalpha():
            return [" " + c]
        return self.of(c[1:] if c[:1] == FIRST else c if c[:1] == "\n" else " " + c)

    def block(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pre-tokens of some texts, and for all occurrences the text and the pre-token's place in that list."""
        places: dict[str, int] = {}
        place = lambda w: places.setdefault(w, len(places))
        apart = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~apart & (pc.utf8_length(texts).to_numpy() > 0))
        # chunks between spaces are numbered first, so that only distinct ones are taken apart
        marked = pc.binary_join_element_wise(pa.scalar(FIRST), pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        own = lists.flatten().dictionary_encode()
        made = [[place(w) for w in self.chunk(c)] for c in own.dictionary.to_pylist()]
        length = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.int64, int(length.sum()))
        start = np.cumsum(length) - length
        chunks = own.indices.to_numpy()
        owner = np.repeat(plain, np.diff(lists.offsets.to_numpy()))
        n = length[chunks]
        ends = np.cumsum(n)
        codes = flat[np.repeat(start[chunks] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        rest = [(i, place(w)) for i in np.flatnonzero(apart).tolist() for w in self.whole(texts[i].as_py())]
        more = np.array(rest, np.int64).reshape(-1, 2)
        return list(places), np.concatenate([np.repeat(owner, n), more[:, 0]]), np.concatenate([codes, more[:, 1]])


_open: dict[str, PreTokens] = {}


def frequencies(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, n_bytes, n_pairs, codes, counts, pretokens): a block's documents, and packed for all of them the places of their distinct pre-tokens in the block's list and how often each occurs."""

    def kernel(batches):
        from pyspark import TaskContext

        if path not in _open:
            _open[path] = PreTokens(path)
        task, k, ids, held, size = TaskContext.get().partitionId() << 33, 0, [], [], 0

        def row():
            texts = pa.concat_arrays(held).fill_null("")
            names, owner, code = _open[path].block(texts)
            width = max(1, len(names))
            pairs, counts = np.unique(owner * width + code, return_counts=True)
            owner, code = pairs // width, pairs % width
            # places ascend within a document; its first is told whole, the others by their distance
            step = np.diff(code, prepend=0)
            new = np.diff(owner, prepend=-1) != 0
            step[new] = code[new]
            streams = [pa.array([_packed(x)], pa.binary()) for x in (step, counts - 1)]
            alone = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            n_pairs = pa.array(np.bincount(owner, minlength=len(texts)), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([task + k], pa.int64()), alone(pa.concat_arrays(ids)), alone(pc.binary_length(texts).cast(pa.int64())), alone(n_pairs), *streams, alone(pa.array(names, pa.string()))], ["block", "ids", "n_bytes", "n_pairs", "codes", "counts", "pretokens"])

        for batch in small(batches):
            ids.append(batch.column(0))
            held.append(batch.column(1))
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield row()
                k, ids, held, size = k + 1, [], [], 0
        if held:
            yield row()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(kernel, f"block long, ids array<{kind}>, n_bytes array<long>, n_pairs array<int>, codes binary, counts binary, pretokens array<string>")


def _packed(values: np.ndarray) -> bytes:
    """Integers in the byte-aligned code of token files, compressed where they are many."""
    control, data = pack(values)
    raw = len(values).to_bytes(8, "little") + control + data
    return b"\0" + raw if len(raw) < 1024 else b"\1" + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(stream: bytes) -> np.ndarray:
    raw = stream[1:] if stream[:1] == b"\0" else pa.decompress(stream[9:], int.from_bytes(stream[1:9], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    border = 8 + -(-n // 4)
    return unpack(raw[8:border], raw[border:], n).astype(np.int64)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(block, places, pieces) of rows (block, place, pretoken): each distinct pre-token is counted once, as equal ones follow each other; no ids leave the library. Places ascend, and both lists are packed."""

    def kernel(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        last, count, held, size = None, 0, [], 0

        def rows():
            block, place, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.lexsort((place, block))
            block, place, n = block[order], place[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = [*first[1:].tolist(), len(block)]
            streams = [[_packed(f(i, j)) for i, j in zip(first.tolist(), ends)] for f in (lambda i, j: np.diff(place[i:j], prepend=0), lambda i, j: n[i:j])]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), *(pa.array(x, pa.binary()) for x in streams)], ["block", "places", "pieces"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(2)
            new = np.ones(len(own), bool)
            new[1:] = pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)).to_numpy(zero_copy_only=False)
            new[0] = own[0].as_py() != last
            fresh = own.filter(pa.array(new)).to_pylist()
            found = np.array([count, *map(len, library.encode_batch_fast(fresh, add_special_tokens=False))], np.int64)
            last, count = own[-1].as_py(), int(found[-1])
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), found[np.cumsum(new)]))
            size += len(own)
            if size >= TOLD_ROWS:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    ordered = words.repartition("pretoken").sortWithinPartitions("pretoken")
    return ordered.select("block", "place", "pretoken").mapInArrow(kernel, "block long, places binary, pieces binary")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of each row: UTF-8 bytes and tokens of the whole text, and whether there are more than limit.

    Special strings inside texts count as the library takes them by default; null and empty texts have no tokens. Rows
    are never matched by their ids, so repeated or null ids do no harm, and other columns of docs are not looked at.
    path: a byte-level vocabulary file that every executor has; a file with other rules is refused.
    """

    def kernel(batches):
        for batch in small(batches, 16):
            for ids, sizes, n_pairs, codes, counts, told, width in zip(*(batch.column(k) for k in range(7))):
                pieces = np.zeros(width.as_py() + 1, np.int64)
                for x in told.as_py():
                    pieces[np.cumsum(_unpacked(x["places"]))] = _unpacked(x["pieces"])
                n = n_pairs.values.to_numpy().astype(np.int64)
                ends = np.cumsum(n)
                steps = np.cumsum(_unpacked(codes.as_py()))
                place = steps - np.repeat(np.concatenate([[0], steps])[ends - n], n)
                sums = np.concatenate([[0], np.cumsum(pieces[place] * (_unpacked(counts.as_py()) + 1))])
                total = sums[ends] - sums[ends - n]
                yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(total, pa.int64()), pa.array(total > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    blocks = save(frequencies(docs, path, id_col, text_col))
    words = blocks.select("block", F.posexplode("pretokens").alias("place", "pretoken"))
    told = piece_counts(words, path).groupBy("block").agg(F.collect_list(F.struct("places", "pieces")).alias("told"))
    rows = blocks.withColumn("width", F.size("pretokens")).drop("pretokens").join(told, "block", "left")
    nothing = F.array().cast("array<struct<places:binary,pieces:binary>>")
    rows = rows.select("ids", "n_bytes", "n_pairs", "codes", "counts", F.coalesce("told", nothing), "width")
    return rows.mapInArrow(kernel, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
