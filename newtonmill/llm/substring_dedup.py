"""Substring removal: passages of at least `length` words that an earlier document has too, by doubling of windows level by level.

Levels have windows of length, half of it, a quarter and so on, down to about LEAST words; windows repeated at one level
alone are extended to the next, until no candidates survive or `length` is reached. Not every short window is looked at:
each window of one level elects the window of half its length in it with the least hash, its anchor, so equal windows
elect equal anchors, and a candidate is a chain of anchors, one inside the other. The windows of `length` words of a
document that share a chain are a span, one in a dozen words or so; a span whose anchor no other document has is dropped
at that level. In the last step, from half the length to the whole, the spans of one anchor are extended together: a span
that an earlier document has word for word is settled without looking at its windows. Only at the edges of repeats, where
the spans of one anchor differ, are windows compared one by one. No longer windows are looked at, for a longer repeat
consists of windows of this length.

Every count is taken before a shuffle, so a passage that a third of all documents share is one row for each task.
"""

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import drop, save, small

U = np.uint64
#: Words of a window of the first level, at least.
LEAST = 13
RANGES = "array<struct<at:int,n:int,open:boolean,anchor:long>>"
WINDOWS = pa.list_(pa.struct([("anchor", pa.int64()), ("at", pa.int32()), ("hash", pa.int64())]))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value among the width values from each index on."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at, have = np.where(h[left] <= h[right], left, right), have + step
    return at


def levels(length: int) -> list[int]:
    """The window lengths below `length`, shortest first, each at least half of the next."""
    out = [-(-length // 2)]
    while -(-out[0] // 2) >= LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


def spans(docs: DataFrame, length: int) -> DataFrame:
    """(id, key, at, n, a0, a1, ..., span): n windows from word `at` on share a chain of anchors, a0 the hash of the shortest; span hashes their words and the last anchor's place. docs: (id, key, text)."""
    below = levels(length)
    half, names = below[-1], [f"a{k}" for k in range(len(below))]

    def kernel(batches):
        for batch in small(batches):
            words = W.scan(batch.column(2))
            hashes = [W.runs(words.hashes, n) for n in below]
            h, owner = hashes[-1], np.repeat(np.arange(len(words)), np.diff(words.first))
            width, total = length - half + 1, len(words.hashes) - length + 1
            if total < 1:
                continue
            anchor = _least(h, width)[:total]
            start = np.flatnonzero(owner[:total] == owner[length - 1 :])
            if not len(start):
                continue
            anchor = anchor[start]
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1)]))
            n = np.diff(np.concatenate([begin, [len(start)]]))
            s, a = start[begin], anchor[begin]
            end = s + n + length - 1
            whole = W.mix(h[s] + W.mix(h[np.minimum(s + half, end - half)] ^ U(1)) + W.mix(h[end - half] ^ U(2)) + (n * 4096 + a - s).astype(U) * U(0x9E3779B97F4A7C15))
            chain, inside = [h[a]], a
            for own, shorter, longer in zip(hashes[-2::-1], below[-2::-1], below[::-1]):
                inside = _least(own, longer - shorter + 1)[inside]
                chain.insert(0, own[inside])
            doc = pa.array(owner[s])
            at = (s - words.first[owner[s]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(doc), batch.column(1).take(doc), pa.array(at), pa.array(n, pa.int32()), *(pa.array(x.view(np.int64)) for x in chain), pa.array(whole.view(np.int64))],
                ["id", "key", "at", "n", *names, "span"],
            )

    return docs.where("id is not null").mapInArrow(kernel, f"id long, key long, at int, n int, {', '.join(f'{n} long' for n in names)}, span long")


def repeated_spans(found: DataFrame) -> DataFrame:
    """(id, key, at, n, anchor, span) of the spans whose anchors of every level stand in several documents, level by level."""
    chain = [c for c in found.columns if c[0] == "a" and c[1:].isdigit()]
    for name in chain:
        shared = save(found.groupBy(name).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(name))
        left = found.join(shared, name)
        found, before = save(left if name == chain[-1] else left.drop(name)), found
        for used in (before, shared):
            drop(used)
        if found.isEmpty():  # no candidates survive: longer windows cannot be repeated
            break
    return found.select("id", "key", "at", "n", F.col(chain[-1]).alias("anchor"), "span")


def _strip(docs: DataFrame, length: int) -> DataFrame:
    """Removes the words under closed ranges; docs: (id, key, text, ranges). A document with open ranges comes out with its text and their windows instead."""

    def kernel(batches):
        import hashlib

        for batch in small(batches):
            data, borders = W.text_bytes(batch.column(2))
            data, ranges = data.tobytes(), batch.column(3).to_pylist()
            n_words, n_removed, sha, text, windows = [], [], [], [], []
            for i, own in enumerate(ranges):
                body = data[borders[i] : borders[i + 1]]
                parts = body.split()
                kept = parts
                if own:
                    change = np.zeros(len(parts) + 1, np.int64)
                    for r in own:
                        if not r["open"]:
                            change[r["at"]] += 1
                            change[r["at"] + r["n"] + length - 1] -= 1
                    kept = list(compress(parts, (np.cumsum(change)[:-1] == 0).tolist()))
                n_words.append(len(parts))
                n_removed.append(len(parts) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                undecided = [r for r in own or () if r["open"]]
                if undecided:
                    h = W.runs(W.scan(pa.array([body.decode()])).hashes, length).view(np.int64)
                    windows.append([{"anchor": r["anchor"], "at": at, "hash": int(h[at])} for r in undecided for at in range(r["at"], r["at"] + r["n"])])
                text.append(body.decode() if undecided else None)
                if not undecided:
                    windows.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()), batch.column(3), pa.array(windows, WINDOWS)],
                ["id", "key", "n_words", "n_removed", "kept_sha256", "text", "ranges", "windows"],
            )

    return docs.select("id", "key", "text", "ranges").mapInArrow(kernel, f"id long, key long, n_words long, n_removed long, kept_sha256 string, text string, ranges {RANGES}, windows array<struct<anchor:long,at:int,hash:long>>")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of each row of docs.

    A word is removed where a window of `length` words covers it that also starts in a document with a smaller id;
    windows are judged on the input. kept_sha256 is of the kept words joined by one space, in UTF-8. A null text has
    no words. A row without an id loses nothing and takes nothing from others; rows that share an id do not remove
    each other's words. Other columns of docs are not looked at.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    candidates = repeated_spans(save(spans(rows, length)))
    kinds = save(candidates.groupBy("anchor", "span").agg(F.min("id").alias("first")))
    varied = save(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"))
    judged = candidates.join(kinds, ["anchor", "span"])
    settled = judged.where("id > first").select("id", "key", F.struct("at", "n", F.lit(False).alias("open"), F.lit(None).cast("long").alias("anchor")).alias("r"))
    undecided = judged.where("id = first").join(varied, "anchor").select("id", "key", F.struct("at", "n", F.lit(True).alias("open"), "anchor").alias("r"))
    # as many ranges as a document's own length allows; equal rows have equal ones, which count once
    ranges = settled.unionAll(undecided).groupBy("id", "key").agg(F.collect_set("r").alias("ranges"))
    stripped = save(_strip(rows.join(ranges, ["id", "key"], "left"), length))
    for used in (candidates, kinds, varied):
        drop(used)
    windows = stripped.select("id", "key", F.explode("windows").alias("w")).select("id", "key", "w.anchor", "w.at", "w.hash")
    early = save(windows.groupBy("anchor", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("anchor", "hash", "first"))
    covered = windows.join(early, ["anchor", "hash"]).where("id > first").distinct().groupBy("id", "key").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), F.lit(False).alias("open"), F.lit(None).cast("long").alias("anchor"))).alias("covered"))
    left = stripped.where("windows is not null").join(covered, ["id", "key"], "left")
    nothing = F.array().cast(RANGES)
    left = left.select("id", "key", "text", F.concat(F.filter("ranges", lambda r: ~r["open"]), F.coalesce("covered", nothing)).alias("ranges"))
    out = stripped.where("windows is null").unionByName(_strip(left, length))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
