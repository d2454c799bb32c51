"""Language identification by Bayesian evidence fusion.

The evidence of a row is its text, the language its markup declares, its address and its host. Text likelihoods come
from letter trigrams, counted on a bounded sample of labelled rows. The other parts are estimated from the rows at hand
by grouped aggregation of their text posteriors, so they need no labels: how often each declaration goes with each
language, and how the languages spread over hosts. A host's prior is smoothed towards that of its address suffix, that
one towards that of all rows; a host with few rows thus says little by itself.

Besides the sample's languages there is `und`, with letters in no order at all; it wins for gibberish, and a text
without letters is `und` without further question. A text whose letters make no trigram says nothing by itself and is
left to the other evidence.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import save, small

U = np.uint64
#: Labelled texts of the whole table in the sample, about, and of each label, about, at least, if it has them; labels at most.
SAMPLE, OF_LABEL, MOST = 3000, 200, 512
#: Hashed letter trigrams, and the count that each starts with, less for a label with fewer trigrams than bins.
BINS, START = 1 << 15, 0.2
#: Trigrams overlap and follow each other, so they count for less than independent ones.
WEIGHT = 1 / 3
#: Rows by which a prior counts for the level below it, and those that a declaration starts with.
STRENGTH, DECLARED = 20.0, 1.0
UNKNOWN = "und"
#: Prior of no language.
UNKNOWN_SHARE = 1e-3

_CLASS = np.zeros(256, np.uint32)  # 0: no letter
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:256] = np.arange(27, 155)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams of all texts that hold a letter, one after another, and the border of each text. What is no letter counts as a space."""
    data, offsets = W.text_bytes(column)
    c = _CLASS[data]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (c[:-2] * np.uint32(155) + c[1:-1]) * np.uint32(155) + c[2:]
    inside = code > 0
    for k in (1, 2):  # not across the border of two texts
        at = offsets[1:-1] - k
        inside[at[(at >= 0) & (at < len(inside))]] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    bins = (code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return bins.astype(np.int64), kept[np.minimum(offsets, len(inside))]


def fit(labelled: DataFrame, label_col: str, text_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log likelihoods by bin and language, from about `sample` distinct labelled texts, chosen by a hash of the text.

    A label has about OF_LABEL texts in the sample or more, or all of its own, so none is absent because it is rare. Equal
    texts count once however many rows hold them, and ids are not looked at, so repeated or absent ids change nothing.
    Rows without label or text are left out; without any labelled text the one language is `und`. More than MOST
    labels are refused, as the model has BINS values for each.
    """
    rows = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).where("label is not null and text is not null")
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    keys = save(rows.groupBy("label", "text_key").agg(F.count("*").alias("copies")))
    sizes = keys.groupBy("label").agg(F.count("*").alias("n"))
    found = sizes.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} labels in column {label_col}")
    total = sum(r.n for r in found) or 1
    wanted = {r.label: max(OF_LABEL, math.ceil(r.n * sample / total)) for r in found}
    # the hashes of distinct texts are spread evenly, so those under a label's bound are about as many as it needs, and nothing is put in order
    limits = labelled.sparkSession.createDataFrame([(r.label, int(min(1.0, (wanted[r.label] + 30) / r.n) * ((1 << 62) - 1))) for r in found], "label string, bound long")
    few = keys.select("label", "text_key").join(F.broadcast(limits), "label").where(F.shiftrightunsigned("text_key", 2) <= F.col("bound"))
    chosen = save(few.select("label", "text_key"))  # about sample + MOST * OF_LABEL rows at most
    picked = rows.join(F.broadcast(chosen), ["label", "text_key"]).groupBy("label", "text_key").agg(F.min("text").alias("text"))

    def kernel(batches):
        for batch in small(batches):
            labels = batch.column(0).to_pylist()
            bins, borders = trigrams(batch.column(1))
            for i, label in enumerate(labels):
                found = np.bincount(bins[borders[i] : borders[i + 1]], minlength=BINS)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], ["label", "bin", "n"])

    # at most BINS rows for each language
    counts = picked.select("label", "text").mapInArrow(kernel, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.label for r in counts})
    place = {label: k for k, label in enumerate(languages)}
    table = np.zeros((len(languages) + 1, BINS))
    for r in counts:
        table[place[r.label], r.bin] += r.n
    # the start counts of few trigrams would make a label as likely as `und` for letters in no order
    table += START * np.minimum(1.0, table.sum(axis=1, keepdims=True) / BINS)
    table[-1] = 1.0
    return [*languages, UNKNOWN], np.log(table / table.sum(axis=1, keepdims=True))


def text_scores(docs: DataFrame, languages: list[str], table: np.ndarray, *keep: Column) -> DataFrame:
    """The columns kept, n_trigrams (those with letters), scores (weighted log likelihoods by language) and by_text (posteriors by the text alone).

    docs: text in column `text`. Null and empty texts, and those without letters, have no trigrams, scores of 0 and the
    flat prior as posterior. Rows are handled one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)  # BINS values for each language
    kept = docs.select(*keep)
    columns = kept.columns
    flat = np.array([*[math.log((1 - UNKNOWN_SHARE) / max(1, len(languages) - 1))] * (len(languages) - 1), math.log(UNKNOWN_SHARE)])

    def kernel(batches):
        table = sent.value
        for batch in small(batches):
            bins, borders = trigrams(batch.column(len(columns)))
            n = np.diff(borders)
            sums = np.zeros((batch.num_rows, len(table)))
            if len(bins):
                filled = np.flatnonzero(n)
                for k, row in enumerate(table):
                    sums[filled, k] = np.add.reduceat(row[bins], borders[:-1][filled])
            sums *= WEIGHT
            told = np.exp(sums + flat - (sums + flat).max(axis=1, keepdims=True))
            told /= told.sum(axis=1, keepdims=True)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(table)), pa.int32()), pa.array(x.reshape(-1))) for x in (sums, told)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(n, pa.int64()), *lists], [*columns, "n_trigrams", "scores", "by_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*keep, F.col("text")).mapInArrow(kernel, f"{schema}, n_trigrams long, scores array<double>, by_text array<double>")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str, text_col: str, declared_col: str | None = None, suffix_col: str | None = None, host_col: str | None = None) -> DataFrame:
    """(id_col, language, probability, text_language, kept) of each row of docs.

    text_language is by the text alone, language by all evidence; kept says that it is not `und`. An absent, null
    or empty declaration, suffix or host is no evidence. Null texts and texts without letters are `und`; text_language is
    also where the letters make no trigram. A model without languages calls every row `und` and keeps those with letters,
    as it has nothing to reject them by. Rows are handled one by one, so repeated or null ids do no harm; other columns
    are not looked at.
    """
    languages, table = model
    n = len(languages)
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), some(declared_col).alias("declared"), some(suffix_col).alias("suffix"), some(host_col).alias("host"))
    heard = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("heard")
    scored = save(text_scores(rows, languages, table, *map(F.col, ("id", "declared", "suffix", "host")), heard))
    # a text without trigrams adds nothing, but its host is listed and so has its suffix's prior
    silent = F.array(*(F.lit(0.0) for _ in range(n)))
    told = scored.where("heard").select("declared", "suffix", "host", F.when(F.col("n_trigrams") > 0, F.col("by_text")).otherwise(silent).alias("p"))
    sums = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)]
    # posteriors are summed before the shuffle, so a host with a third of all rows is one row for each task
    by_host = save(told.groupBy("suffix", "host").agg(*sums))
    everyone = by_host.agg(*(F.sum(f"s{k}") for k in range(n))).first()
    base = np.array([x or 0.0 for x in everyone]) + 1 / n
    base = base / base.sum()
    mix = lambda own, above: [(own[k] + STRENGTH * above[k]) / (sum(own[1:], own[0]) + STRENGTH) for k in range(n)]
    level = by_host.where("suffix is not null").groupBy("suffix").agg(*(F.sum(f"s{k}").alias(f"u{k}") for k in range(n)))
    level = level.select("suffix", F.array(*mix([F.col(f"u{k}") for k in range(n)], [F.lit(float(x)) for x in base])).alias("above"))
    hosts = by_host.join(level, "suffix", "left").withColumn("above", F.coalesce("above", F.array(*(F.lit(float(x)) for x in base))))
    own = [F.when(F.col("host").isNull(), 0.0).otherwise(F.col(f"s{k}")) for k in range(n)]
    hosts = save(hosts.select(F.coalesce("suffix", F.lit("")).alias("suffix"), F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("unknown"), F.array(*mix(own, [F.col("above")[k] for k in range(n)])).alias("prior")))
    said = told.where("declared is not null").groupBy("declared").agg(*sums)
    said = save(said)
    whole = [x or 0.0 for x in said.agg(*(F.sum(f"s{k}") for k in range(n))).first()]
    said = said.select("declared", F.array(*((F.col(f"s{k}") + DECLARED * float(base[k])) / (whole[k] + DECLARED) for k in range(n))).alias("likely"))

    prior = F.coalesce("prior", F.array(*(F.lit(float(x)) for x in base)))
    likely = F.coalesce("likely", F.array(*(F.lit(1.0) for _ in range(n))))
    joined = scored.withColumns({"suffix_": F.coalesce("suffix", F.lit("")), "host_": F.coalesce("host", F.lit("")), "none_": F.col("host").isNull()})
    joined = joined.join(hosts.toDF("suffix_", "host_", "none_", "prior"), ["suffix_", "host_", "none_"], "left").join(said, "declared", "left")
    fused = F.array(*(F.col("scores")[k] + F.log(prior[k] + 1e-12) + F.log(likely[k] + 1e-12) for k in range(n)))
    names = F.array(*map(F.lit, languages))
    best = lambda p: names[F.array_position(p, F.array_max(p)).cast("int") - 1]
    out = joined.select("id", "heard", (F.col("n_trigrams") > 0).alias("spelt"), "by_text", fused.alias("fused"))
    top = F.array_max("fused")
    share = 1 / F.aggregate("fused", F.lit(0.0), lambda total, x: total + F.exp(x - top))
    told = lambda c, silent: F.when(F.col("heard"), c).otherwise(silent)
    out = out.select("id", "heard", told(best(F.col("fused")), UNKNOWN).alias("language"), F.round(told(share, 1.0), 6).alias("probability"), F.when(F.col("heard") & F.col("spelt"), best(F.col("by_text"))).otherwise(UNKNOWN).alias("text_language"))
    out = out.withColumn("kept", F.col("language") != UNKNOWN if n > 1 else F.col("heard"))
    return out.select(F.col("id").alias(id_col), "language", "probability", "text_language", "kept")


def page_parts(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, host) of raw web pages: visible text, declared markup language, address suffix and host.

    A null page has an empty text; what the markup does not declare or the address does not have is null. Rows are
    handled one by one, and other columns are not looked at.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[#\w]+;", " ")
    host = F.nullif(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))
    return pages.select("page_id", bare.alias("text"), declared.alias("declared"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), host.alias("host"))
