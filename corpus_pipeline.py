"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of `documents`. run() writes each stage's result to the shared scratch folder and reads it again.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newtonmill.llm.bpe import bpe_encode
from newtonmill.llm.decontaminate import decontaminate
from newtonmill.llm.language_id import fit, identify
from newtonmill.llm.minhash_dedup import near_duplicates
from newtonmill.llm.queries import table, vocabulary
from newtonmill.llm.secret_scan import redact_secrets
from newtonmill.llm.store import save
from newtonmill.operators.partition import row_index


def _without(docs: DataFrame, rejected: DataFrame, *by: str) -> DataFrame:
    """docs without the rows rejected, nulls in `by` being equal; Spark broadcasts the rejected only if they are few."""
    rejected = save(rejected.select(*by).distinct()).toDF(*(f"rejected_{c}" for c in by))
    same = [F.col(c).eqNullSafe(F.col(f"rejected_{c}")) for c in by]
    return docs.join(rejected, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language; texts without letters, or with letters in no language's order, go. Where no row has a label, all rows with letters stay."""
    keyed = docs.withColumn("row_key", F.struct("doc_id", F.xxhash64("text").alias("text_key")))
    found = identify(keyed, fit(docs, "lang", "text"), "row_key", "text", declared_col="lang", host_col="source")
    marked = docs.withColumn("text_key", F.xxhash64("text"))
    return _without(marked, found.where("not kept").select("row_key.*"), "doc_id", "text_key").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Of equal rows that share an id, too, one stays; rows that share an id but not a text are judged apart. Rows without
    an id and empty ones are near to nothing and stay.
    """
    marked = docs.withColumn("text_key", F.xxhash64("text"))
    texts = save(marked.where("doc_id is not null and text <> ''").groupBy("doc_id", "text_key").agg(F.count("*").alias("copies")))
    by = ("doc_id",)
    if texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        rejected = near_duplicates(docs).where("not kept")
    else:  # ids that name several texts: each text gets a number of its own, in the order of the ids
        numbers = save(row_index(texts.select("doc_id", "text_key"), "doc_id", "text_key", name="number"))
        numbered = marked.join(numbers, ["doc_id", "text_key"]).select("number", "text")
        rejected, by = near_duplicates(numbered, id_col="number").where("not kept").select("number").join(numbers, "number"), ("doc_id", "text_key")
    left = _without(marked, rejected, *by)
    again = save(texts.where("copies > 1").select("doc_id", "text_key"))
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(again, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return left.join(again, ["doc_id", "text_key"], "left_anti").unionByName(once).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced and n_chars counted anew; a null text stays null and keeps its n_chars."""
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document; a null or empty text has no ids."""
    coded = bpe_encode(docs, vocabulary("word_bpe_49k.json"))
    said = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("tokenize", tokenize),
]

#: SQL cannot express MinHash components or BPE; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs)
    return docs
