import hashlib
import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from newtonmill.llm import secret_scan as S
from newtonmill.llm.queries import QUERIES

from . import cases
from .test_dedup import groups

SF = "/root/testdata/sf0.001"


def brute(docs, items):
    """Ids and texts that the stages keep, one document at a time."""
    docs = {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t or "")}
    group = groups(list(docs.items()))
    docs = {i: t for i, t in docs.items() if group[i] == i}
    out = {}
    for i, t in docs.items():
        have = cases.shingles(t)
        if not any(s and 100 * len(s & have) >= 75 * len(s) for s in items):
            out[i] = S.redacted(t, S.scanner().spans(t))
    return out


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [cases.shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(docs, items)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == set(want) and len(want) < len(docs)
    for i, t in want.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert found[i].ids == ids and found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_the_columns_and_awkward_rows(spark):
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in cases.rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("n_tokens").first())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_repeated_rows_and_shared_ids(spark):
    """Of equal rows one stays; a row is not lost because another with its id is a copy."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (2, long + " more"), (2, "quite another text that nothing else is near to"), (2, "quite another text that nothing else is near to"), (None, long), (None, long), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    key = lambda x: (x[0] or 0, x[1] or "")
    assert sorted(kept, key=key) == sorted([(1, long), (2, rows[3][1]), (None, long), (None, long), (3, ""), (3, ""), (4, None)], key=key)


def test_few_ids_lose_no_document(spark):
    rows = [(k % 3, f"the house of number {k} and the road to the town by the river of stones {k * k}", "en", "s", 1) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language(spark, docs, SF).count() == 3000


def test_the_session_keeps_its_settings(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for q in ("op6_token_files", "op8_language_id", "op2_substring_dedup", "op9_chat_format"):
        QUERIES[q](spark, SF).count()
        assert spark.conf.get(name) == before


def test_ten_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if re.match(r"op\d+_", n)} == set(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "benchmark", "secrets", "tokenize"]
