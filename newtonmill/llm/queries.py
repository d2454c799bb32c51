"""Queries of this subpackage, each over its whole tables with production parameters, and the SQL where it exists."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spotsigs import ANCHORS


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import near_by_signatures

    return near_by_signatures(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_index

    return token_file_index(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, "lang", "text"), "doc_id", "text", declared_col="lang", host_col="source")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify, page_parts

    model = fit(table(spark, sf_dir, "documents"), "lang", "text")
    return identify(page_parts(table(spark, sf_dir, "pages")), model, "page_id", "text", "declared", "suffix", "host")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import formatted_digest

    return formatted_digest(table(spark, sf_dir, "conversations"))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import records_digest

    return records_digest(table(spark, sf_dir, "conversations"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe": op3_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_spotsigs": op5_spotsigs,
    "spotsigs_classes": spotsigs_classes,
    "op6_token_files": op6_token_files,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "page_language": page_language,
    "op9_chat_format": op9_chat_format,
    "chat_layouts": chat_layouts,
    "op10_secret_scan": op10_secret_scan,
}

WORDS = "coalesce(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+'), CAST([] AS VARCHAR[]))"
FOLDED = WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
#: Runs of n words of a list w, as texts.
GRAMS = "unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' ')))"

CHAT = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations{more})
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(20 + length(replace(replace(replace(role || text, chr(92), 'xx'), '<', 'xx'), '[', 'xx')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

#: The common words of spot signatures, as a pattern.
COMMON = "(?:" + "|".join(ANCHORS) + ")"

ORACLE_SQL: dict[str, str] = {
    "spotsigs_classes": rf"""WITH RECURSIVE p AS (SELECT doc_id, text, ltrim(regexp_replace(' ' || regexp_replace(lower(coalesce(text, '')), '[\s\x0b[:punct:]]+', ' ', 'g') || ' ', ' +', ' ', 'g')) AS w FROM documents),
  c AS (SELECT doc_id, text, regexp_extract_all(ltrim(regexp_replace(' ' || w, ' (?:{COMMON} )+$', ' ')), '(?:{COMMON} )*[^ ]+ ') AS u FROM p),
  m AS (SELECT doc_id, text, list_distinct(list_concat(u, list_filter(list_transform(range(1, len(u)), lambda k: CASE WHEN instr(u[k], ' ') < length(u[k]) THEN u[k] || '|' || regexp_extract(u[k + 1], '[^ ]+ $') END), lambda x: x IS NOT NULL))) AS m FROM c),
  n AS (SELECT doc_id, CASE WHEN len(m) = 0 AND length(text) > 0 THEN [text] ELSE m END AS m FROM m), s AS (SELECT doc_id, unnest(m) AS m FROM n),
  o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.m = b.m AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100*i >= 75*(len(a.m) + len(b.m) - i)),
  r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), k AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
  SELECT n.doc_id, len(m)::BIGINT AS n_signatures, class_id FROM n JOIN k ON k.x = n.doc_id""",
    "op1_minhash_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, w, least(len(w), 5) AS n FROM (SELECT doc_id, {FOLDED} AS w FROM documents) t),
  s AS (SELECT DISTINCT doc_id, {GRAMS} AS s FROM d WHERE n > 0), c AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100*i >= 75*(a.c + b.c - i)),
  r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
  SELECT d.doc_id, coalesce(c.c, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.x = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op2_substring_dedup": f"""WITH d AS (SELECT doc_id, {WORDS.format(text="text")} AS w FROM documents),
  t AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
  f AS (SELECT h, min(doc_id) AS m FROM t GROUP BY h), g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM t JOIN f ON t.h = f.h WHERE m < doc_id),
  e AS (SELECT doc_id, k, w[k] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
  o AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.k) FILTER (g.k IS NULL) AS kept, count(g.k) AS n FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.k = e.k GROUP BY e.doc_id)
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op7_decontaminate": f"""WITH i AS (SELECT item_id, w, least(len(w), 5) AS n FROM (SELECT item_id, {FOLDED} AS w FROM benchmark) t), a AS (SELECT DISTINCT item_id, n, {GRAMS} AS s FROM i WHERE n > 0),
  d AS (SELECT doc_id, w, n FROM (SELECT doc_id, {FOLDED} AS w FROM documents) t, (SELECT DISTINCT n FROM i WHERE n > 0)), b AS (SELECT DISTINCT doc_id, n, {GRAMS} AS s FROM d WHERE len(w) >= n),
  c AS (SELECT item_id, count(*) AS n_item FROM a GROUP BY item_id), m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM a JOIN b ON a.n = b.n AND a.s = b.s GROUP BY ALL)
  SELECT doc_id, m.item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN c ON c.item_id = m.item_id WHERE 100*n_shared >= 75*n_item""",
    "op9_chat_format": CHAT.format(more=" UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'"),
    "chat_layouts": CHAT.format(more=""),
}
