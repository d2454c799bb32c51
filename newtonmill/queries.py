"""The queries over the driver's tables, each beside the SQL that DuckDB runs for the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions import vector as V
from .operators import compress as C
from .operators import matrix as M
from .operators import oracles as O
from .operators import partition as P
from .sources import svm
from .sources.synthetic import class_step

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The iterate, the regulariser and the number of clients of the fixed queries.
X, LAMBDA, CLIENTS = [0.1, -0.2, 0.3, -0.4, 0.05], 1e-3, 10
D = 5
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL if it has one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *keep: str) -> DataFrame:
    """Doubles rounded, -0.0 as 0.0."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


# --- samples from lineitem: five features, label R against the rest ------------------------------------------------


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features x0..x4, label and the key columns."""
    t = table(spark, sf_dir, "lineitem")
    features = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(1.0)]
    return t.select(*KEYS, *(f.alias(f"x{i}") for i, f in enumerate(features)), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("label"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features times the label, a0..a4."""
    t = lineitem(spark, sf_dir)
    return t.select(*KEYS, "label", *((F.col(f"x{i}") * F.col("label")).alias(f"a{i}") for i in range(D)))


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded samples with sample_id and client_id."""
    t = P.row_index(folded(spark, sf_dir), *KEYS)
    return P.assign_clients(t, CLIENTS, table(spark, sf_dir, "lineitem").count())


SQL_L = """L AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity/50 AS x0, l_extendedprice/1e5 AS x1, l_discount*10 AS x2, l_tax*10 AS x3, CAST(1 AS DOUBLE) AS x4,
  CAST(CASE WHEN l_returnflag='R' THEN 1 ELSE -1 END AS DOUBLE) AS label FROM lineitem)"""
SQL_A = SQL_L + """, A AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, x0*label AS a0, x1*label AS a1, x2*label AS a2, x3*label AS a3, x4*label AS a4 FROM L)"""
SQL_DEALT = SQL_A + f""", I AS (SELECT *, row_number() OVER (ORDER BY {", ".join(KEYS)}) - 1 AS sample_id FROM A), N AS (SELECT count(*) AS n FROM lineitem),
  T AS (SELECT I.*, CASE WHEN sample_id // (n // {CLIENTS}) < {CLIENTS} THEN CAST(sample_id // (n // {CLIENTS}) AS INT) END AS client_id FROM I, N)"""
SQL_M = " + ".join(f"a{i}*{x!r}::DOUBLE" for i, x in enumerate(X))
SQL_REG = repr(LAMBDA / 2 * sum(v * v for v in X)) + "::DOUBLE"
SQL_LOSS = "greatest(-m, 0::DOUBLE) + ln(1 + exp(-abs(m)))"
SQL_G = [f"avg(-(1 - s)*a{i}) + {LAMBDA * X[i]!r}::DOUBLE" for i in range(D)]
SQL_H = {(i, j): f"avg(s*(1 - s)*a{i}*a{j}) + {LAMBDA if i == j else 0.0!r}::DOUBLE" for i, j in O.pairs(D)}


def sql_ms(source: str, then: str) -> str:
    """WITH ... m and s beside the columns of A or T, and what follows."""
    return f"WITH {source}, Q AS (SELECT *, {SQL_M} AS m FROM {'T' if source is SQL_DEALT else 'A'}), R AS (SELECT *, 1/(1 + exp(-m)) AS s FROM Q) {then}"


# --- sparse text ---------------------------------------------------------------------------------------------------


def svm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line): orders as sparse text with 1-based indices; zero values are left out, so rows differ in length."""
    t = table(spark, sf_dir, "orders")
    digit = [F.pmod(F.floor(F.col("o_custkey") / 10**k), F.lit(10)) for k in range(4)]
    parts = [F.when(d > 0, F.concat(F.lit(f"{k + 1}:"), d.cast("string"))) for k, d in enumerate(digit)]
    return t.select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.when(F.col("o_orderstatus") == "F", "2").otherwise("1"), *parts).alias("line"))


SQL_LINES = "S AS (SELECT o_orderkey AS id, concat_ws(' ', CASE WHEN o_orderstatus='F' THEN '2' ELSE '1' END, " + ", ".join(f"CASE WHEN (o_custkey // {10**k}) % 10 > 0 THEN '{k + 1}:' || CAST((o_custkey // {10**k}) % 10 AS VARCHAR) END" for k in range(4)) + ") AS line FROM orders)"
SQL_PARSED = SQL_LINES + ", K AS (SELECT id, unnest(list_filter(string_split(line, ' '), lambda t: t <> '')) AS token FROM S), E AS (SELECT id, CAST(split_part(token, ':', 1) AS INT) AS i, CAST(split_part(token, ':', 2) AS DOUBLE) AS v FROM K WHERE contains(token, ':')), B AS (SELECT id, CAST(token AS DOUBLE) AS label FROM K WHERE NOT contains(token, ':'))"


@query(f"WITH {SQL_PARSED}, e1 AS (SELECT min(i) AS a, max(i) AS b, count(*) AS c FROM E), b1 AS (SELECT count(*) AS n, min(label) AS l, max(label) AS h, count(DISTINCT label) AS k FROM B) SELECT n AS samples, a AS min_index, b AS max_index, l AS min_label, h AS max_label, k AS labels, c AS pairs, k = 2 AS ok FROM e1, b1")
def dataset_profile(spark, sf_dir):
    return svm.profile(svm.parse(svm_lines(spark, sf_dir), "id"))


@query(f"WITH {SQL_PARSED}, g AS (SELECT min(i) AS a, max(i) AS b FROM E), m AS (SELECT (min(label) + max(label))/2 AS h FROM B), f AS (SELECT B.id, CAST(CASE WHEN label < h THEN -1 ELSE 1 END AS DOUBLE) AS label, CAST(unnest(range(b - a + 2)) AS INT) AS pos, a, b FROM B, g, m) SELECT f.id, label, pos, CASE WHEN pos = b - a + 1 THEN 1 ELSE coalesce(v, 0) END AS v FROM f LEFT JOIN E ON E.id = f.id AND E.i = f.pos + f.a")
def densify(spark, sf_dir):
    samples = svm.parse(svm_lines(spark, sf_dir), "id")
    p = svm.profile(samples).first()
    dense = svm.densify(samples, p.min_index, p.max_index, (p.min_label + p.max_label) / 2, intercept=True)
    return dense.select("id", "label", F.posexplode("features").alias("pos", "v"))


@query(f"WITH {SQL_LINES}, W AS (SELECT id, list_filter(string_split_regex(line, '[\\t :]'), lambda t: t <> '') AS ts FROM S) SELECT id, CAST(len(ts) AS INT) AS n, ts[1] AS first, ts[-1] AS last FROM W")
def token_split(spark, sf_dir):
    parts = S.tokens(F.col("line"), r"\t :")
    return svm_lines(spark, sf_dir).select("id", parts.alias("t")).select("id", F.size("t").alias("n"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))


@query(r"SELECT CAST(sum(len(regexp_extract_all(replace(text, chr(13), ''), '\n+'))) AS BIGINT) AS lines FROM documents")
def nonempty_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.sum(S.nonempty_lines(F.col("text"))).alias("lines"))


@query(f"WITH {SQL_PARSED} SELECT B.id, concat_ws(' ', CASE WHEN label < 1.5 THEN '-1' ELSE '+1' END, string_agg((i - 1) || ':' || CAST(CAST(v AS DOUBLE) AS VARCHAR), ' ' ORDER BY i)) || CASE WHEN count(i) = 0 THEN ' ' ELSE '' END AS line FROM B LEFT JOIN E ON B.id = E.id GROUP BY B.id, label")
def svm_text_export(spark, sf_dir):
    dense = svm.densify(svm.parse(svm_lines(spark, sf_dir), "id"), 1, 4, 1.5)
    return dense.select("id", svm.to_line(F.col("label"), F.col("features")).alias("line"))


# --- projections and partitions ------------------------------------------------------------------------------------


@query(f"WITH {SQL_A} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a0, 9) + 0.0::DOUBLE AS a0, round(a1, 9) + 0.0::DOUBLE AS a1, round(a2, 9) + 0.0::DOUBLE AS a2, round(a3, 9) + 0.0::DOUBLE AS a3, a4 FROM A")
def sign_fold(spark, sf_dir):
    return rounded(folded(spark, sf_dir).drop("label"), 9, "a4")


@query("SELECT o_orderkey, CASE WHEN label < avg_label THEN -1 ELSE 1 END AS label FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 ELSE 7 END AS label FROM orders), (SELECT (min(CASE o_orderstatus WHEN 'F' THEN 3 ELSE 7 END) + max(CASE o_orderstatus WHEN 'F' THEN 3 ELSE 7 END)) / 2 AS avg_label FROM orders)")
def label_remap(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 3).otherwise(7).alias("label"))
    span = t.agg(((F.min("label") + F.max("label")) / 2).alias("mid")).first()
    return t.select("o_orderkey", F.when(F.col("label") < span.mid, -1).otherwise(1).alias("label"))


@query(f"WITH {SQL_DEALT} SELECT client_id, count(*) AS n, CAST(sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN label > 0 THEN 0 ELSE 1 END) AS BIGINT) AS negative, round(100.0::DOUBLE*sum(CASE WHEN label > 0 THEN 1 ELSE 0 END)/count(*), 6) AS positive_percent FROM T WHERE client_id IS NOT NULL GROUP BY client_id")
def client_balance(spark, sf_dir):
    return P.class_balance(dealt(spark, sf_dir))


@query(f"WITH {SQL_DEALT}, P AS (SELECT sample_id, count(*) AS c FROM T WHERE client_id IS NOT NULL GROUP BY sample_id), C AS (SELECT (SELECT count(*) FROM P WHERE c > 1) AS twice, (SELECT count(*) FROM P WHERE sample_id NOT IN (SELECT unnest(range(n)) FROM N)) AS unknown, (SELECT count(*) FROM N, unnest(range(n)) r(k) WHERE k NOT IN (SELECT sample_id FROM P)) AS left_over) SELECT twice, unknown, left_over, twice = 0 AND unknown = 0 AND left_over = n % {CLIENTS} AS ok FROM C, N")
def split_check(spark, sf_dir):
    t = dealt(spark, sf_dir).select("sample_id", "client_id")
    n = table(spark, sf_dir, "lineitem").count()
    return P.check_split(t.select("sample_id"), t.where("client_id is not null"), n - n // CLIENTS * CLIENTS)


@query("SELECT id, CAST(unnest(range(3)) AS INT) AS pos, unnest([a, b, c]) AS v FROM (SELECT s_suppkey AS id, s_acctbal AS a, CAST(s_nationkey AS DOUBLE) AS b, 0.0::DOUBLE AS c FROM supplier UNION ALL SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE), CAST(c_custkey AS DOUBLE) FROM customer)")
def client_union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("features"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_acctbal", F.col("c_nationkey").cast("double"), F.col("c_custkey").cast("double")).alias("features"))
    return P.union_padded(s, c, width=3).select("id", F.posexplode("features").alias("pos", "v"))


@query(f"WITH {SQL_DEALT} SELECT client_id, count(*) AS n, round(avg(a1), 6) AS mean_a1 FROM T WHERE client_id IN (1, 4, 7) GROUP BY client_id")
def partial_participation(spark, sf_dir):
    chosen = spark.createDataFrame([(1,), (4,), (7,)], "client_id int")
    t = dealt(spark, sf_dir).join(chosen, "client_id", "left_semi")
    return t.groupBy("client_id").agg(F.count("*").alias("n"), F.round(F.avg("a1"), 6).alias("mean_a1"))


# --- oracles -------------------------------------------------------------------------------------------------------


@query(sql_ms(SQL_A, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m, 9) + 0.0::DOUBLE AS m FROM R"))
def margin(spark, sf_dir):
    return O.with_margin(folded(spark, sf_dir), D, X).select(*KEYS, (F.round("m", 9) + F.lit(0.0)).alias("m"))


@query(sql_ms(SQL_A, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(s, 6) AS s FROM R"))
def margin_sigmoid(spark, sf_dir):
    return O.with_margin(folded(spark, sf_dir), D, X).select(*KEYS, F.round("s", 6).alias("s"))


@query(sql_ms(SQL_A, f"SELECT round(avg({SQL_LOSS}) + {SQL_REG}, 8) AS f FROM R"))
def logistic_objective(spark, sf_dir):
    return O.evaluate(folded(spark, sf_dir), D, X, LAMBDA, second=False).select(F.round("f", 8).alias("f"))


@query(sql_ms(SQL_A, "SELECT CAST(unnest(range(5)) AS INT) AS i, round(unnest(g), 8) AS g FROM (SELECT [" + ", ".join(SQL_G) + "] AS g FROM R)"))
def logistic_gradient(spark, sf_dir):
    g = O.evaluate(folded(spark, sf_dir), D, X, LAMBDA, second=False).select(F.posexplode("g").alias("i", "g"))
    return g.select("i", F.round("g", 8).alias("g"))


@query(sql_ms(SQL_A, "SELECT CAST(unnest(range(15)) AS INT) AS pos, round(unnest(h), 8) AS h FROM (SELECT [" + ", ".join(SQL_H.values()) + "] AS h FROM R)"))
def logistic_hessian(spark, sf_dir):
    h = O.evaluate(folded(spark, sf_dir), D, X, LAMBDA).select(F.posexplode("h").alias("pos", "h"))
    return h.select("pos", F.round("h", 8).alias("h"))


@query(sql_ms(SQL_DEALT, f"SELECT client_id, count(*) AS n, round(avg({SQL_LOSS}) + {SQL_REG}, 8) AS f, round({SQL_G[0]}, 8) AS g0, round({SQL_G[4]}, 8) AS g4, round({SQL_H[0, 0]}, 8) AS h0, round({SQL_H[4, 4]}, 8) AS h14 FROM R WHERE client_id IS NOT NULL GROUP BY client_id"))
def client_oracles(spark, sf_dir):
    t = O.evaluate(dealt(spark, sf_dir).where("client_id is not null"), D, X, LAMBDA, ["client_id"])
    return t.select("client_id", "n", F.round("f", 8).alias("f"), F.round(F.col("g")[0], 8).alias("g0"), F.round(F.col("g")[4], 8).alias("g4"), F.round(F.col("h")[0], 8).alias("h0"), F.round(F.col("h")[14], 8).alias("h14"))


@query(sql_ms(SQL_DEALT, f", P AS (SELECT client_id, avg({SQL_LOSS}) + {SQL_REG} AS f, {SQL_G[0]} AS g0, {SQL_G[4]} AS g4, {SQL_H[4, 4]} AS h14 FROM R WHERE client_id IS NOT NULL GROUP BY client_id) SELECT count(*) AS clients, round(avg(f), 8) AS f, round(avg(g0), 8) AS g0, round(avg(g4), 8) AS g4, round(avg(h14), 8) AS h14 FROM P"))
def global_oracles(spark, sf_dir):
    t = O.evaluate(dealt(spark, sf_dir).where("client_id is not null"), D, X, LAMBDA, ["client_id"])
    mean = lambda c, name: F.round(F.avg(c), 8).alias(name)
    return t.agg(F.count("*").alias("clients"), mean("f", "f"), mean(F.col("g")[0], "g0"), mean(F.col("g")[4], "g4"), mean(F.col("h")[14], "h14"))


@query(sql_ms(SQL_A, f", P AS (SELECT {SQL_G[0]} AS g0, {SQL_G[1]} AS g1, {SQL_H[0, 0]} AS p, {SQL_H[0, 1]} AS q, {SQL_H[1, 1]} AS r FROM R) SELECT round((r*g0 - q*g1)/(p*r - q*q), 6) AS dx0, round((p*g1 - q*g0)/(p*r - q*q), 6) AS dx1 FROM P"))
def newton_step_2d(spark, sf_dir):
    t = O.evaluate(folded(spark, sf_dir), D, X, LAMBDA).select("g", "h")
    g, h = F.col("g"), F.col("h")
    det = h[0] * h[2] - h[1] * h[1]
    return t.select(F.round((h[2] * g[0] - h[1] * g[1]) / det, 6).alias("dx0"), F.round((h[0] * g[1] - h[1] * g[0]) / det, 6).alias("dx1"))


@query(sql_ms(SQL_A, "SELECT CAST(unnest(range(5)) AS INT) AS i, round(unnest(x), 8) AS x FROM (SELECT [" + ", ".join(f"{x!r}::DOUBLE - 0.5::DOUBLE*({g})" for x, g in zip(X, SQL_G)) + "] AS x FROM R)"))
def gd_step(spark, sf_dir):
    t = O.evaluate(folded(spark, sf_dir), D, X, LAMBDA, second=False)
    moved = F.array(*(F.lit(x) - 0.5 * F.col("g")[i] for i, x in enumerate(X)))
    return t.select(F.posexplode(moved).alias("i", "x")).select("i", F.round("x", 8).alias("x"))


#: Trial steps along a fixed direction.
DIRECTION, TRIALS = [0.2, 0.1, 0.0, -0.1, 0.3], [1.0, 0.5, 0.25, 0.125, 0.0625]


def trial(t: float) -> list[float]:
    return [x - t * d for x, d in zip(X, DIRECTION)]


@query(f"WITH {SQL_A} " + " UNION ALL ".join("SELECT {t!r}::DOUBLE AS t, round(avg(greatest(-m, 0::DOUBLE) + ln(1 + exp(-abs(m)))) + {r!r}::DOUBLE, 8) AS f FROM (SELECT {m} AS m FROM A)".format(t=t, r=LAMBDA / 2 * sum(v * v for v in trial(t)), m=" + ".join(f"a{i}*({x!r}::DOUBLE)" for i, x in enumerate(trial(t)))) for t in TRIALS))
def armijo_trials(spark, sf_dir):
    f = [(F.avg(O.loss(O.margin(D, trial(t)))) + F.lit(LAMBDA / 2 * sum(v * v for v in trial(t)))) for t in TRIALS]
    one = folded(spark, sf_dir).agg(F.array(*(F.struct(F.lit(t).alias("t"), F.round(x, 8).alias("f")) for t, x in zip(TRIALS, f))).alias("a"))
    return one.select(F.inline("a"))


@query(sql_ms(SQL_A, ", P AS (SELECT sqrt(" + " + ".join(f"({g})*({g})" for g in SQL_G) + f") AS g FROM R) SELECT round(g, 8) AS grad_norm, round(g*g/(2*{LAMBDA}::DOUBLE), 4) AS value_gap, round(g/{LAMBDA}::DOUBLE, 4) AS dist_bound, round(2*g*g/{LAMBDA}::DOUBLE, 4) AS legacy_distance_gap FROM P"))
def suboptimality(spark, sf_dir):
    t = O.evaluate(folded(spark, sf_dir), D, X, LAMBDA, second=False).select(V.norm(F.col("g")).alias("grad_norm"))
    return t.select(F.round("grad_norm", 8).alias("grad_norm"), *(F.round(c, 4).alias(k) for k, c in O.certificates(F.col("grad_norm"), LAMBDA).items()))


# --- compressors: entries (client_id, i, j, pos, v) from integer sums, so both engines sum exactly ------------------

SQL_ENTRIES = "N AS (SELECT CAST(l_suppkey % 4 AS INT) AS client_id, CAST(least(l_partkey % 8, l_orderkey % 8) AS INT) AS i, CAST(greatest(l_partkey % 8, l_orderkey % 8) AS INT) AS j, sum(l_quantity - 25) AS v FROM lineitem GROUP BY ALL), E AS (SELECT *, CAST(j*(j + 1)//2 + i AS BIGINT) AS pos FROM N)"
N_ENTRIES, K = 36, 9


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    p, o = F.pmod("l_partkey", F.lit(8)), F.pmod("l_orderkey", F.lit(8))
    t = t.groupBy(F.pmod("l_suppkey", F.lit(4)).cast("int").alias("client_id"), F.least(p, o).cast("int").alias("i"), F.greatest(p, o).cast("int").alias("j")).agg(F.sum(F.col("l_quantity") - 25).alias("v"))
    return t.withColumn("pos", M.position(F.col("i"), F.col("j")))


@query(f"WITH {SQL_ENTRIES} SELECT pos, round(0.25::DOUBLE*sum(v), 6) AS v FROM E GROUP BY pos")
def hessian_scatter_add(spark, sf_dir):
    return rounded(C.scatter_add(entries(spark, sf_dir), 0.25))


@query(f"WITH {SQL_ENTRIES} SELECT client_id, pos, v, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY abs(v) DESC, pos) AS r FROM E) WHERE r <= {K}")
def hessian_topk(spark, sf_dir):
    return C.top_k(entries(spark, sf_dir), K).select("client_id", "pos", "v", "rank")


@query(f"WITH {SQL_ENTRIES}, G AS (SELECT *, CASE WHEN i = j THEN v*v ELSE 2*v*v END AS energy FROM E) SELECT client_id, pos, CAST(row_number() OVER w AS INT) AS rank, round(sum(energy) OVER (w ROWS UNBOUNDED PRECEDING), 3) AS kept FROM G WINDOW w AS (PARTITION BY client_id ORDER BY abs(v) DESC, pos)")
def toplek_prefix(spark, sf_dir):
    return C.prefix_energy(entries(spark, sf_dir)).select("client_id", "pos", "rank", F.round("kept", 3).alias("kept"))


@query(f"WITH {SQL_ENTRIES}, G AS (SELECT *, CASE WHEN i = j THEN v*v ELSE 2*v*v END AS energy FROM E), H AS (SELECT *, row_number() OVER w AS r, sum(energy) OVER (w ROWS UNBOUNDED PRECEDING) AS kept, sum(energy) OVER (PARTITION BY client_id) AS whole FROM G WINDOW w AS (PARTITION BY client_id ORDER BY abs(v) DESC, pos)), J AS (SELECT *, min(CASE WHEN whole - kept <= (1 - 0.25::DOUBLE + 0.1::DOUBLE)*whole THEN r END) OVER (PARTITION BY client_id) AS e FROM H) SELECT client_id, pos, v, CAST(r AS INT) AS rank FROM J WHERE r <= least(coalesce(e, {K}), {K})")
def toplek(spark, sf_dir):
    """The deterministic core: the fewest entries within the bound. The kernel of the training rounds goes on to choose at random between that number and one less."""
    return C.top_lek(entries(spark, sf_dir), K, K / N_ENTRIES).select("client_id", "pos", "v", "rank")


@query(f"WITH {SQL_ENTRIES} SELECT client_id, pos, v*{N_ENTRIES / K!r}::DOUBLE AS v FROM E WHERE (pos - client_id*7 + {N_ENTRIES}) % {N_ENTRIES} < {K}")
def randseqk(spark, sf_dir):
    return C.rand_seq_k(entries(spark, sf_dir), K, N_ENTRIES, F.col("client_id") * 7).select("client_id", "pos", "v")


@query(f"WITH {SQL_ENTRIES} SELECT client_id, pos, v*{N_ENTRIES / K!r}::DOUBLE AS v FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY md5(concat_ws(':', '123', client_id, pos)), pos) AS r FROM E) WHERE r <= {K}")
def randk_md5(spark, sf_dir):
    return C.rand_k(entries(spark, sf_dir), K, N_ENTRIES, F.lit(123), F.col("client_id")).select("client_id", "pos", "v")


SQL_POW2 = "CASE WHEN v = 0 THEN 0::DOUBLE ELSE sign(v)*(CASE WHEN p > abs(v) THEN p/2 WHEN 2*p <= abs(v) THEN 2*p ELSE p END) END"


@query(f"WITH {SQL_ENTRIES}, Z AS (SELECT *, CASE WHEN v = 0 THEN 0::DOUBLE ELSE power(2::DOUBLE, floor(log2(abs(v)))) END AS p FROM E) SELECT client_id, pos, {SQL_POW2} AS v FROM Z")
def natural_compress(spark, sf_dir):
    return C.natural(entries(spark, sf_dir)).select("client_id", "pos", "v")


@query("SELECT CAST(k AS BIGINT) AS k, round(36.0::DOUBLE/k - 1, 9) AS omega, round(k/64.0::DOUBLE, 9) AS delta, round(k/36.0::DOUBLE, 9) AS delta_triangle, round(k/36.0::DOUBLE, 9) AS alpha_unbiased, round(1 - sqrt(1 - k/64.0::DOUBLE), 9) AS alpha_contractive FROM range(1, 37) t(k)")
def compressor_params(spark, sf_dir):
    k = F.col("id").cast("double")
    return spark.range(1, 37).select(F.col("id").alias("k"), F.round(36 / k - 1, 9).alias("omega"), F.round(k / 64, 9).alias("delta"), F.round(k / 36, 9).alias("delta_triangle"), F.round(1 / (36 / k - 1 + 1), 9).alias("alpha_unbiased"), F.round(1 - F.sqrt(1 - k / 64), 9).alias("alpha_contractive"))


@query(f"WITH {SQL_ENTRIES}, G AS (SELECT client_id, count(*) AS n, count(*) FILTER (v <> 0) AS nnz FROM E GROUP BY client_id) SELECT client_id, method, CASE method WHEN 'identical' THEN 64*n WHEN 'natural' THEN 12*n WHEN 'topk' THEN 96*{K} WHEN 'randk' THEN 64*{K} ELSE 64*{K} + 32 END AS bits FROM G, (SELECT unnest(['identical', 'natural', 'topk', 'randk', 'seqk']) AS method)")
def bit_cost(spark, sf_dir):
    g = entries(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("n")).withColumn("method", F.explode(F.array(*map(F.lit, ("identical", "natural", "topk", "randk", "seqk")))))
    m = F.col("method")
    bits = F.when(m == "identical", 64 * F.col("n")).when(m == "natural", 12 * F.col("n")).when(m == "topk", F.lit(96 * K)).when(m == "randk", F.lit(64 * K)).otherwise(F.lit(64 * K + 32))
    return g.select("client_id", "method", bits.cast("long").alias("bits"))


# --- rounds log: orders by month stand for rounds -------------------------------------------------------------------

SQL_ROUNDS = "G AS (SELECT CAST(year(o_orderdate)*12 + month(o_orderdate) AS BIGINT) AS round, count(*) AS n FROM orders GROUP BY 1)"


def rounds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("round")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_ROUNDS} SELECT round, CAST(sum(8*n) OVER w AS BIGINT) AS bytes_scalars, CAST(sum(4*n) OVER w AS BIGINT) AS bytes_indices, CAST(coalesce(sum(8*n) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_scalars_lagged FROM G WINDOW w AS (ORDER BY round ROWS UNBOUNDED PRECEDING)")
def comm_bytes(spark, sf_dir):
    from .sources.runs_log import cumulative_bytes

    scalars, indices = C.message_bytes(F.col("n"), F.col("n"))
    return cumulative_bytes(rounds_table(spark, sf_dir).select("round", scalars.alias("scalars"), indices.alias("indices")))


@query(f"WITH {SQL_ROUNDS} SELECT round, round(8.0::DOUBLE*(CAST(sum(12*n) OVER (ORDER BY round ROWS UNBOUNDED PRECEDING) AS DOUBLE))/{CLIENTS}, 6) AS bits_per_client FROM G")
def bits_per_client(spark, sf_dir):
    from .sources.runs_log import bits_per_client as per_client
    from .sources.runs_log import cumulative_bytes

    scalars, indices = C.message_bytes(F.col("n"), F.col("n"))
    t = cumulative_bytes(rounds_table(spark, sf_dir).select("round", scalars.alias("scalars"), indices.alias("indices")))
    return t.select("round", F.round(per_client(F.col("bytes_scalars"), F.col("bytes_indices"), CLIENTS), 6).alias("bits_per_client"))


# --- matrices in long form: integer sums of quantities over suppkey and partkey classes -----------------------------

SQL_MATRIX = "M AS (SELECT CAST(l_suppkey % 6 AS INT) AS i, CAST(l_partkey % 6 AS INT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), X AS (SELECT CAST(i AS INT) AS i, CAST(i + 1 AS DOUBLE) AS v FROM range(6) t(i))"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.pmod("l_suppkey", F.lit(6)).cast("int").alias("i"), F.pmod("l_partkey", F.lit(6)).cast("int").alias("j")).agg(F.sum("l_quantity").alias("v"))


def vector(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1).cast("double").alias("v"))


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(j*(j + 1)//2 + i AS BIGINT) AS pos FROM range(12) a(i), range(12) b(j) WHERE i <= j")
def upper_triangle(spark, sf_dir):
    return M.upper_triangle(spark.range(12).select(F.col("id").cast("int").alias("j")))


@query("SELECT p AS pos, CAST(p % 7 AS BIGINT) AS i, CAST(p // 7 AS BIGINT) AS j, CAST((p % 7)*7 + p // 7 AS BIGINT) AS transposed, p // 7 >= p % 7 AS is_upper FROM range(49) t(p)")
def flat_index(spark, sf_dir):
    i, j = F.pmod("id", F.lit(7)), F.floor(F.col("id") / 7)
    return spark.range(49).select(F.col("id").alias("pos"), i.alias("i"), j.alias("j"), M.flat(j, i, 7).alias("transposed"), (j >= i).alias("is_upper"))


@query(f"WITH {SQL_MATRIX}, U AS (SELECT least(i, j) AS p, greatest(i, j) AS q, sum(CASE WHEN i <= j THEN v ELSE 0 END) AS up, sum(CASE WHEN i >= j THEN v ELSE 0 END) AS low FROM M GROUP BY ALL) SELECT * FROM (SELECT max(i) = 0 AS is_row, max(j) = 0 AS is_column, max(i) = max(j) AS is_square, bool_and(i = j OR v = 0) AS is_diagonal, bool_and(abs(i - j) <= 1 OR v = 0) AS is_tridiagonal, bool_and(i <= j OR v = 0) AS is_upper, bool_and(i >= j OR v = 0) AS is_lower, bool_and(v = 0) AS is_zero FROM M), (SELECT bool_and(up = low) AS is_symmetric, bool_and(up + low = 0) AS is_skew FROM U)")
def matrix_predicates(spark, sf_dir):
    return M.predicates(matrix(spark, sf_dir))


@query(f"WITH {SQL_MATRIX} SELECT M.i, sum(M.v*X.v) AS v FROM M JOIN X ON X.i = M.j GROUP BY M.i")
def matvec_rel(spark, sf_dir):
    return M.matvec(matrix(spark, sf_dir), vector(spark))


@query(f"WITH {SQL_MATRIX} SELECT a.i, b.j, sum(a.v*b.v) AS v FROM M a JOIN M b ON a.j = b.i GROUP BY a.i, b.j")
def matmul_rel(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return M.matmul(m, m)


@query(f"WITH {SQL_MATRIX}, T AS (SELECT a.i, a.j, a.v - 2*b.v AS v FROM M a JOIN M b ON a.i = b.j AND a.j = b.i) SELECT T.i, T.j, (T.v + CASE WHEN T.i = T.j THEN 3 ELSE 0 END)*X.v AS v FROM T JOIN X ON X.i = T.i")
def matrix_algebra(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return M.scale_rows(M.add_to_diagonal(M.combine(m, M.transpose(m), -2.0), 3.0), vector(spark))


@query(f"WITH {SQL_MATRIX} SELECT a.i, b.i AS j, a.v*b.v AS v FROM X a, X b")
def outer_product(spark, sf_dir):
    return M.outer(vector(spark), vector(spark))


@query(f"WITH {SQL_MATRIX} SELECT round(sqrt(sum(CASE WHEN i = j THEN v*v ELSE 2*v*v END)), 6) AS frobenius FROM M WHERE i <= j")
def frobenius_sym(spark, sf_dir):
    return rounded(M.frobenius_upper(matrix(spark, sf_dir)))


@query(f"WITH {SQL_MATRIX} SELECT sum(CASE WHEN i = j THEN v ELSE 0 END) AS trace FROM M")
def trace(spark, sf_dir):
    return M.trace(matrix(spark, sf_dir))


@query(f"WITH {SQL_MATRIX}, G AS (SELECT i, sum(CASE WHEN i = j THEN abs(v) ELSE 0 END) AS own, sum(CASE WHEN i <> j THEN abs(v) ELSE 0 END) AS rest FROM M GROUP BY i) SELECT bool_and(own >= rest) AS dominant FROM G")
def diagonal_dominance(spark, sf_dir):
    return M.diagonally_dominant(matrix(spark, sf_dir))


@query(f"WITH {SQL_MATRIX}, O AS (SELECT M.i, sum(M.v*X.v) AS s FROM M JOIN X ON X.i = M.j WHERE M.i <> M.j GROUP BY M.i) SELECT X.i, round((X.v - s)/d.v, 9) AS v FROM X JOIN O ON O.i = X.i JOIN M d ON d.i = X.i AND d.j = X.i")
def jacobi_sweep(spark, sf_dir):
    return rounded(M.jacobi_sweep(matrix(spark, sf_dir), vector(spark), vector(spark)), 9)


@query(f"WITH {SQL_MATRIX} SELECT 0.5::DOUBLE*q + b + 7 AS value FROM (SELECT sum(M.v*a.v*c.v) AS q FROM M JOIN X a ON a.i = M.i JOIN X c ON c.i = M.j), (SELECT sum(v*v) AS b FROM X)")
def quadratic_oracle(spark, sf_dir):
    x = vector(spark)
    q = M.matvec(matrix(spark, sf_dir), x).join(x.select("i", F.col("v").alias("x")), "i")
    return q.agg((0.5 * F.sum(F.col("v") * F.col("x")) + F.sum(F.col("x") * F.col("x")) + 7).alias("value"))


@query(f"WITH {SQL_MATRIX} SELECT bool_and(v = 0) AS equal FROM (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM M UNION ALL SELECT j, i, -v FROM M) GROUP BY i, j)")
def matrix_equality(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return M.equal(m, M.transpose(m))


# --- vectors: embeddings --------------------------------------------------------------------------------------------

SQL_V = "V AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"), F.reverse(a).alias("b"))


A, B = F.col, F.col


@query(f"WITH {SQL_V} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda k: a[k]*b[k])), 9) AS d, round(list_sum(list_transform(range(5, 13), lambda k: a[k]*b[k])), 9) AS part FROM V")
def dot(spark, sf_dir):
    return rounded(vectors(spark, sf_dir).select("vec_id", V.dot(F.col("a"), F.col("b")).alias("d"), V.dot(F.col("a"), F.col("b"), 5, 8).alias("part")), 9)


@query(f"WITH {SQL_V} SELECT vec_id, round(list_sum(list_transform(a, lambda x: abs(x))), 8) AS l1, round(sqrt(list_sum(list_transform(a, lambda x: x*x))), 8) AS l2, round(list_sum(list_transform(a, lambda x: power(abs(x), 3))), 8) AS l3p, round(power(list_sum(list_transform(a, lambda x: power(abs(x), 3))), 1/3::DOUBLE), 8) AS l3, list_max(list_transform(a, lambda x: abs(x))) AS linf FROM V")
def vector_norms(spark, sf_dir):
    a = F.col("a")
    return rounded(vectors(spark, sf_dir).select("vec_id", V.norm(a, 1).alias("l1"), V.norm(a).alias("l2"), V.norm_power(a, 3).alias("l3p"), V.norm(a, 3).alias("l3"), V.norm(a, float("inf")).alias("linf")), 8, "linf")


@query(f"WITH {SQL_V} SELECT vec_id, CAST(k - 1 AS INT) AS pos, round(a[k] + 2*b[k], 9) + 0.0::DOUBLE AS axpy, round(a[k]*b[k], 9) + 0.0::DOUBLE AS prod, round(exp(a[k]), 9) AS e, round(1/(1 + exp(-a[k])), 9) AS s, CASE WHEN a[k] > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, round((1 - a[k])*0.5::DOUBLE, 9) + 0.0::DOUBLE AS sh FROM V, (SELECT unnest(range(1, 65)) AS k)")
def vector_ops(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    t = vectors(spark, sf_dir).select("vec_id", F.arrays_zip(V.add(a, b, 2.0).alias("axpy"), V.multiply(a, b).alias("prod"), V.each(a, "exp").alias("e"), V.each(a, "sigmoid").alias("s"), V.sign(a).alias("sg"), V.shifted(a, 1.0, 0.5).alias("sh")).alias("z"))
    t = t.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", "pos", "z.*")
    return rounded(t, 9, "sg")


@query(f"WITH {SQL_V} SELECT vec_id, CAST(k - 1 AS INT) AS pos, CASE WHEN abs(a[k]) <= 0.1::DOUBLE THEN 0 ELSE a[k] END AS v FROM V, (SELECT unnest(range(1, 65)) AS k)")
def zero_small(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(V.zero_small(F.col("a"), 0.1)).alias("pos", "v"))


@query(f"WITH {SQL_V} SELECT vec_id, CAST(k - 1 AS INT) AS pos, greatest(least(a[k], 0.2::DOUBLE), -0.1::DOUBLE) AS v FROM V, (SELECT unnest(range(1, 65)) AS k)")
def clamp(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(V.clamp(F.col("a"), -0.1, 0.2)).alias("pos", "v"))


@query(f"WITH {SQL_V} SELECT vec_id, CAST(len(list_filter(a, lambda x: abs(x) > 0.1::DOUBLE)) AS INT) AS nnz, list_max(a) AS largest, list_min(a) AS least, len(list_filter(a, lambda x: x <> 0)) = 0 AS is_null FROM V")
def nnz(spark, sf_dir):
    a = F.col("a")
    return vectors(spark, sf_dir).select("vec_id", V.nonzeros(V.zero_small(a, 0.1)).alias("nnz"), F.array_max(a).alias("largest"), F.array_min(a).alias("least"), V.is_zero(a).alias("is_null"))


@query(f"WITH {SQL_V} SELECT vec_id, CAST(k - 1 AS INT) AS pos, (a[9:16] || b[1:4])[k] AS v FROM V, (SELECT unnest(range(1, 13)) AS k)")
def vector_slices(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(F.concat(F.slice("a", 9, 8), F.slice("b", 1, 4))).alias("pos", "v"))


# --- statistics -----------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS largest, min(event_id) FILTER (value = lo) AS at_least, min(event_id) FILTER (value = hi) AS at_largest FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events) GROUP BY event_type")
def basic_stats(spark, sf_dir):
    from .operators.statistics import basic

    return rounded(basic(table(spark, sf_dir, "events"), "event_type", "value", "event_id"), 4, "least", "largest")


@query("SELECT event_type, round(avg(value), 6) AS mx, round(var_pop(value), 4) AS dx, round(stddev_pop(value), 6) AS sigma FROM events GROUP BY event_type")
def pop_stats(spark, sf_dir):
    from .operators.statistics import population

    t = population(table(spark, sf_dir, "events"), "event_type", "value")
    return t.select("event_type", F.round("mx", 6).alias("mx"), F.round("dx", 4).alias("dx"), F.round("sigma", 6).alias("sigma"))


@query("SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 3) AS cov, round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem GROUP BY l_returnflag")
def cov_corr(spark, sf_dir):
    from .operators.statistics import association

    t = association(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return t.select("l_returnflag", F.round("cov", 3).alias("cov"), F.round("corr", 8).alias("corr"))


@query("SELECT o_orderpriority, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 10")
def kth_smallest(spark, sf_dir):
    from .operators.statistics import kth

    return kth(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey", 10).select("o_orderpriority", F.col("o_totalprice").alias("value"))


# --- scalars --------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN r - 1200 < 0 THEN -1 ELSE 1 END AS sg, CAST(CASE WHEN r - floor(r) > 0.5 THEN floor(r) + 1 ELSE floor(r) END AS BIGINT) AS half_down, greatest(least(r, 1500::DOUBLE), 1000::DOUBLE) AS clamped, round(r + 0.25::DOUBLE*(p_size - r), 6) AS mixed, CAST(ceil(r/7.0::DOUBLE)*7 AS BIGINT) AS up, CAST(floor(r/7.0::DOUBLE)*7 AS BIGINT) AS down, CAST(length(CAST(p_partkey + 1 AS VARCHAR)) - 1 AS BIGINT) AS log10_floor, CAST(floor(log2(p_partkey + 1.0::DOUBLE) + 1e-12) AS BIGINT) AS log2_floor, p_size >= 2 AND len(list_filter(range(2, p_size), lambda d: p_size % d = 0)) = 0 AS prime, CAST((p_partkey % 97)*(p_partkey % 97)*(p_partkey % 97)*(p_partkey % 97)*(p_partkey % 97) % 97 AS BIGINT) AS power, CAST((p_size + 5) % 7 AS INT) AS added FROM (SELECT *, p_retailprice AS r FROM part)")
def scalar_math(spark, sf_dir):
    r, size, key = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.sign(r - 1200).alias("sg"), S.round_half_down(r).alias("half_down"), S.clamp(r, 1000.0, 1500.0).alias("clamped"), F.round(S.lerp(r, size, F.lit(0.25)), 6).alias("mixed"),
        S.multiple_up(r, 7).alias("up"), S.multiple_down(r, 7).alias("down"), S.log_floor(key + 1, 10).alias("log10_floor"), S.log_floor(key + 1, 2).alias("log2_floor"), S.is_prime(size).alias("prime"), S.power_mod(key, 5, 97).alias("power"), F.pmod(size + 5, F.lit(7)).alias("added"),
    )


@query("SELECT p_partkey, CAST((k & 255)*256 + ((k >> 8) & 255) AS BIGINT) AS swap16, CAST((k & 255)*16777216 + ((k >> 8) & 255)*65536 + ((k >> 16) & 255)*256 + ((k >> 24) & 255) AS BIGINT) AS swap32, CAST((k & 1) + 2*((k >> 1) & 1) + 4*((k >> 2) & 1) AS INT) AS low, CAST(k & 1 AS INT) AS bit0, CAST((k >> 3) & 1 AS INT) AS bit3 FROM (SELECT p_partkey, p_partkey % 65536 AS k FROM part)")
def bit_ops(spark, sf_dir):
    k = F.pmod("p_partkey", F.lit(65536))
    bits = S.low_bits(k, 4)
    return table(spark, sf_dir, "part").select("p_partkey", S.swap_bytes(k, 2).alias("swap16"), S.swap_bytes(k, 4).alias("swap32"), S.byte_of_bits([bits[0], bits[1], bits[2]]).alias("low"), bits[0].alias("bit0"), bits[3].alias("bit3"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN TRY_CAST(ltrim(t, '+') AS BIGINT) END AS whole, TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) AS number, '[1,' || c_custkey || ',' || c_nationkey || ']' AS shown, concat(c_mktsegment, '/', c_nationkey) AS joined FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '--' ELSE '+' END || c_custkey AS t FROM customer)")
def string_parse(spark, sf_dir):
    t = F.concat(F.when(F.col("c_custkey") % 3 == 0, "--").otherwise("+"), F.col("c_custkey").cast("string"))
    shown = S.array_text(F.array(F.lit(1).cast("long"), F.col("c_custkey"), F.col("c_nationkey").cast("long")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.parse_int(t).alias("whole"), S.parse_int(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("number"), shown.alias("shown"), F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("joined"))


@query("SELECT p_partkey, w AS longest FROM (SELECT p_partkey, w, row_number() OVER (PARTITION BY p_partkey ORDER BY length(w) DESC) AS r FROM part JOIN (SELECT DISTINCT substring(p_type, 1, k) AS w FROM part, (SELECT unnest([1, 3, 5, 8]) AS k) WHERE p_size < 10) ON starts_with(p_type, w)) WHERE r = 1")
def prefix_lookup(spark, sf_dir):
    from .operators.strings import longest_prefix

    part = table(spark, sf_dir, "part")
    words = part.where("p_size < 10").select(F.explode(F.array(*(F.substring("p_type", 1, k) for k in (1, 3, 5, 8)))).alias("key")).distinct()
    return longest_prefix(part.select("p_partkey", "p_type"), "p_type", words).select("p_partkey", F.col("key").alias("longest"))


@query(r"SELECT page_id, p AS path, regexp_extract(p, '([^/]*)$', 1) AS base, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(p, '\.([^./]*)$', 1) AS ext FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+:', '', ''), '/+', '/', 'g') AS p FROM pages)")
def path_parts(spark, sf_dir):
    p = S.normalized_path(F.regexp_replace("url", "^[a-z]+:", ""))
    t = table(spark, sf_dir, "pages").select("page_id", p.alias("path"))
    return t.select("page_id", "path", S.base_name(F.col("path")).alias("base"), S.folder(F.col("path")).alias("folder"), S.extension(F.col("path")).alias("ext"))


@query("WITH RECURSIVE G AS (SELECT s AS seed, 0 AS k, s AS v FROM (SELECT unnest([123, 124, 125])::BIGINT AS s) UNION ALL SELECT seed, k + 1, (v*214013 + 2531011) % 4294967296 FROM G WHERE k < 5) SELECT seed, CAST(k - 1 AS INT) AS pos, v FROM G WHERE k > 0")
def lcg_stream(spark, sf_dir):
    return spark.range(123, 126).select(F.col("id").alias("seed"), F.posexplode(S.lcg_stream(F.col("id"), 5)).alias("pos", "v"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def md5_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


#: The table of the reflected CRC-32 polynomial by its rule, and a fold over the bytes without the final inversion.
SQL_CRC = "WITH B AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)), H AS (SELECT p_partkey, hex(encode(concat_ws('/', p_name, p_brand, p_type))) AS x FROM part), Y AS (SELECT p_partkey, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2*i + 1, 2))::BIGINT) AS b FROM H) SELECT p_partkey, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])) AS crc FROM Y, B"


@query(SQL_CRC)
def crc_digest(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.crc32_open(F.concat_ws("/", "p_name", "p_brand", "p_type").cast("binary")).alias("crc"))


# --- training: rows without SQL ---------------------------------------------------------------------------------------


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client_id, features) from lineitem, folded and dealt to ten clients."""
    from .scratch import save

    t = dealt(spark, sf_dir).where("client_id is not null").select("client_id", F.array(*(f"a{i}" for i in range(D))).alias("features"))
    return save(t)


def embedding_set(spark: SparkSession, sf_dir: str, clients: int = 5) -> DataFrame:
    """(client_id, features) from embeddings: 64 numbers and an intercept, labels under 5 against the rest."""
    from .scratch import save

    t = table(spark, sf_dir, "embeddings")
    sign = F.when(F.col("label") < 5, 1.0).otherwise(-1.0)
    rows = t.select("vec_id", F.transform(F.array_append(F.col("embedding").cast("array<double>"), F.lit(1.0)), lambda v: v * sign).alias("features"))
    return save(P.assign_clients(P.row_index(rows, "vec_id"), clients, t.count()).where("client_id is not null").select("client_id", "features"))


def trained(samples: DataFrame, **config) -> DataFrame:
    """(round, grad_norm, f, x_norm, bytes_scalars, bytes_indices) of a training run."""
    from .plans.training import TrainConfig, train

    return train(samples, TrainConfig(lam=LAMBDA, **config)).rounds(samples.sparkSession).drop("seconds")


@query()
def newton_a(spark, sf_dir):
    return trained(training_set(spark, sf_dir), rounds=5, option="a", compressor="topk", k_mult=2.0)


@query()
def newton_b(spark, sf_dir):
    return trained(embedding_set(spark, sf_dir), rounds=5, option="b", compressor="topk")


@query()
def newton_natural(spark, sf_dir):
    return trained(embedding_set(spark, sf_dir), rounds=5, compressor="natural")


@query()
def newton_randk(spark, sf_dir):
    return trained(training_set(spark, sf_dir), rounds=5, compressor="randk", k_mult=2.0)


@query()
def newton_toplek(spark, sf_dir):
    return trained(training_set(spark, sf_dir), rounds=5, compressor="toplek", k_mult=2.0)


@query()
def newton_ls(spark, sf_dir):
    return trained(training_set(spark, sf_dir), rounds=5, compressor="seqk", k_mult=2.0, line_search=True, c=0.49)


@query()
def newton_pp(spark, sf_dir):
    return trained(training_set(spark, sf_dir), rounds=6, compressor="topk", k_mult=2.0, clients_per_round=4)


@query()
def gd_rounds(spark, sf_dir):
    return trained(training_set(spark, sf_dir), rounds=5, algorithm="gd")


@query()
def l_smooth(spark, sf_dir):
    from .plans.training import smoothness

    return spark.createDataFrame([(LAMBDA, smoothness(training_set(spark, sf_dir), LAMBDA))], "mu double, l double")


@query(f"WITH {SQL_A} SELECT CAST(unnest(range(15)) AS INT) AS pos, round(unnest(s), 4) AS v FROM (SELECT [" + ", ".join(f"sum(a{i}*a{j})" for i, j in O.pairs(D)) + "] AS s FROM A)")
def gram_matrix(spark, sf_dir):
    one = folded(spark, sf_dir).agg(F.array(*(F.sum(F.col(f"a{i}") * F.col(f"a{j}")) for i, j in O.pairs(D))).alias("s"))
    return one.select(F.posexplode("s").alias("pos", "v")).select("pos", F.round("v", 4).alias("v"))


@query()
def natural_pack_roundtrip(spark, sf_dir):
    """Values cut to sign and exponent, packed two in three bytes and unpacked."""
    from .plans.compressors import pack_pairs, power_of_two, unpack_pairs

    def kernel(frames):
        for frame in frames:
            cut = power_of_two(frame.v.to_numpy(float))
            yield frame.assign(packed=unpack_pairs(pack_pairs(cut), len(cut)), cut=cut)

    return C.natural(entries(spark, sf_dir)).select("client_id", "pos", "v").mapInPandas(kernel, "client_id int, pos long, v double, packed double, cut double")


@query()
def synthetic_federated(spark, sf_dir):
    from .sources.synthetic import federated

    t = federated(spark, clients=8, rows=50, d=6, seed=7)
    return t.groupBy("client_id").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("mean_label"))


@query(f"SELECT CASE WHEN (k*{class_step(1000, 5)} + 5) % 1000 < floor(1000*0.3::DOUBLE) THEN -1::DOUBLE ELSE 1::DOUBLE END AS label, count(*) AS n FROM range(1000) r(k) GROUP BY 1")
def synthetic_classes(spark, sf_dir):
    from .sources.synthetic import uniform_classes

    return uniform_classes(spark, samples=1000, d=4, seed=5, classes=[(-1.0, 0.3), (1.0, 0.7)]).groupBy("label").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds with a top-k compressor on the samples of lineitem."""
    return trained(training_set(spark, sf_dir), rounds=5, option="b", compressor="topk", k_mult=2.0)


@query("WITH p AS (SELECT c_nationkey AS k, CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y FROM customer), q AS (SELECT s_nationkey AS k, s_suppkey + 0.5::DOUBLE AS x FROM supplier), j AS (SELECT q.k, q.x, arg_max(p.y, p.x) FILTER (p.x <= q.x) AS ly, max(p.x) FILTER (p.x <= q.x) AS lx, arg_min(p.y, p.x) FILTER (p.x > q.x) AS hy, min(p.x) FILTER (p.x > q.x) AS hx FROM q JOIN p ON p.k = q.k GROUP BY q.k, q.x) SELECT k, x, round(CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL THEN ly ELSE ly + (hy - ly)*(x - lx)/(hx - lx) END, 6) AS y FROM j")
def interpolation(spark, sf_dir):
    from .operators.series import interpolate

    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    q = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") + 0.5).alias("x"))
    known = q.join(p.select("k").distinct(), "k", "left_semi")
    return rounded(interpolate(p, known, "k"))


@query("SELECT p_partkey, CAST(p_partkey % 11 AS INT) AS bucket, v*4 AS v FROM (SELECT p_partkey, p_retailprice AS v FROM part) WHERE p_partkey // 50 % 4 = 2")
def selection_bucket(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_partkey", F.lit(11)).cast("int").alias("bucket"), F.pmod("p_partkey", F.lit(200)).alias("pos"), F.col("p_retailprice").alias("v"))
    return C.bucket_of(t, 50, F.lit(2), 4).select("p_partkey", "bucket", "v")


@query(f"WITH {SQL_V} SELECT vec_id, CAST(k - 1 AS INT) AS pos, CASE WHEN a[k] = 0 THEN 0 ELSE sign(a[k])*CASE WHEN abs(a[k]) - p <= 2*p - abs(a[k]) THEN p ELSE 2*p END END AS v FROM (SELECT vec_id, a, k, CASE WHEN a[k] = 0 THEN 0::DOUBLE ELSE power(2::DOUBLE, floor(log2(abs(a[k])))) END AS p FROM V, (SELECT unnest(range(1, 65)) AS k))")
def biased_rounding(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode("a").alias("pos", "v")).select("vec_id", "pos", C.rounded(F.col("v"), 2.0).alias("v"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey")


@query("SELECT a.i, a.j, a.v - coalesce(b.v, 0) AS v FROM (SELECT CAST(l_suppkey % 6 AS INT) AS i, CAST(l_partkey % 6 AS INT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) a LEFT JOIN (SELECT CAST(l_partkey % 6 AS INT) AS i, CAST(l_suppkey % 6 AS INT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) b ON a.i = b.i AND a.j = b.j WHERE a.i <= a.j")
def upper_difference(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return M.upper_difference(m, M.transpose(m))


from . import queries_linear  # noqa: E402, F401  registers the rest
