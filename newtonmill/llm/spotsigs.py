"""Document fingerprints by spot signatures, in DataFrame functions alone.

An anchor is a common word or a run of them; the next two content words after it make a chain, and anchor and chain are
a spot signature. A text's fingerprint is its set of signatures, hashed: a change touches the signatures near it and no
others, and navigation or boilerplate, poor in common words, gives few. Each content word with its anchors is a member
too, in texts of every size, so that any two texts are compared by the same kinds of members, also lists without common
words; a text without words has its own hash.

Fingerprints are compared by the Jaccard similarity of their sets. A search for near duplicates first partitions the
sets by length: sets whose lengths differ by more than the threshold allows cannot match, and neither can sets that
share none of their rarest members. In what is left, most comparisons are spared, as every set meets the first of its
bucket before it meets others, and sets already joined need not meet.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import drop, save

#: Common words of the four languages. Fixed values.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les ou par pas pour que qui sur un une "
    "das dem den der die ein eine ist mit nicht sich und von zu auf für im "
    "como con del el es las los no para por se su y"
).split()
#: Ids in one bucket of neighbours, and buckets that one task puts in order.
NEIGHBOURS, ORDERED = 256, 1 << 16
#: Sets in one block of a bucket, each block of which meets each other.
BLOCK = 64
LOWEST = -(1 << 62)


def _alternatives(words: list[str]) -> str:
    """A pattern of the words, tried by their first letter."""
    letters = sorted({w[0] for w in words})
    tails = {c: sorted((w[1:] for w in set(words) if w[0] == c), key=len, reverse=True) for c in letters}
    return "|".join(f"{c}(?:{'|'.join(tails[c])})" for c in letters)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def signatures(text: Column) -> Column:
    """The sorted set of hashed spot signatures of a text; an empty or null text has none."""
    none = F.array().cast("array<long>")
    anchored = lambda u: F.instr(u, " ") < F.length(u)
    spot = lambda u, v: F.when(v.isNotNull() & anchored(u), F.xxhash64(u, F.substring_index(v, " ", -2)))
    spots = lambda units: F.array_compact(F.zip_with(units, F.slice(units, 2, F.greatest(F.size(units), F.lit(1))), spot))
    chosen = lambda units: F.array_sort(F.array_distinct(F.concat(spots(units), F.transform(units, lambda u: F.xxhash64(u)))))
    # a unit is a content word with the anchors before it; anchors at the end are no unit
    plain = F.concat(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+", " ")), F.lit(" "))
    units = F.regexp_extract_all(plain, F.lit(rf"\G(?:(?:{_alternatives(ANCHORS)}) )*+[^ ]+ "), F.lit(0))
    return _let(_let(units, chosen), lambda found: F.when((F.size(found) == 0) & (F.length(text) > 0), F.array(F.xxhash64(text))).otherwise(F.coalesce(found, none)))


def fingerprint(signatures: Column) -> Column:
    """A set of signatures as a string: base64 of its members, eight bytes each, in order. It is whole, so it grows with the text."""
    return F.base64(F.unhex(F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; of two empty sets 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _following(keys: DataFrame) -> DataFrame:
    """(key, next): the next greater key of each, null for the last. Many keys are ordered group by group."""
    if keys.limit(ORDERED + 1).count() <= ORDERED:
        return keys.withColumn("next", F.lead("key").over(Window.orderBy("key")))
    group = F.floor(F.col("key") / NEIGHBOURS)
    inside = keys.withColumn("group", group).withColumn("next", F.lead("key").over(Window.partitionBy("group").orderBy("key")))
    heads = keys.groupBy(group.alias("group")).agg(F.min("key").alias("head"))
    after = _following(save(heads.select(F.col("group").alias("key")))).toDF("group", "after").join(heads.toDF("after", "head"), "after").select("group", "head")
    return inside.join(after, "group", "left").select("key", F.coalesce("next", "head").alias("next"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, signatures, next_text, next_signatures): each row beside the next by id, the last beside the first.

    Ids are dealt out in buckets of neighbours; each bucket gets a copy of the next one's first row, so rows move once
    and no task orders the whole table. Rows without an id come first, rows that share an id are ordered by a hash of
    their texts, and those rows are dealt out by that hash, too, so they need not share a task. Of equal rows one is
    moved; all but the last of them are followed by their like.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    many = save(rows.groupBy("id", "tie").agg(F.count("*").alias("copies")).where("copies > 1"))
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if not many.isEmpty():
        known = rows.drop("copies").alias("r").join(many.alias("m"), F.expr("r.id <=> m.id and r.tie = m.tie"), "left").select("r.*", "m.copies")
        once = known.where("copies is not null").groupBy("id", "tie").agg(F.first("text").alias("text"), F.max("copies").alias("copies"))
        rows = known.where("copies is null").withColumn("copies", F.lit(1).cast("long")).unionByName(once)
    crowded = save(rows.groupBy("id").agg(F.count("*").alias("n")).where(f"n > {NEIGHBOURS}"))
    low = F.coalesce(F.floor(F.col("id") / NEIGHBOURS), F.lit(LOWEST))
    if crowded.isEmpty():
        rows = rows.withColumns({"bucket": low, "share": F.lit(0)})
    else:  # a crowded id has buckets of its own, one for each share of its hashes, and so have the ids behind it
        crowded = crowded.select(F.col("id").alias("crowd"), F.ceil(F.col("n") / NEIGHBOURS).alias("shares"), F.coalesce(F.floor(F.col("id") / NEIGHBOURS), F.lit(LOWEST)).alias("of"))
        spot = crowded.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("crowd", "shares"))).alias("crowds"))  # at most NEIGHBOURS ids
        rows = rows.withColumn("of", low).join(spot, "of", "left")
        before = F.coalesce(F.aggregate(F.filter("crowds", lambda c: c["crowd"] <= F.col("id")), F.lit(0).cast("long"), lambda n, c: n + 1), F.lit(0))
        own = F.get(F.filter("crowds", lambda c: c["crowd"].eqNullSafe(F.col("id"))), F.lit(0))["shares"]
        part = F.floor((F.col("tie") / 2.0**64 + 0.5) * own)
        rows = rows.withColumns({"bucket": F.col("of"), "share": F.coalesce(F.when(own.isNotNull(), F.shiftleft(before, 40) + F.least(part, own - 1)), F.shiftleft(before, 40) + F.lit((1 << 40) - 1) * F.when(before > 0, 1).otherwise(0))}).drop("of", "crowds")
    rows = rows.withColumn("deal", F.struct("bucket", "share"))
    firsts = save(rows.groupBy("deal").agg(F.min(F.struct("id", "tie")).alias("x")).select("deal", F.col("x.id").alias("id"), F.col("x.tie").alias("tie")))
    heads = rows.alias("r").join(firsts.alias("f"), F.expr("r.deal = f.deal and r.id <=> f.id and r.tie = f.tie")).select("r.deal", "r.text")
    order = save(_chain(firsts.select("deal")))
    copies = save(order.select(F.col("deal").alias("to"), F.col("next").alias("deal")).join(heads, "deal").select(F.col("to").alias("deal"), "text"))
    all_rows = rows.withColumn("extra", F.lit(0)).unionByName(copies.withColumn("extra", F.lit(1)), allowMissingColumns=True)
    signed = all_rows.repartition("deal").withColumn("signatures", signatures(F.col("text")))
    order = Window.partitionBy("deal").orderBy("extra", "id", "tie")
    beside = signed.withColumns({"next_text": F.lead("text").over(order), "next_signatures": F.lead("signatures").over(order)}).where("extra = 0")
    if many.isEmpty():
        return beside.select("id", "text", "signatures", "next_text", "next_signatures")
    again = beside.withColumn("last", F.explode(F.array_distinct(F.array(F.lit(True), F.col("copies") == 1))))
    again = again.withColumn("place", F.explode(F.when(F.col("last"), F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(2).cast("long"), "copies"))))
    pick = lambda own, after: F.when(F.col("last"), F.col(after)).otherwise(F.col(own)).alias(after)
    return again.select("id", "text", "signatures", pick("text", "next_text"), pick("signatures", "next_signatures"))


def _chain(deals: DataFrame) -> DataFrame:
    """(deal, next): the deal behind each, the first behind the last. The buckets are ordered by _following, the shares of one bucket by runs of ORDERED."""
    ends = save(deals.groupBy("deal.bucket").agg(F.min("deal.share").alias("first"), F.max("deal.share").alias("last")))
    order = save(_following(ends.select(F.col("bucket").alias("key"))))
    least = order.agg(F.min("key")).first()[0]
    after = order.select(F.col("key").alias("bucket"), F.coalesce("next", F.lit(least)).alias("to")).join(ends.select(F.col("bucket").alias("to"), F.struct(F.col("bucket"), F.col("first").alias("share")).alias("head")), "to")
    own = deals.select("deal", "deal.bucket", "deal.share", F.floor(F.col("deal.share") / ORDERED).alias("run"))
    runs = own.groupBy("bucket", "run").agg(F.min("deal").alias("begin")).withColumn("beyond", F.lead("begin").over(Window.partitionBy("bucket").orderBy("run"))).drop("begin")
    own = own.withColumn("inside", F.lead("deal").over(Window.partitionBy("bucket", "run").orderBy("share"))).join(runs, ["bucket", "run"])
    return own.join(after, "bucket").select("deal", F.coalesce("inside", "beyond", "head").alias("next"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    row's text. A null text is empty. An empty table gives no rows; other columns of docs are not looked at.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited)
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "signatures", "next_signatures", signatures(F.col("edited")).alias("edited_signatures"))
    own = F.col("signatures")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"), likeness(own, F.col("edited_signatures")).alias("near_edited"), likeness(own, F.col("next_signatures")).alias("near_next")
    )


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), signatures(F.col(text_col).cast("string")).alias("s")).withColumns({"set_a": F.xxhash64("s"), "set_b": F.xxhash64(F.lit(1), "s")})


def _buckets(nodes: DataFrame, share: float) -> DataFrame:
    """(bucket, node): sets alike by `share` meet in a bucket, of a partition of lengths and a member that is among the rarest of both.

    A partition's sets are at most 1 / share times as long as its shortest, so a set can only match its own and the two beside it."""
    nodes = nodes.select("node", F.floor(F.log(F.size("s")) / F.lit(-math.log(share)) + 1e-9).alias("part"), F.size("s").alias("n"), F.explode("s").alias("m"))
    often = nodes.groupBy("m").agg(F.count("*").alias("often")).where("often > 1")
    # members of one set alone are its rarest, and meet nothing
    shared = nodes.join(often, "m")
    alone = (F.col("n") - F.count("*").over(Window.partitionBy("node"))).alias("alone")
    ranked = shared.select("node", "part", "n", "m", alone, F.row_number().over(Window.partitionBy("node").orderBy("often", "m")).alias("rank"))
    rare = ranked.where(F.col("alone") + F.col("rank") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1)
    return rare.select(F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "m", "node", "n").select(F.xxhash64("part", "m").alias("bucket"), "node", "n")


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets have the Jaccard similarity; the sizes decide first where they can."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * both >= percent * (n + m - both))


def near_by_signatures(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_signatures, class_id) of each row of docs: class_id is the least id that links reach, itself included.

    Rows are linked where the Jaccard similarity of their signature sets is `percent` % at least. Equal sets are one
    node. A bucket's nodes first meet its least one; where it still holds several classes, its blocks of nodes meet, and
    only their links come out, never their pairs. A row without an id or with an empty set is linked with nothing; one
    without an id has no class. Rows that share an id are one node. Other columns of docs are not looked at.
    """
    signed = save(_sets(docs, id_col, text_col))
    nodes = save(signed.where("id is not null and size(s) > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("node"), F.first("s").alias("s")))
    buckets = save(_buckets(nodes, percent / 100))
    hubs = save(buckets.groupBy("bucket").agg(F.min(F.struct("n", "node")).alias("hub"), F.max(F.struct("n", "node")).alias("top")).where("hub.node <> top.node").select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    shared = save(buckets.join(hubs, "bucket"))
    met = save(shared.where(f"node <> hub and 100 * hub_n >= {percent} * n").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct())
    one, two = nodes.select(F.col("node").alias("a"), F.col("s").alias("sa")), nodes.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    links = save(met.join(one, "a").join(two, "b").where(_alike(F.col("sa"), F.col("sb"), percent)).select("a", "b"))
    joined = save(components(links))
    known = shared.join(joined, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("class"))
    open_ = save(known.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("x < y").select("bucket", "blocks"))
    rest = known.join(open_, "bucket").join(nodes.select("node", "s"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = save(rest.groupBy("bucket", "block").agg(F.collect_list(F.struct("node", "class", "s")).alias("x")))  # about BLOCK sets
    left, right = blocks.toDF("bucket", "lo", "left"), blocks.toDF("bucket", "hi", "right")
    fits = lambda p: lambda q: (p["node"] > q["node"]) & (p["class"] != q["class"]) & _alike(p["s"], q["s"], percent)
    found = F.flatten(F.transform("left", lambda p: F.transform(F.filter("right", fits(p)), lambda q: F.struct(p["node"].alias("a"), q["node"].alias("b")))))
    more = left.join(right, "bucket").select(F.explode(found).alias("l")).select("l.a", "l.b").distinct()
    joined = components(links.unionAll(save(more)))
    for used in (buckets, shared, met, blocks):
        drop(used)
    ids = nodes.join(joined, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("c"))
    out = signed.join(ids, ["set_a", "set_b"], "left")
    return out.select(F.col("id").alias(id_col), F.size("s").cast("long").alias("n_signatures"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("class_id"))
