"""Detection rules over header and item tables, reading comparison, and scoring, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_item_rules(orders: DataFrame, items: DataFrame) -> DataFrame:
    """(rule, n_flags): items dated before their header, and headers without items."""
    dated = items.select("l_orderkey", "l_shipdate").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    early = dated.where(F.to_date("l_shipdate") < F.to_date("o_orderdate")).agg(F.count(F.lit(1)).alias("n_flags")).select(F.lit("DATE.ORDER").alias("rule"), "n_flags")
    bare = orders.join(items.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return early.unionByName(bare.agg(F.count(F.lit(1)).alias("n_flags")).select(F.lit("MISSING.REQUIRED").alias("rule"), "n_flags"))


def sum_field(orders: DataFrame, items: DataFrame, tolerance: int = 100) -> DataFrame:
    """Headers whose total differs by `tolerance` or more from the sum of at least two items."""
    exact = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    sums = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(exact.alias("parts"), F.count("l_extendedprice").alias("n_parts")).where("n_parts >= 2")
    both = orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total")).join(sums, "o_orderkey")
    return both.where(F.abs(F.col("total") - F.col("parts")) >= tolerance).select("o_orderkey", F.col("total").cast("double").alias("total"), F.col("parts").cast("double").alias("parts"), "n_parts")


def disputes(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cells of two readings that disagree: (keys, column, own, other, kind); a row on one side only is missing or extra."""
    cells = lambda df, name: df.select(*keys, F.lit(True).alias(f"has_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    both = cells(left, "own").join(cells(right, "other"), keys, "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"own_{c}").cast("string").alias("own"), F.col(f"other_{c}").cast("string").alias("other")) for c in columns]))
    kind = F.when(F.col("has_own").isNull(), "extra").when(F.col("has_other").isNull(), "missing").otherwise("differs")
    return both.select(*keys, kind.alias("kind"), each.alias("c")).select(*keys, "kind", "c.*").where("not (own <=> other)")


def latest(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of each key's last event."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("n_events"))


#: Most items whose anchors the plan holds as a set.
ANCHORS = 20_000
_WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"


def exact_evidence(documents: DataFrame, needles: DataFrame, least_words: int = 3) -> DataFrame:
    """(doc_id, item_id) where a document holds an item's whole text; items of fewer words are left out.

    All words of an item but the first and the last stand between spaces in any text that holds it. Of these the run
    of up to four with the most characters is the item's anchor; a text is read once, its places are held against the
    set of anchors (or, where there are many, hash-joined to them), and only hits are compared with whole items.
    """
    gram = lambda g, w, at: f"xxhash64({', '.join(f'{w}[{at} + {k}]' for k in range(g))})"
    items = needles.select("item_id", "text").withColumn("w", F.expr(_WORDS)).where(F.size("w") >= least_words).withColumn("g", F.least(F.lit(4), F.size("w") - 2))
    items = items.withColumn("at", F.expr("array_max(transform(sequence(1, size(w) - 1 - g), i -> struct(length(array_join(slice(w, i + 1, g), '')) as n, i as i))).i"))
    hashed = "case g " + " ".join(f"when {g} then {gram(g, 'w', 'at')}" for g in range(1, 5)) + " end"
    items = items.select("item_id", F.col("text").alias("needle"), "g", F.expr(hashed).alias("h"))
    few = items.select("g", "h").limit(ANCHORS + 1).collect()
    sizes = sorted({r["g"] for r in few}) if len(few) <= ANCHORS else [1, 2, 3, 4]
    if not few:
        return documents.select("doc_id").limit(0).join(items.select("item_id").limit(0), F.lit(True))
    known = {g: ", ".join(sorted({f"{r['h']}L" for r in few if r["g"] == g})) for g in sizes}
    places = [f"transform(if(size(w) >= {g}, sequence(0, size(w) - {g}), array()), i -> {gram(g, 'w', 'i')})" for g in sizes]
    kept = [f"filter({p}, h -> h in ({known[g]}))" if len(few) <= ANCHORS else p for g, p in zip(sizes, places, strict=True)]
    hits = F.expr(f"array_distinct(flatten(transform(array({_WORDS}), w -> concat({', '.join(kept)}))))")
    if len(few) <= ANCHORS:
        found = documents.select("doc_id", "text", F.explode(hits).alias("h")).join(F.broadcast(items), "h")
        return found.where(F.contains("text", "needle")).select("doc_id", "item_id").distinct()
    pairs = documents.select("doc_id", F.explode(hits).alias("h")).join(items.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
    held = pairs.join(items.select("item_id", "needle"), "item_id").join(documents.select("doc_id", "text"), "doc_id")
    return held.where(F.contains("text", "needle")).select("doc_id", "item_id").distinct()


def score_grouping_sets(predictions: DataFrame, dimensions: list[str]) -> DataFrame:
    """Hits and totals for every single dimension and overall."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    return predictions.groupingSets(sets, *dimensions).agg(F.sum(F.expr("cast(label = prediction as int)")).alias("n_hit"), F.count(F.lit(1)).alias("n_total"))


def content_groups(documents: DataFrame) -> DataFrame:
    """Documents of equal content: the smallest id and the number of copies. Documents without text are copies of nothing."""
    return documents.where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
