"""Two readings of a document, one and two, and verdicts on where they differ: disputes, decisions, balance of sums, marks for review, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import normalise as N

SOURCES = ("agree", "one", "two", "corrected", "unknown")


def _same(a: str, b: str, kinds: list[str], strict: bool = False) -> Column:
    """Whether two columns are the same by the kind in column `kind`."""
    out = F.lit(None).cast("boolean")
    for kind in kinds:
        out = F.when(F.col("kind") == kind, N.same(kind, F.col(a), F.col(b), strict)).otherwise(out)
    return F.coalesce(out, N.same("text", F.col(a), F.col(b), strict))


def canonical(elements: DataFrame) -> DataFrame:
    """(doc, key, value): scalar fields of an external reading; an empty value falls back to the predicted one, what was not extracted is null, nameless ones go."""
    value = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("predicted_value"))
    return elements.where(F.coalesce(F.col("key"), F.lit("")) != "").select("doc", F.regexp_replace("key", r"^.*/", "").alias("key"), F.when(F.col("status") == "not_extracted", None).otherwise(value).alias("value"))


def disputed(own: DataFrame, other: DataFrame, flagged: DataFrame, kinds: list[str]) -> DataFrame:
    """(doc, key, kind, one, two, differs, hinted): values of `own` that differ from `other`'s, or that a rule flags."""
    both = own.withColumnRenamed("value", "one").join(other.select("doc", "key", F.col("value").alias("two")), ["doc", "key"], "left")
    hints = flagged.select("doc", "key").distinct().withColumn("hinted", F.lit(True))
    judged = both.join(hints, ["doc", "key"], "left").withColumns({"differs": ~_same("one", "two", kinds), "hinted": F.coalesce("hinted", F.lit(False))})
    return judged.where("differs or hinted")


def resolved(own: DataFrame, other: DataFrame, flagged: DataFrame, verdicts: DataFrame, fixes: DataFrame, kinds: list[str]) -> DataFrame:
    """(doc, key, value, source): the value of each field after the verdicts, and where it comes from.

    Undisputed values agree. Without a verdict the own value stays, from `unknown`. A corrected value that is the same as a
    reading's is that reading's. A value mended by rule (fixes: doc, key) is `corrected` unless the other reading was chosen.
    A document whose own values are all empty takes the other reading's without verdicts.
    """
    doubts = disputed(own, other, flagged, kinds).select("doc", "key", F.lit(True).alias("disputed"))
    both = own.withColumnRenamed("value", "one").join(other.select("doc", "key", F.col("value").alias("two")), ["doc", "key"], "left").join(doubts, ["doc", "key"], "left")
    empty = own.groupBy("doc").agg(F.min((F.coalesce("value", F.lit("")) == "")).alias("blank"))
    rows = both.join(empty, "doc").join(verdicts.select("doc", "key", F.col("source").alias("said"), F.col("value").alias("new")), ["doc", "key"], "left")
    rows = rows.join(fixes.select("doc", "key").distinct().withColumn("mended", F.lit(True)), ["doc", "key"], "left")
    as_one, as_other = _same("new", "one", kinds), _same("new", "two", kinds)
    source = (
        F.when(F.col("disputed").isNull(), "agree").when(F.col("blank"), "two").when(F.col("said").isNull(), "unknown").when(F.col("said").isin("one", "two"), F.col("said"))
        .when(as_one, "one").when(as_other, "two").otherwise("corrected")
    )
    chosen = rows.withColumn("source", source)
    value = F.when(F.col("source") == "two", F.col("two")).when(F.col("source") == "corrected", F.col("new")).otherwise(F.col("one"))
    last = F.when(F.col("mended") & F.col("source").isin("agree", "one", "unknown"), "corrected").otherwise(F.col("source"))
    return chosen.select("doc", "key", "kind", "one", "two", value.alias("value"), last.alias("source"))


def source_counts(chosen: DataFrame) -> DataFrame:
    """(doc, one column for each source): how many fields come from where."""
    return chosen.groupBy("doc").agg(*[F.count_if(F.col("source") == s).alias(s) for s in SOURCES])


def agreed_cells(corrected: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cells of corrected rows (own_c, other_c beside c) set back to what both readings agree on; rows that lack either stay."""
    both = F.col("has_own") & F.col("has_other")
    return corrected.withColumns({c: F.when(both & N.same(k, F.col(f"own_{c}"), F.col(f"other_{c}")), F.col(f"own_{c}")).otherwise(F.col(c)) for c, k in columns.items()})


def with_totals(body: DataFrame, totals: DataFrame) -> DataFrame:
    """Sum rows (doc, anchor, seq) back behind the body row (doc, seq) that they followed; without one they come first."""
    rows = body.withColumns({"at": F.col("seq"), "late": F.lit(0).cast("long")}).unionByName(totals.withColumns({"at": F.coalesce("anchor", F.lit(-1)), "late": F.col("seq") + 1}).drop("anchor"))
    return rows.select("*", F.row_number().over(_by("doc", "at", "late")).cast("long").alias("place")).drop("at", "late")


def _by(doc: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(doc).orderBy(*order)


def balanced(chosen: DataFrame, sums: dict[str, tuple[str, ...]], tolerance: int = 100) -> DataFrame:
    """The chosen amounts with readings swapped, one key after another, where that breaks fewer sums; never to an empty value.

    `sums` gives each sum's parts. Keys go in order of their names; each takes its own reading, then the other one, if the
    number of broken sums falls. It is a fold over a document's few amounts, in expressions.
    """
    keys = sorted({k for whole, parts in sums.items() for k in (whole, *parts)})
    amount = lambda c: N.money(N.present(F.col(c)))
    item = F.struct("key", amount("value").alias("v"), amount("one").alias("a"), amount("two").alias("b"), "source")
    docs = chosen.where(F.col("key").isin(*keys)).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("key", item))).alias("m"))
    pick = lambda k, x: f"m['{k}'].{x}"
    state = docs.select("doc", "m", *[F.expr(pick(k, "v")).alias(f"v_{i}") for i, k in enumerate(keys)], *[F.expr(f"coalesce({pick(k, 'source')}, 'none')").alias(f"s_{i}") for i, k in enumerate(keys)])

    def broken(value: dict[int, str]) -> str:
        tests = []
        for whole, parts in sums.items():
            at = lambda k: value.get(keys.index(k), f"v_{keys.index(k)}")
            read = " + ".join(f"if({at(p)} is null, 0, 1)" for p in parts)
            total = " + ".join(f"coalesce({at(p)}, 0)" for p in parts)
            tests.append(f"if({at(whole)} is not null and {read} >= 2 and abs({at(whole)} - ({total})) >= {tolerance}, 1, 0)")
        return " + ".join(tests)

    for i, k in enumerate(keys):
        for side, name in (("a", "one"), ("b", "two")):
            new = pick(k, side)
            better = f"not coalesce(moved, false) and s_{i} <> '{name}' and {new} is not null and not ({new} <=> v_{i}) and ({broken({i: new})}) < ({broken({})})"
            state = state.withColumn("moved", F.lit(False)) if side == "a" else state
            state = state.withColumn("go", F.expr(better)).withColumn(f"v_{i}", F.expr(f"if(go, {new}, v_{i})")).withColumn(f"s_{i}", F.expr(f"if(go, '{name}', s_{i})")).withColumn("moved", F.expr("moved or go"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"v_{i}").alias("value"), F.col(f"s_{i}").alias("source")) for i, k in enumerate(keys)]))
    return state.select("doc", each.alias("x")).select("doc", "x.*").where("source <> 'none'")


def review(cells: DataFrame, flags: DataFrame, kinds: list[str]) -> DataFrame:
    """The cells (doc, key, row, column, kind, one, two) with `review`: read differently, strictly, or named by a flag (doc, key, row, column; null is any)."""
    own = ["doc", "key", "row", "column"]
    hit = None
    # Each form of a flag is an equi-join of its own, so no cell is held against all flags of a document.
    for rows, columns in ((True, True), (True, False), (False, True), (False, False)):
        on = ["doc", "key", *(["row"] if rows else []), *(["column"] if columns else [])]
        of = flags.where((F.col("row").isNotNull() if rows else F.col("row").isNull()) & (F.col("column").isNotNull() if columns else F.col("column").isNull())).select(*on).distinct()
        found = cells.join(of, on, "left_semi").select(*own)
        hit = found if hit is None else hit.unionByName(found)
    marked = hit.distinct().withColumn("flagged", F.lit(True))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}")) for c in own]
    joined = cells.alias("c").join(marked.alias("f"), same[0] & same[1] & same[2] & same[3], "left").select("c.*", "f.flagged")
    return joined.withColumn("review", F.coalesce("flagged", F.lit(False)) | ~_same("one", "two", kinds, strict=True)).drop("flagged")


def review_counts(marked: DataFrame) -> DataFrame:
    """(doc, cells, review)."""
    return marked.groupBy("doc").agg(F.count(F.lit(1)).alias("cells"), F.count_if("review").alias("review"))
