"""A dictionary of codes: names of a code, look-up by prefix, codes with misread digits, names with one misread character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import normalise as N

#: Least length of a cut-off code, length of drug codes (which are never cut), most characters to mend in a name.
LEAST, DRUG, EDITS = 5, 9, 1


def build(entries: DataFrame, order: str) -> DataFrame:
    """(system, code, names): the distinct names of every code, in the order in which they were first given."""
    keyed = entries.select("system", N.dictionary_key(F.col("code")).alias("code"), "name", order).where("code <> '' and name is not null")
    first = keyed.groupBy("system", "code", "name").agg(F.min(order).alias("at"))
    return first.groupBy("system", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))


def lookup(cells: DataFrame, dictionary: DataFrame, system: Column, code: str, cuts: tuple[str, ...] = ("EDI",)) -> DataFrame:
    """The cells with `known`, the longest form of their code that the dictionary has, and its `names`.

    Codes are compared without marks and in capitals. Only the systems in `cuts` may lose characters at the end,
    down to LEAST, and not where the code is DRUG digits. Candidates are hash-joined, so the dictionary is never
    scanned for a cell; cells that are not found keep nulls.
    """
    keyed = cells.withColumns({"__system": system, "__code": N.dictionary_key(F.col(code).cast("string"))})
    n = F.length("__code")
    whole = ~F.col("__system").isin(*cuts) | (n <= LEAST) | F.col("__code").rlike(rf"^\d{{{DRUG}}}$")
    forms = F.when(whole, F.array("__code")).otherwise(F.transform(F.sequence(F.lit(LEAST), F.greatest(n, F.lit(LEAST))), lambda k: F.substring(F.col("__code"), F.lit(1), k)))
    wanted = keyed.select("__system", "__code").distinct().where("__code <> ''").withColumn("known", F.explode(forms))
    names = dictionary.select(F.col("system").alias("__system"), F.col("code").alias("known"), "names")
    best = wanted.join(names, ["__system", "known"]).groupBy("__system", "__code").agg(F.max_by(F.struct("known", "names"), F.length("known")).alias("b"))
    return keyed.join(best, ["__system", "__code"], "left").select(*cells.columns, F.col("b.known").alias("known"), F.col("b.names").alias("names"))


def item_codes(cells: DataFrame, dictionary: DataFrame, code: str, system: str = "EDI") -> DataFrame:
    """The cells with `normal`, their item code: S and B are digits where only then the dictionary knows it, or knows it whole.

    A cut-off code that both readings begin with does not tell them apart, so it does not outweigh a whole one.
    """
    read, digits = N.item_code(N.present(F.col(code).cast("string")))
    both = cells.withColumns({"__a": read, "__b": digits})
    for form in ("__a", "__b"):
        whole = F.col("known") == N.dictionary_key(F.col(form))
        found = lookup(both.select(form).distinct(), dictionary, F.lit(system), form).where("known is not null").select(form, whole.alias(f"whole{form}"))
        both = both.join(found, form, "left")
    only = F.col("whole__b").isNotNull() & F.col("whole__a").isNull() | F.col("whole__b") & ~F.col("whole__a")
    normal = F.when((F.col("__a") != F.col("__b")) & only, F.col("__b")).otherwise(F.col("__a"))
    return both.select(*cells.columns, normal.alias("normal"))


def corrected_name(name: Column, names: Column) -> Column:
    """The printed name with its one misread character replaced, after the first dictionary name of equal length that differs in just that; else null.

    White space, marks and case do not count and stay as printed. Nothing is corrected where a dictionary name is equal.
    """
    letters = lambda v: F.filter(F.transform(F.split(v, ""), lambda c, i: F.struct(F.lower(c).alias("c"), c.alias("own"), i.alias("i"))), lambda x: x["c"].rlike(r"[\p{L}\p{N}]"))
    printed = letters(name)

    def apart(other: Column) -> Column:
        pairs = F.zip_with(printed, letters(other), lambda a, b: F.struct(a["i"].alias("i"), (~a["c"].eqNullSafe(b["c"])).alias("off"), b["own"].alias("new")))
        return F.when(F.size(printed) == F.size(letters(other)), F.filter(pairs, lambda x: x["off"]))

    diffs = F.transform(names, apart)
    hit = F.get(F.get(F.filter(diffs, lambda d: F.size(d) == EDITS), F.lit(0)), F.lit(0))
    mended = F.array_join(F.transform(F.split(name, ""), lambda c, i: F.when(i == hit["i"], hit["new"]).otherwise(c)), "")
    return F.when(hit.isNotNull() & ~F.coalesce(F.exists(diffs, lambda d: F.coalesce(F.size(d) == 0, F.lit(False))), F.lit(False)), mended)


def precedence(*sources: DataFrame) -> DataFrame:
    """The first of several dictionaries that has an entry."""
    return next((s for s in sources if not s.isEmpty()), sources[-1])
