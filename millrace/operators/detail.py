"""Rules over detailed item tables and header fields; each gives flags (rule, doc, row, column, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import normalise as N
from millrace.storage import through_table

FLAGS = "rule string, doc long, row long, column string, value string"
#: A section's title row.
SECTION_TITLE = r"^[0-9A-Z]{1,2}\s*\.\s*\S"
#: Columns that a title row leaves empty.
TITLE_EMPTY = ("own_code", "code", "code_name", "total")


def _flags(rule: str, rows: DataFrame, column: Column, row: Column | None = None, value: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return rows.select(F.lit(rule).alias("rule"), F.col("doc").cast("long").alias("doc"), (null if row is None else row).cast("long").alias("row"), column.cast("string").alias("column"), (null if value is None else value).cast("string").alias("value"))


def _money(c: str) -> Column:
    return N.money(N.present(F.col(c).cast("string")))


def _number(c: str) -> Column:
    return N.number_value(N.present(F.col(c).cast("string")))


def blank(value: Column) -> Column:
    """Whether a cell holds no text."""
    return N.normalize("text", value).isNull()


def from_identity_number(number: Column) -> tuple[Column, Column]:
    """(sex, birthday) that an identity number tells: its seventh digit gives the century and the sex."""
    normal = N.identity_number(N.present(number))
    mark = F.substring(normal, 8, 1)
    century = F.when(mark.isin(*"3478"), "20").when(mark.isin(*"1256"), "19")
    return F.when(mark.isin(*"135"), "남").when(mark.isin(*"246"), "여"), N.date(F.concat(century, F.substring(normal, 1, 6)))


def id_mismatch(fields: DataFrame) -> DataFrame:
    """ID.MISMATCH over (doc, idnum, sex, birthday): a printed sex or birthday that the identity number contradicts."""
    sex, birthday = from_identity_number(F.col("idnum"))
    wrong = lambda kind, c, v: F.when(v.isNotNull() & (F.col(c) != "") & ~N.same(kind, F.col(c), v), F.struct(F.lit(c).alias("c"), v.alias("v")))
    each = fields.select("doc", F.explode(F.array_compact(F.array(wrong("enum", "sex", sex), wrong("date", "birthday", birthday)))).alias("x"))
    return _flags("ID.MISMATCH", each, F.col("x.c"), value=F.col("x.v"))


def row_arithmetic(rows: DataFrame, tolerance: int = 100, least: int = 3) -> DataFrame:
    """DETAIL.ROW_ARITH over (doc, row, price, dose, times, days, total, own, fund, full_own, covered).

    The total is price x times x days, with the dose or without, within 1; a ratio (to two places) that `least` rows
    of the document are off by is right. Covered rows: own and fund shares and what is paid in full make the total.
    """
    price, total, dose = _money("price"), _money("total"), F.coalesce(F.nullif(_number("dose"), F.lit(0.0)), F.lit(1.0))
    base = price * _number("times") * _number("days")
    read = rows.select("doc", "row", price.alias("p"), total.alias("t"), base.alias("x"), (base * dose).alias("y"), _money("own").alias("o"), _money("fund").alias("f"), F.coalesce(_money("full_own"), F.lit(0)).alias("u"), "covered")
    read = through_table(read, "detail")
    off = read.where("p <> 0 and t <> 0 and x is not null and abs(t - x) > 1 and abs(t - y) > 1")
    ratios = off.select("doc", "row", F.explode_outer(F.expr("array_distinct(transform(filter(array(x, y), v -> v <> 0), v -> bround(t / v, 2)))")).alias("ratio"))
    common = ratios.groupBy("doc", "ratio").agg(F.countDistinct("row").alias("n")).where(F.col("n") >= least)
    right = ratios.join(common, ["doc", "ratio"], "left_semi").select("doc", "row").distinct()
    wrong = off.select("doc", "row").join(right, ["doc", "row"], "left_anti")
    shares = read.where(F.col("covered") & F.expr(f"t is not null and o is not null and f is not null and (o <> 0 or f <> 0) and abs(o + f + u - t) >= {tolerance}")).select("doc", "row")
    return _flags("DETAIL.ROW_ARITH", wrong.unionByName(shares), F.lit("total"), F.col("row"))


def low_quality(rows: DataFrame, wrong: DataFrame, unknown: DataFrame, least: int = 5) -> DataFrame:
    """DETAIL.LOW_QUALITY: documents of `least` rows, a quarter of them wrong, and over half wrong or over half of the codes unknown.

    `rows` has doc, row and code; `wrong` and `unknown` are flags of single rows.
    """
    per = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.col("code"), F.lit(""))).alias("codes"))
    bad = wrong.groupBy("doc").agg(F.countDistinct("row").alias("bad"))
    lost = unknown.groupBy("doc").agg(F.countDistinct("row").alias("lost"))
    both = per.join(bad, "doc").join(lost, "doc", "left").na.fill(0, ["lost"])
    return _flags("DETAIL.LOW_QUALITY", both.where(f"n >= {least} and 4 * bad >= n and (2 * bad > n or 2 * lost > codes)"), F.lit(None))


def item_class(rows: DataFrame) -> DataFrame:
    """DETAIL.ITEM_CLASS over (doc, row, name, class, covered, own, fund, full_own, uncovered): a class that is neither, with the one that the amounts tell.

    An empty value clears the cell (sum rows, rows without amounts); a null one leaves it to a reader.
    """
    paid = reduce(lambda a, b: a | b, [F.coalesce(_money(c) != 0, F.lit(False)) for c in ("covered", "own", "fund", "full_own")])
    free = F.coalesce(_money("uncovered") != 0, F.lit(False))
    guess = F.when(N.is_total(F.col("name")) | ~(paid | free), "").when(~free, "급여").when(~paid, "비급여")
    odd = rows.where((F.col("class") != "") & ~F.col("class").isin("급여", "비급여"))
    return _flags("DETAIL.ITEM_CLASS", odd, F.lit("class"), F.col("row"), guess)


def section_items(rows: DataFrame) -> DataFrame:
    """DETAIL.SECTION_ITEM over (doc, row, name, own_code, code, code_name, total): a name that copies its code's name, with the section's title above."""
    title = F.col("name").rlike(SECTION_TITLE) & reduce(lambda a, b: a & b, [blank(F.col(c)) for c in TITLE_EMPTY])
    frame = Window.partitionBy("doc").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("is_title", F.coalesce(title, F.lit(False)))
    marked = marked.withColumn("title", F.last(F.when(F.col("is_title"), F.col("name")), ignorenulls=True).over(frame))
    copied = N.label_key(F.col("name")) == N.label_key(F.coalesce(F.col("code_name"), F.lit("")))
    return _flags("DETAIL.SECTION_ITEM", marked.where(~F.col("is_title") & F.col("title").isNotNull() & (F.col("name") != "") & copied), F.lit("name"), F.col("row"), F.col("title"))


def ward(fields: DataFrame) -> DataFrame:
    """DETAIL.WARD over (doc, ward): the name of a department in the cell of a room."""
    return _flags("DETAIL.WARD", fields.where(F.col("ward").rlike(N.DEPARTMENT)), F.lit("ward"))


def empty_cells(pairs: DataFrame, columns: list[str], headers: DataFrame) -> DataFrame:
    """DETAIL.EMPTY_CELL over aligned rows (doc, pair, column and other_column cells): empty cells of printed columns (headers: doc, column) that the other reading has."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("own"), F.col(f"other_{c}").alias("value")) for c in columns]))
    lost = pairs.where("has_left and has_right").select("doc", "pair", cells.alias("x")).select("doc", "pair", "x.*").where(blank(F.col("own")) & ~blank(F.col("value")))
    return _flags("DETAIL.EMPTY_CELL", lost.join(headers, ["doc", "column"], "left_semi"), F.col("column"), F.col("pair"), F.col("value"))


def empty_columns(rows: DataFrame, columns: list[str], headers: DataFrame) -> DataFrame:
    """DETAIL.EMPTY_COLUMN: printed columns (headers: doc, column) that are empty in every row but the sums."""
    per = rows.where(~N.is_total(F.col("name"))).groupBy("doc").agg(*[F.count_if(~blank(F.col(c))).alias(c) for c in columns])
    return _flags("DETAIL.EMPTY_COLUMN", per.unpivot("doc", columns, "column", "n").where("n = 0").join(headers, ["doc", "column"], "left_semi"), F.col("column"))


def printed(value: Column, text: Column) -> Column:
    """Whether a number stands in a text by itself, marks of thousands aside."""
    plain = F.regexp_replace(text, r"(?<=\d)[,.](?=\d)", "")
    return F.coalesce(F.rlike(plain, F.concat(F.lit(r"(?<!\d)"), F.replace(value, F.lit("."), F.lit("")), F.lit(r"(?!\d)"))), F.lit(False))


def unprinted(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """GROUND.UNPRINTED over (doc, column, value) amounts and (doc, text): amounts that the document's text does not show."""
    amount = N.normalize("amount", F.col("value"))
    shown = fields.join(texts, "doc").where(_nonzero(amount) & ~printed(amount, F.col("text")))
    return _flags("GROUND.UNPRINTED", shown, F.col("column"), value=F.col("value"))


def _nonzero(amount: Column) -> Column:
    return F.coalesce(amount.cast("double") != 0, F.lit(False))


def field_sums(fields: DataFrame, parts: dict[str, tuple[str, ...]], tolerance: int = 100) -> DataFrame:
    """SUM.FIELD over (doc, and a column for each amount): sums, and their parts, where two parts or more were read and do not make the sum."""
    found = []
    for whole, of in parts.items():
        read = F.array_compact(F.array(*[_money(c) for c in of]))
        sums = fields.select("doc", _money(whole).alias("w"), read.alias("r"), F.array(F.lit(whole), *[F.when(_money(c).isNotNull(), F.lit(c)) for c in of]).alias("names"))
        off = sums.where("w is not null and size(r) >= 2").where(F.abs(F.col("w") - F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x)) >= tolerance)
        found.append(_flags("SUM.FIELD", off.select("doc", F.explode(F.array_compact("names")).alias("c")), F.col("c")))
    return reduce(DataFrame.unionByName, found)


def missing(fields: DataFrame, required: list[str], rows: DataFrame | None = None, conditions: dict[str, str] | None = None) -> DataFrame:
    """MISSING.REQUIRED: empty required fields, and cells that are empty although their companion column is filled."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in required]))
    found = _flags("MISSING.REQUIRED", fields.select("doc", cells.alias("x")).where(blank(F.col("x.v"))), F.col("x.c"))
    for column, when in (conditions or {}).items():
        found = found.unionByName(_flags("MISSING.REQUIRED", rows.where(~blank(F.col(when)) & blank(F.col(column))), F.lit(column), F.col("row")))
    return found
