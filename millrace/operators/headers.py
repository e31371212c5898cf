"""What the headers of parsed tables say: their cells, columns that a form has, and columns told by the products of their figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import normalise as N

#: Words of header cells, the words for the columns of a product, titles over several columns and the columns under them.
HEADER_WORDS = ("항목", "일자", "코드", "명칭", "단가", "횟수", "일수")
FACTORS = {2: ("횟수", "일수"), 3: ("투여량", "횟수", "일수")}
PRICE, TOTAL = "금액", "총액"
GROUPED = {"급여": (("급여", "요양급여"), ("본인부담", "공단부담", "전액본인")), "비급여": (("비급여",), ("선택진료",))}
_MERGED = (*HEADER_WORDS, *(w for titles, subs in GROUPED.values() for w in titles + subs))
_FIGURE = r"^\d[\d,]*(\.\d+)?$"
#: Rows of a header, least rows and share of a product that holds.
HEIGHT, LEAST, SHARE = 3, 3, 0.8


def _words(text: Column, known: tuple[str, ...]) -> Column:
    """The header words with which tokens of a text begin, distinct."""
    tokens = F.transform(F.split(F.trim(text), r"\s+"), N.label_key)
    return F.filter(F.array(*map(F.lit, known)), lambda w: F.exists(tokens, lambda t: F.startswith(t, w)))


def header_cells(tables: DataFrame) -> DataFrame:
    """(doc, cells): the cells, as label keys, of the header rows of a document's tables (doc, block, rows).

    In each table they are the three rows from the first with a cell that ends with 항목 on; where no table has one, from
    the first with three header words on. Cells in which several header words were merged are parted. A document
    without either has the words that the products of its figures tell, see `inferred`.
    """
    rows = tables.select("doc", "block", F.posexplode("rows").alias("r", "c"))
    whole = F.array_join(F.transform("c", lambda x: F.coalesce(x, F.lit(""))), " ")
    kinds = F.when(F.exists("c", lambda x: F.coalesce(F.endswith(N.label_key(x), F.lit("항목")), F.lit(False))), 0).when(F.size(_words(whole, HEADER_WORDS)) >= 3, 1)
    marked = rows.withColumn("kind", kinds)
    best = marked.groupBy("doc").agg(F.min("kind").alias("best")).where("best is not null")
    begin = marked.join(best, "doc").where("kind = best").groupBy("doc", "block").agg(F.min("r").alias("s"))
    cells = rows.join(begin, ["doc", "block"]).where(f"r >= s and r < s + {HEIGHT}").select("doc", F.explode("c").alias("cell")).where(F.trim("cell") != "")
    parts = F.when(F.size(_words(F.col("cell"), _MERGED)) >= 2, F.split(F.trim("cell"), r"\s+")).otherwise(F.array("cell"))
    named = cells.select("doc", F.explode(parts).alias("cell")).select("doc", N.label_key(F.col("cell")).alias("cell"))
    found = named.groupBy("doc").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    rest = tables.join(found.select("doc"), "doc", "left_anti")
    return found.unionByName(inferred(rest))


def inferred(tables: DataFrame) -> DataFrame:
    """(doc, cells): header words of the first neighbouring columns whose product is the next one, in three rows or more and eight tenths of all.

    Two factors behind the price are times and days, three a dose as well. Windows of columns are counted by grouped sums.
    """
    figures = F.transform("c", lambda x: F.when(F.trim(x).rlike(_FIGURE), F.translate(F.trim(x), ",", "").cast("double")))
    rows = tables.select("doc", "block", F.explode("rows").alias("c")).select("doc", "block", figures.alias("f"))
    spans = [
        rows.where(F.size("f") >= n + 2).select("doc", "block", F.lit(n).alias("n"), F.posexplode(F.expr(f"transform(sequence(0, size(f) - {n + 2}), i -> slice(f, i + 1, {n + 2}))")).alias("at", "x"))
        for n in FACTORS
    ]
    each = reduce(DataFrame.unionByName, spans).where(F.forall("x", lambda v: v.isNotNull())).withColumn("last", F.get("x", F.col("n") + 1)).where("last >= 10")
    product = F.expr("aggregate(slice(x, 1, n + 1), 1D, (a, v) -> a * v)")
    held = each.withColumn("hit", (F.abs(product - F.col("last")) <= F.greatest(F.lit(1.0), F.col("last") / 100)).cast("int"))
    sums = held.groupBy("doc", "block", "n", "at").agg(F.count(F.lit(1)).alias("k"), F.sum("hit").alias("hits")).where(f"k >= {LEAST} and hits >= {SHARE} * k")
    first = sums.groupBy("doc").agg(F.min_by("n", F.struct("block", "n", "at")).alias("n"))
    words = {n: F.array_sort(F.array(*map(F.lit, (PRICE, *w, TOTAL)))) for n, w in FACTORS.items()}
    return first.select("doc", F.when(F.col("n") == 2, words[2]).otherwise(words[3]).alias("cells"))


def has_header(cells: Column, words: tuple[str, ...]) -> Column:
    """Whether a form has one of the words; of a+b both must stand, in cells of their own."""

    def both(word: str) -> Column:
        parts = word.split("+")

        def alone(part: str) -> Column:
            others = [p for p in parts if p != part]
            return F.exists(cells, lambda c: reduce(lambda a, o: a & ~F.contains(c, F.lit(o)), others, F.contains(c, F.lit(part))))

        return reduce(lambda a, b: a & b, map(alone, parts))

    return reduce(lambda a, b: a | b, map(both, words))


def is_title(cells: Column, column: str) -> Column:
    """Whether a column's name is only a title over others; null where the header says nothing of it."""
    titles, subs = (reduce(lambda a, b: a | b, [F.exists(cells, _begins(w)) for w in words]) for words in GROUPED[column])
    return F.when(titles | subs, subs | ~titles)


def _begins(word: str):
    return lambda c: F.startswith(c, F.lit(word))
