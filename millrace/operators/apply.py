"""Steps that put an extracted document into its usual form: labels that slipped in, mixed cells, sums, dependent fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import normalise as N
from millrace.operators import dictionary as M

#: Markup and choice marks in a cell, codes and dates within names, rooms.
_MARKUP = r"(?i)</?(?:t[dhr]|table|br|p)\b"
_CHOICE = r"[\[(][^\]\)]{0,3}[\])]|[□☐■▣☑✔√●○]"
CODE_IN_TEXT = r"[(\[{]?\s*[A-Za-z]\d{2,5}(?:\.\d{1,2})?\s*[)\]}]?"
ROOM = r"^(?=.*\d)[A-Za-z0-9/:\-]+호?$"


def is_label(value: Column, words: tuple[str, ...]) -> Column:
    """Whether a cell is a form's own text: markup, several choice marks, or nothing but label words.

    Words are peeled off the front, the longest first, after an item number; what is peeled to the end is a label.
    """
    keys = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    known = F.array(*map(F.lit, keys))
    rest = F.regexp_replace(N.label_key(value), r"^\d{1,2}(?=\D)", "")

    def peel(state: Column, _: Column) -> Column:
        first = F.get(F.filter(known, lambda w: F.startswith(state, w)), F.lit(0))
        return F.when(first.isNull() | (state == ""), state).otherwise(F.substring(state, F.length(first) + 1, F.length(state)))

    peeled = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(rest), F.lit(1))), rest, peel)
    marks = F.size(F.regexp_extract_all(F.regexp_replace(value, "●{2,}", ""), F.lit(_CHOICE), F.lit(0)))
    return value.rlike(_MARKUP) | (marks > 1) | (peeled == "")


def without_hollow_rows(rows: DataFrame, columns: list[str], words: tuple[str, ...]) -> DataFrame:
    """Rows that hold a value; empty cells, zeros and label text are none."""
    value = lambda c: F.coalesce((F.col(c) != "0") & ~is_label(F.col(c), words), F.lit(False))
    return rows.where(reduce(lambda a, b: a | b, map(value, columns)))


def normalised(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Every column in the normal form of its kind."""
    return rows.withColumns({c: N.normalize(k, F.col(c)) for c, k in kinds.items()})


def split_codes(rows: DataFrame, name: str, code: str) -> DataFrame:
    """A disease code printed within a name goes to an empty code cell and out of the name."""
    found = F.coalesce(F.nullif(F.col(code), F.lit("")), N.normalize("code", F.col(name)))
    return rows.withColumns({code: found, name: N.normalize("text", F.regexp_replace(F.col(name), CODE_IN_TEXT, " "))})


def split_dates(rows: DataFrame, name: str, day: str) -> DataFrame:
    """A date printed within a name goes to an empty date cell and out of the name; names without dates stay."""
    dated = N.date(F.col(name)).isNotNull()
    bare = N.normalize("text", F.regexp_replace(F.col(name), N._DATE, " "))
    return rows.withColumns({day: F.when(dated, F.coalesce(F.nullif(F.col(day), F.lit("")), N.date(F.col(name)))).otherwise(F.col(day)), name: F.when(dated, bare).otherwise(F.col(name))})


def total_fields(rows: DataFrame, fields: DataFrame, mapping: dict[str, str], tolerance: int = 100) -> DataFrame:
    """(doc, field, value): the fields after the sum row (name 합계) has filled them.

    An empty field takes the sum row's amount; a filled one only where the other rows add up to the sum row and the
    field is off. `fields` has doc, field and value, `rows` doc, row, name and the columns of `mapping`.
    """
    amount = lambda c: N.money(N.present(F.col(c).cast("string")))
    named = N.label_key(F.col("name"))
    stated = [F.max_by(F.col(c).cast("string"), F.when(named == "합계", F.col("row"))).alias(f"s_{i}") for i, c in enumerate(mapping)]
    added = [F.coalesce(F.sum(F.when(~N.is_total(F.col("name")), amount(c))), F.lit(0)).alias(f"a_{i}") for i, c in enumerate(mapping)]
    sums = rows.groupBy("doc").agg(*stated, *added)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"s_{i}").alias("stated"), F.col(f"a_{i}").alias("added")) for i, f in enumerate(mapping.values())]))
    both = fields.join(sums.select("doc", each.alias("x")).select("doc", "x.*"), ["doc", "field"], "left")
    value, now = amount("stated"), amount("value")
    take = (value != 0) & ((F.coalesce(F.col("value"), F.lit("")) == "") | ((F.abs(value - F.col("added")) < tolerance) & (F.abs(F.coalesce(now, F.lit(0)) - value) >= tolerance)))
    return both.select("doc", "field", F.when(take, F.col("stated")).otherwise(F.col("value")).alias("value"))


def period(fields: DataFrame, rows: DataFrame, begin: str, end: str) -> DataFrame:
    """Empty first and last days of `fields` from the earliest and latest of the rows."""
    days = rows.groupBy("doc").agg(F.min(F.nullif(F.col(begin), F.lit(""))).alias("__b"), F.max(F.nullif(F.col(end), F.lit(""))).alias("__e"))
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(other)).alias(c)
    return fields.join(days, "doc", "left").select(*[filled(c, "__b") if c == begin else filled(c, "__e") if c == end else F.col(c) for c in fields.columns])


def derived(fields: DataFrame, accidents: DataFrame) -> DataFrame:
    """Fields that others tell, where empty: sex and birthday by the identity number, in- or out-patient by the room, the last day of an out-patient, the day of the accident.

    `fields` has doc, idnum, sex, birthday, kind (01 in, 02 out), room, stay, begin, end and accident; `accidents` doc
    and day, the days of treatments.
    """
    from millrace.operators.detail import from_identity_number

    sex, birthday = from_identity_number(F.col("idnum"))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    room = F.coalesce(F.col("room"), F.lit(""))
    stay = F.when(F.contains(room, F.lit("외래")), "통원").when(F.replace(room, F.lit(" "), F.lit("")).rlike(ROOM) | F.contains(room, F.lit("입원")), "입원")
    first = accidents.groupBy("doc").agg(F.min(F.nullif(F.col("day"), F.lit(""))).alias("__first"))
    out = fields.join(first, "doc", "left").withColumns({"sex": F.coalesce(empty("sex"), sex), "birthday": F.coalesce(empty("birthday"), birthday), "stay": F.coalesce(empty("stay"), stay)})
    out = out.withColumn("end", F.coalesce(empty("end"), F.when(F.col("kind") == "02", F.col("begin"))))
    return out.withColumn("accident", F.coalesce(empty("accident"), empty("begin"), F.col("__first"))).drop("__first")


def dictionary_names(rows: DataFrame, names: DataFrame, system: str, code: str, name: str) -> DataFrame:
    """Names with one misread character mended after the dictionary's names of their code; without a known code nothing changes."""
    found = M.lookup(rows, names, F.lit(system), code)
    return found.withColumn(name, F.coalesce(M.corrected_name(F.col(name), F.col("names")), F.col(name))).select(*rows.columns)


def better_grid(read: Column, ruled: Column) -> Column:
    """The grid along printed rules where it has at least half as many rows as the one read, else that."""
    return F.when(2 * F.coalesce(F.size(ruled), F.lit(0)) >= F.greatest(F.size(read), F.lit(1)), ruled).otherwise(read)


def accepted_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, cell_no, text): cells after proposed edits; only filled cells are edited, to filled ones, and only where short (three characters) or half alike."""
    from millrace.operators.evidence import ALIKE, likeness

    both = cells.join(edits.select("doc", "cell_no", F.col("text").alias("new")), ["doc", "cell_no"], "left")
    asked = both.where(F.col("new").isNotNull() & (F.trim("new") != "") & (F.trim("text") != "") & (F.col("new") != F.col("text")))
    short = F.greatest(F.length("text"), F.length("new")) <= 3
    good = asked.where(short).select("doc", "cell_no", "new").unionByName(asked.where(~short).where(likeness("text", "new") >= ALIKE).select("doc", "cell_no", "new"))
    return cells.join(good, ["doc", "cell_no"], "left").select("doc", "cell_no", F.coalesce("new", "text").alias("text"))


def column_moves(found: DataFrame, least: int = 2) -> DataFrame:
    """(doc, column, target): moves of a column that `least` rows show, where no row shows it going elsewhere."""
    votes = found.groupBy("doc", "column", "target").agg(F.countDistinct("row").alias("n"))
    one = votes.groupBy("doc", "column").agg(F.count(F.lit(1)).alias("ways"), F.first("target").alias("target"), F.max("n").alias("n"))
    return one.where(F.col("n") >= least).where("ways = 1").select("doc", "column", "target")


def relocated(records: DataFrame, files: DataFrame) -> DataFrame:
    """(key, path): records (key, path, sha256, to) with their new path, where the file there has the content that was recorded."""
    there = files.select(F.col("path").alias("to"), F.sha2("content", 256).alias("now"))
    both = records.join(there, "to", "left")
    return both.select("key", F.when(F.col("now") == F.col("sha256"), F.col("to")).otherwise(F.col("path")).alias("path"), F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)).alias("moved"))


def search(results: DataFrame, text: str, columns: list[str], status: str | None = None) -> DataFrame:
    """Results of a status with a text, in any case, in one of the columns."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower())) for c in columns])
    return results.where(hit if status is None else hit & (F.col("status") == status))


def parse_metrics(blocks: DataFrame, by: str) -> DataFrame:
    """Tables, their rows, cells with several amounts and documents without any table, for each group; `blocks` has doc, type, rows and the group."""
    amounts = F.size(F.filter(F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))), lambda c: F.coalesce(N.several_amounts(c), F.lit(False))))
    per = blocks.groupBy(by, "doc").agg(F.count_if(F.col("type") == "table").alias("tables"), F.sum(F.when(F.col("type") == "table", F.size("rows")).otherwise(0)).alias("rows"), F.sum(F.when(F.col("type") == "table", amounts).otherwise(0)).alias("several"))
    return per.groupBy(by).agg(F.sum("tables").alias("tables"), F.sum("rows").alias("rows"), F.sum("several").alias("several"), F.count_if(F.col("tables") == 0).alias("bare"))


def restrict(fields: DataFrame, only: list[str], known: list[str]) -> DataFrame:
    """The fields with the keys asked for; keys that nobody knows are left out, and if all are, that is an error."""
    asked = [k for k in only if k in known]
    if not asked:
        raise ValueError(f"none of {only} is a known key")
    return fields.where(F.col("key").isin(*asked))


def migrated(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Rows for a new store, without NUL characters in texts; a target that holds rows is refused."""
    if not target.isEmpty():
        raise ValueError("the target holds rows already")
    return rows.select(*[F.replace(F.col(c), F.lit("\0"), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
