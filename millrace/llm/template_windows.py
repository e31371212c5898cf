"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Every text is read in three modes. `named` takes capitalised words inside sentences for names, `capital`
every capitalised word (a name at a sentence start as well), `folded` none (text in upper or title case).
Neighbouring name words are one name. In each mode numbers, number words, units after a number and names
become placeholders; the rest is lower-cased and stripped of punctuation. Windows of ten words are
hash-joined within their mode, so that a question with other numbers or names, or in another case, still
meets its original. A window must hold at least MIN_LITERAL ordinary words. An item of fewer than ten words
is one window; an item without such windows is looked for by its plain words.

A document-item pair is kept when enough of the item's windows were found in a mode and either all of them
agree word for word (verbatim) or the slots are consistent on an offset at which windows were found: each
value of the item stands for one value in the document throughout.

Before all this, texts are chosen that can hold a window at all: six ordinary words among ten stand next to
one another at least once, so for each window an anchor, its longest run of up to RUN neighbouring ordinary
words, must occur in the text. That is a hash a word and a look-up; everything else runs on the texts chosen,
each distinct text once. Up to ANCHORS anchors the look-up is a set in the plan, beyond that a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.storage import through_table

WINDOW = 10
MIN_LITERAL = 6
#: Share of an item's windows that must be found in a document, in percent.
SHARE = 30
BROADCAST_WINDOWS = 200_000
#: Most words of an anchor, and most anchors that the plan holds as a set.
RUN, ANCHORS = 4, 20_000
UNITS = (
    "mm", "cm", "m", "km", "g", "kg", "mg", "lb", "lbs", "oz", "ml", "l", "s", "ms", "min", "h", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "pound", "pounds", "cent", "cents", "percent", "degrees", "mile", "miles", "meter", "meters", "metres", "kilometers",
    "feet", "foot", "inch", "inches", "yards", "liter", "liters", "litres", "gallons", "gram", "grams", "kilograms", "tons", "watts", "volts", "mph", "kmh",
)
NUMBER_WORDS = (
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
)
_NAME, _NUMBER, _UNIT, _JOIN = "", "", "", ""
_MARKS = f"{_NAME}{_NUMBER}{_UNIT}{_JOIN}"


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Lower-cased words of `text` without punctuation; an empty word may come first or last.
_PLAIN_WORDS = r"split(lower(regexp_replace(coalesce(cast(text as string), ''), '[^\\p{L}\\p{M}\\p{N}\\s\\p{Z}]+', '')), '[\\s\\p{Z}]+')"


def _typed(text: Column) -> Column:
    """Lower-cased, with placeholders for numbers and for units after them."""
    numbered = F.lower(F.regexp_replace(text, r"\p{N}\S*", _NUMBER))
    numbered = F.regexp_replace(numbered, rf"(?<!\S)(?:{'|'.join(NUMBER_WORDS)})(?!\S)", _NUMBER)
    return F.regexp_replace(numbered, rf"(?<={_NUMBER} )(?:{'|'.join(UNITS)})(?!\S)", _UNIT)


def modes(rows: DataFrame, *keep: str, arrays: tuple[str, ...] = ("raw", "typed", "slots", "capital")) -> DataFrame:
    """(*keep, mode, *arrays): arrays of equal length for each text and mode.

    `typed` has the placeholders of the mode, `slots` those that an item compares, `capital` those that a
    document offers: all numbers, units and capitalised words. Mode `plain` has no placeholders at all.
    """
    base = F.regexp_replace(F.regexp_replace(_text(), f"[{_MARKS}]", ""), r"\p{Z}", " ")
    marked = F.regexp_replace(base, r"(?<=[^.!?\s]\s)(?=\p{Lu})", _NAME)
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, rf"[^\p{{L}}\p{{M}}\p{{N}}\s{_MARKS}]+", ""), r"\s+", " "))
    # The look-behind comes last, as it is the dear part.
    run = r"\s(?={0}\p{{Lu}})(?<={0}\p{{Lu}}[\p{{L}}\p{{M}}]{{0,40}}\s)"
    out = rows.select(*keep, clean(marked).alias("u"), clean(F.regexp_replace(marked, run.format(_NAME), _JOIN)).alias("n"), clean(F.regexp_replace(base, run.format(""), _JOIN)).alias("c"))

    def mode(name: str, text: str, typed: str, slots: str) -> Column:
        plain = F.translate(text, _NAME, "")
        words = {"raw": F.lower(plain), "named": _typed(F.regexp_replace(text, rf"{_NAME}\S+", _NAME)), "capital": _typed(F.regexp_replace(plain, r"(?<!\S)\p{Lu}\S*", _NAME)), "folded": _typed(plain)}
        of = {"raw": "raw", "typed": typed, "slots": slots, "capital": "capital"}
        return F.struct(F.lit(name).alias("mode"), *[F.split(words[of[x]], " ").alias(x) for x in arrays])

    each = F.array(mode("named", "n", "named", "named"), mode("capital", "c", "capital", "capital"), mode("folded", "u", "folded", "named"), mode("plain", "u", "raw", "raw"))
    return out.where("u <> ''").select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def _windows(rows: DataFrame, sizes: Column, *keep: str) -> DataFrame:
    """(*keep, mode, place, size, h) for every window of one of the sizes."""
    sized = rows.withColumn("size", F.explode(sizes)).where("size(typed) >= size")
    places = "transform(sequence(0, size(typed) - size), i -> struct(i as place, xxhash64(mode, slice(typed, i + 1, size)) as h))"
    return sized.withColumn("w", F.explode(F.expr(places))).select(*keep, "mode", "w.place", "size", "w.h")


def _literals(of: str) -> str:
    return f"filter({of}, x -> not x rlike '[{_MARKS}]')"


def _anchor(run: int, words: str, at: str) -> str:
    return f"xxhash64({', '.join(f'{words}[{at} + {k}]' for k in range(run))})"


def item_windows(item_modes: DataFrame) -> DataFrame:
    """(item_id, mode, place, size, h, run, anchor) of the windows with enough ordinary words, plain ones only for items without others."""
    size = F.expr(f"array(cast(if(size(typed) >= {WINDOW}, {WINDOW}, size(typed)) as int))")
    found = _windows(item_modes, size, "item_id").join(item_modes.select("item_id", "mode", "typed"), ["item_id", "mode"])
    found = found.withColumn("words", F.expr("slice(typed, place + 1, size)")).where(f"size({_literals('words')}) >= {MIN_LITERAL}")
    runs = [f"if(size(words) < {g}, array(), transform(sequence(0, size(words) - {g}), i -> if(exists(slice(words, i + 1, {g}), x -> x rlike '[{_MARKS}]'), null, struct({g} as run, length(array_join(slice(words, i + 1, {g}), '')) as n, slice(words, i + 1, {g}) as w))))" for g in range(2, RUN + 1)]
    found = found.withColumn("best", F.expr(f"array_max(filter(concat({', '.join(runs)}), x -> x is not null))"))
    anchor = "case best.run " + " ".join(f"when {g} then {_anchor(g, 'best.w', '0')}" for g in range(2, RUN + 1)) + " end"
    found = found.select("item_id", "mode", "place", "size", "h", "best.run", F.expr(anchor).alias("anchor"))
    templates = found.where("mode <> 'plain'")
    return templates.unionByName(found.where("mode = 'plain'").join(templates.select("item_id").distinct(), "item_id", "left_anti"))


def _candidates(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows whose text holds an anchor.

    The words are a lambda's variable: as a column of their own they would be made anew for every place.
    """
    few = anchors.limit(ANCHORS + 1).collect()
    if not few:
        return docs.limit(0)
    if len(few) <= ANCHORS:
        sets = {g: ", ".join(f"{r['anchor']}L" for r in few if r["run"] == g) for g in range(2, RUN + 1)}
        tests = [f"(size(w) >= {g} and exists(sequence(0, size(w) - {g}), i -> {_anchor(g, 'w', 'i')} in ({known})))" for g, known in sets.items() if known]
        return docs.where(f"exists(transform(array({_PLAIN_WORDS}), w -> {' or '.join(tests)}), x -> x)")
    runs = [f"if(size(w) >= {g}, array_distinct(transform(sequence(0, size(w) - {g}), i -> struct({g} as run, {_anchor(g, 'w', 'i')} as anchor))), array())" for g in range(2, RUN + 1)]
    hits = docs.select("t", F.explode(F.expr(f"flatten(transform(array({_PLAIN_WORDS}), w -> concat({', '.join(runs)})))")).alias("x")).select("t", "x.*")
    return docs.join(hits.join(anchors, ["run", "anchor"], "left_semi").select("t").distinct(), "t", "left_semi")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_found, n_windows, verbatim for each document that holds a benchmark item or its template.

    n_windows counts the item's distinct windows in the mode with the largest share found, n_found those met
    in the document. An item or document without MIN_LITERAL words never matches; null or empty texts
    likewise. A null doc_id is reported as null; a null item_id takes part as one item. Rows that repeat a
    doc_id and text give one result; text_hash (xxhash64 of the text) tells texts of one doc_id apart. Other
    columns are ignored; an empty table on either side gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    # Items go by a number of their own here, as ids may be null or repeat.
    items = through_table(items.distinct().withColumn("item_id", F.monotonically_increasing_id()), "items")
    item_modes = through_table(modes(items, "item_id"), "item-modes")
    windows = through_table(item_windows(item_modes), "item-windows")
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    small = F.broadcast if few else (lambda df: df)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())

    chosen = through_table(_candidates(docs, windows.select("run", "anchor").distinct()), "candidates")
    texts = chosen.groupBy("t").agg(F.first("text").alias("text"))
    every = _windows(modes(texts, "t", arrays=("typed",)), F.expr(f"cast(array({', '.join(map(str, sizes))}) as array<int>)"), "t")
    met = every.join(small(windows.withColumnRenamed("place", "item_place").drop("run", "anchor")), ["mode", "size", "h"])
    met = through_table(met.select("t", "item_id", "mode", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "size", "h").distinct(), "met")

    totals = windows.groupBy("item_id", "mode").agg(F.countDistinct("h").alias("n_windows"))
    found = met.groupBy("t", "item_id", "mode").agg(F.countDistinct("h").alias("n_found")).join(small(totals), ["item_id", "mode"])
    pairs = through_table(found.where(f"100 * n_found >= {SHARE} * n_windows"), "pairs")

    # From here on only texts in a pair are read.
    texts = chosen.join(pairs.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    texts = through_table(modes(texts, "t", arrays=("raw", "capital")), "texts")
    # A capitalised word at a sentence start is a slot where the item has it as a name elsewhere.
    sides = item_modes.withColumn("names", F.expr(f"filter(raw, (x, i) -> slots[i] = '{_NAME}')")).select(
        "item_id", "mode", F.col("raw").alias("item_raw"),
        F.expr(f"transform(slots, (x, i) -> if(x in ('{_NAME}', '{_NUMBER}', '{_UNIT}'), x, if(mode in ('named', 'folded') and capital[i] = '{_NAME}' and array_contains(names, raw[i]), '{_NAME}', null)))").alias("kinds"),
    )
    lined = met.join(pairs.select("t", "item_id", "mode"), ["t", "item_id", "mode"], "left_semi").groupBy("t", "item_id", "mode", "shift").agg(F.collect_set(F.struct("item_place", "size", "h")).alias("at"))
    lined = lined.join(small(sides), ["item_id", "mode"]).join(texts.select("t", "mode", F.col("raw").alias("doc_raw"), "capital"), ["t", "mode"]).select(
        "t", "item_id", "mode",
        F.expr("transform(at, x -> struct(x.h as h, slice(doc_raw, x.item_place + shift + 1, x.size) = slice(item_raw, x.item_place + 1, x.size) as same))").alias("at"),
        F.expr(
            "array_distinct(filter(transform(sequence(0, size(item_raw) - 1), i -> if(kinds[i] is not null and i + shift >= 0 and i + shift < size(doc_raw)"
            " and kinds[i] = get(capital, i + shift), struct(kinds[i] as kind, item_raw[i] as v, get(doc_raw, i + shift) as d), null)), x -> x is not null))"
        ).alias("slots"),
    )
    # One value of the item, one value of the document: distinct (kind, v, d) must be as many as distinct (kind, v).
    lined = lined.select("t", "item_id", "mode", "at", F.expr("size(slots) = size(array_distinct(transform(slots, x -> struct(x.kind, x.v))))").alias("good"))
    each = lined.select("t", "item_id", "mode", "good", F.explode("at").alias("x")).groupBy("t", "item_id", "mode", "x.h").agg(F.max("x.same").alias("same"), F.max("good").alias("good"))
    judged = each.groupBy("t", "item_id", "mode").agg(F.min("same").alias("same"), F.max("good").alias("good"))
    # Agreement word for word counts in a mode with the largest share: names may differ where another mode found more.
    share = F.expr("n_found / n_windows")
    most = F.max(share).over(Window.partitionBy("t", "item_id"))
    kept = pairs.withColumn("most", most).join(judged, ["t", "item_id", "mode"]).withColumn("verbatim", F.col("same") & (share >= F.col("most"))).where("verbatim or good")
    best = F.max(F.struct(share, F.expr("array_position(array('plain', 'folded', 'capital', 'named'), mode)"), "n_found", "n_windows", "verbatim")).alias("b")
    kept = kept.groupBy("t", "item_id").agg(best).select("t", "item_id", "b.n_found", "b.n_windows", "b.verbatim")
    named = kept.join(small(items.select("item_id", "item")), "item_id").groupBy("t", "item").agg(F.max(F.struct("n_found", "n_windows", "verbatim")).alias("b"))
    return chosen.select("doc_id", "t").distinct().join(named, "t").select("doc_id", F.col("t").alias("text_hash"), F.col("item").alias("item_id"), "b.n_found", "b.n_windows", "b.verbatim")
