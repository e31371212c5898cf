"""Fields from blocks by their labels, schemas from requests, packing of pages, merging of partial results, validation."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND_FIELD, FOUND_CELL, LOW = 0.82, 0.84, 0.7
#: Words that part the terms of a request, words around a term, words of amounts.
_PARTS = r"[,，、\n]|(?:와|과|및|그리고)|\band\b"
_AROUND = r"(추출|해줘|해주세요|필드|정보|이 문서에서|이 문서의)"
_AMOUNTS = ("amount", "total", "price", "금액", "합계", "가격")


def field_name(label: str) -> str:
    return re.sub(r"[^a-zA-Z0-9가-힣]+", "_", label.strip()).strip("_").lower() or "field"


def generate_schema(request: str, labels: Iterable[str] = ()) -> dict:
    """A JSON schema of the terms of a request, else of at most twelve labels of a text, else of one value."""
    terms = [re.sub(_AROUND, "", t).strip(" .") for t in re.split(_PARTS, request, flags=re.I)]
    properties = {field_name(t): {"type": "number" if any(w in t.lower() for w in _AMOUNTS) else "string", "title": t, "description": f"문서의 {t}"} for t in terms if t}
    if not properties:
        properties = {field_name(x): {"type": "string", "title": x.strip(), "description": f"문서의 {x.strip()}"} for x in list(labels)[:12]}
    properties = properties or {"value": {"type": "string", "title": "값", "description": "문서에서 추출할 값"}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Generated schema", "type": "object", "properties": properties, "required": list(properties)}


def text_labels(text: Column) -> Column:
    """Labels before a colon at the starts of lines."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*([^:\n]{2,40}?)[ \t]*:"), F.lit(1)), F.trim)


def coerce(value: Column, kind: str) -> Column:
    """The value as text in the form of its type: whole number, number, true or false; what cannot be read stays as it is."""
    plain = F.trim(value)
    digits = F.regexp_replace(plain, r"[^\d.\-]", "")
    if kind == "integer":
        return F.coalesce(digits.try_cast("bigint").cast("string"), plain)
    if kind == "number":
        return F.coalesce(digits.try_cast("double").cast("string"), plain)
    if kind == "boolean":
        return F.lower(plain).isin("true", "yes", "y", "1", "예", "네").cast("string")
    return plain


def local_extract(texts: DataFrame, schema: dict, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, field, value, confidence, source_text): each plain field from the first `label: value` of its labels.

    Labels are the field's name with spaces, its title and its description, tried in this order; the value ends with
    the line or a bar. A field that is not found has a null value and confidence 0.
    """
    out = []
    for name, spec in schema.get("properties", {}).items():
        if spec.get("type") in ("object", "array"):
            continue
        labels = list(dict.fromkeys(x for x in (name.replace("_", " "), spec.get("title", ""), spec.get("description", "")) if x))
        patterns = [r"(?im)(?:^|\||\n)\s*" + re.sub(r"([^\w\s])", r"\\\1", x) + r"\s*[:：|]\s*([^\n|]+)" for x in labels]
        hits = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
        sources = [F.nullif(F.regexp_replace(F.regexp_extract(text, p, 0), r"^[\s|]+|\s+$", ""), F.lit("")) for p in patterns]
        value = coerce(F.coalesce(*hits), spec.get("type", "string"))
        out.append(F.struct(F.lit(name).alias("field"), value.alias("value"), F.when(value.isNotNull(), FOUND_FIELD).otherwise(0.0).alias("confidence"), F.coalesce(*sources).alias("source_text")))
    return texts.select(key, F.explode(F.array(*out)).alias("x")).select(key, "x.*")


def table_items(tables: DataFrame, schema: dict, doc: str = "doc", block: str = "block") -> DataFrame:
    """(doc, item, field, value, confidence): rows of the first table of a document whose header row holds one of the item's labels.

    `tables` has a document's tables in order of `block`, with their rows; rows without any value are left out.
    """
    fields = schema["items"]["properties"]
    heads = F.transform(F.get("rows", F.lit(0)), lambda c: F.lower(F.trim(c)))

    def place(name: str, spec: dict) -> Column:
        labels = sorted({name.lower(), name.replace("_", " ").lower(), spec.get("title", "").lower()} - {""})
        return F.get(F.filter(F.transform(F.col("head"), lambda c, i: F.when(c.isin(*labels), i)), lambda i: i.isNotNull()), F.lit(0))

    places = {name: place(name, spec) for name, spec in fields.items()}
    headed = tables.where(F.size("rows") > 1).withColumn("head", heads)
    headed = headed.withColumn("at", F.array(*places.values())).where(F.exists("at", lambda i: i.isNotNull()))
    first = headed.groupBy(doc).agg(F.min_by(F.struct("rows", "at"), block).alias("x")).select(doc, "x.*")
    rows = first.select(doc, "at", F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("n", "cells"))
    values = [F.when(F.col("at")[i].isNotNull(), F.nullif(F.trim(F.get("cells", F.col("at")[i])), F.lit(""))) for i in range(len(fields))]
    kept = rows.withColumn("v", F.array(*values)).where(F.exists("v", lambda x: x.isNotNull()))
    numbered = kept.withColumn("item", F.row_number().over(Window.partitionBy(doc).orderBy("n")).cast("long") - 1)
    cells = [F.when(F.col("at")[i].isNotNull(), F.struct(F.lit(name).alias("field"), coerce(F.col("v")[i], spec.get("type", "string")).alias("value"))) for i, (name, spec) in enumerate(fields.items())]
    each = numbered.select(doc, "item", F.explode(F.array_compact(F.array(*cells))).alias("x")).select(doc, "item", "x.*")
    return each.withColumn("confidence", F.when(F.col("value").isNotNull(), FOUND_CELL).otherwise(0.0))


def page_chunks(blocks: DataFrame, doc: str, page: str, block: str, length: str, budget: int = 40_000) -> DataFrame:
    """(doc, page, n, chunk): whole pages packed in order into chunks of at most `budget`, a longer page cut at its blocks.

    Pages are runs of neighbouring blocks of one page; `n` counts blocks. Lengths of runs are folded in order
    within a document; a block that alone exceeds the budget is a chunk of its own.
    """
    frame = Window.partitionBy(doc).orderBy(block)
    change = F.when(F.row_number().over(frame) == 1, 0).when(F.lag(page).over(frame).eqNullSafe(F.col(page)), 0).otherwise(1)
    runs = blocks.withColumn("__change", change).withColumn("__run", F.sum("__change").over(frame))
    listed = runs.groupBy(doc, "__run").agg(F.first(page).alias(page), F.sum(F.col(length)).alias("total"), F.transform(F.array_sort(F.collect_list(F.struct(block, F.col(length).alias("l")))), lambda x: x["l"]).alias("ls"))
    pages = listed.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("__run", page, "total", "ls"))).alias("runs"))
    # State: the open chunk's number and fill, and what has been dealt: (page, blocks, chunk).
    inner = f"""aggregate(r.ls, named_struct('c', if(s.fill > 0, s.c + 1, s.c), 'fill', 0L, 'out', s.out), (z, l) ->
        if(z.fill > 0 and z.fill + l > {budget}, named_struct('c', z.c + 1, 'fill', cast(l as bigint), 'out', concat(z.out, array(named_struct('page', r.{page}, 'n', 1, 'chunk', z.c + 1)))),
           named_struct('c', z.c, 'fill', cast(z.fill + l as bigint), 'out', concat(z.out, array(named_struct('page', r.{page}, 'n', 1, 'chunk', z.c))))),
        z -> named_struct('c', z.c + 1, 'fill', 0L, 'out', z.out))"""
    kind = blocks.schema[page].dataType.simpleString()
    fold = f"""aggregate(runs, named_struct('c', 0, 'fill', 0L, 'out', cast(array() as array<struct<page:{kind},n:int,chunk:int>>)), (s, r) ->
        if(r.total > {budget}, {inner},
        if(s.fill > 0 and s.fill + r.total > {budget}, named_struct('c', s.c + 1, 'fill', cast(r.total as bigint), 'out', concat(s.out, array(named_struct('page', r.{page}, 'n', size(r.ls), 'chunk', s.c + 1)))),
           named_struct('c', s.c, 'fill', cast(s.fill + r.total as bigint), 'out', concat(s.out, array(named_struct('page', r.{page}, 'n', size(r.ls), 'chunk', s.c)))))), s -> s.out)"""
    each = pages.select(doc, F.explode(F.expr(fold)).alias("x"))
    return each.groupBy(doc, F.col("x.page").alias(page), F.col("x.chunk").cast("long").alias("chunk")).agg(F.sum("x.n").alias("n"))


def merge_scalars(parts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The first value of each key that is not null, in order of the chunks."""
    filled = F.when(F.col(value).isNotNull(), F.col(order))
    return parts.groupBy(*keys).agg(F.min_by(value, filled).alias(value))


def merge_lists(parts: DataFrame, keys: list[str], order: str, items: str) -> DataFrame:
    """Lists of chunks joined in order; a first item that repeats the last one before it is dropped."""
    listed = parts.where(F.col(items).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, items))).alias("p"))
    kind = parts.schema[items].dataType.simpleString()
    join = f"aggregate(p, cast(array() as {kind}), (s, x) -> concat(s, if(size(s) > 0 and size(x.{items}) > 0 and element_at(s, -1) <=> x.{items}[0], slice(x.{items}, 2, size(x.{items})), x.{items})))"
    return listed.select(*keys, F.expr(join).alias(items))


def validate(fields: DataFrame, schema: dict, key: str = "doc", confidence: DataFrame | None = None) -> DataFrame:
    """(key, path, code): the rules of a schema that the columns of `fields` break, and fields of low confidence.

    Columns hold text. Known rules: required, type, enum, pattern, minimum, maximum, minLength, maxLength. A null is a
    missing value: it breaks `required` alone. `confidence` has key, field and confidence.
    """
    found = []
    for name, spec in schema.get("properties", {}).items():
        value = F.col(name).cast("string")
        broken: dict[str, Column] = {}
        if name in schema.get("required", ()):
            broken["required"] = value.isNull()
        kinds = {"integer": value.try_cast("bigint").isNull(), "number": value.try_cast("double").isNull(), "boolean": ~F.lower(value).isin("true", "false")}
        if spec.get("type") in kinds:
            broken["type"] = kinds[spec["type"]]
        if "enum" in spec:
            broken["enum"] = ~value.isin(*[str(x) for x in spec["enum"]])
        if "pattern" in spec:
            broken["pattern"] = ~value.rlike(spec["pattern"])
        number = value.try_cast("double")
        for rule, test in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("minLength", lambda x: F.length(value) < x), ("maxLength", lambda x: F.length(value) > x)):
            if rule in spec:
                broken[rule] = test(spec[rule])
        for code, test in broken.items():
            found.append(F.when(F.coalesce(test if code == "required" else value.isNotNull() & test, F.lit(False)), F.struct(F.lit("/" if code == "required" else f"/{name}").alias("path"), F.lit(code).alias("code"), F.lit(name).alias("field"))))
    issues = fields.select(key, F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "x.*")
    if confidence is not None:
        issues = issues.unionByName(confidence.where(F.col("confidence") < LOW).select(key, F.concat(F.lit("/"), F.col("field")).alias("path"), F.lit("low_confidence").alias("code"), "field"))
    return issues


def status_after(documents: DataFrame, issues: DataFrame, key: str = "doc", approving: bool = False) -> DataFrame:
    """(key, status): needs_review where an issue is left, else completed; approval leaves low confidence aside."""
    left = issues.where(F.col("code") != "low_confidence") if approving else issues
    flagged = left.select(key).distinct().withColumn("flag", F.lit(True))
    return documents.select(key).join(flagged, key, "left").select(key, F.when(F.col("flag"), "needs_review").otherwise("completed").alias("status"))
