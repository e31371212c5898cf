"""Queries over the driver tables by name, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import normalise as N
from millrace.operators import rules as R
from millrace.operators import tables as O
from millrace.queries import documents, readings, receipts
from millrace.sources import text as T

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_item_rules(spark, sf_dir):
    return R.order_item_rules(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"))


def sum_field(spark, sf_dir):
    return R.sum_field(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem"))


def normalize_date(spark, sf_dir):
    day = F.col("o_orderdate")
    printed = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy. M. d') WHEN 2 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE date_format(o_orderdate, 'yyMMdd') END")
    printed = F.when(F.col("o_orderkey") % 5 == 0, F.replace(printed, F.lit("0"), F.lit("O"))).otherwise(printed)
    printed = F.when(F.col("o_orderkey") % 11 == 0, F.lit("2023.02.30")).otherwise(printed)
    return _t(spark, sf_dir, "orders").where(day.isNotNull()).select("o_orderkey", N.date(printed).alias("day"))


def normalize_amount(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    sign = F.when(key % 7 == 0, "△").otherwise("")
    printed = F.when(key % 3 == 0, F.format_number(F.floor(price), 0)).otherwise(F.format_number(price, 2))
    printed = F.when((key % 5 == 0), F.translate(printed, "01", "OI")).otherwise(printed)
    printed = F.when(key % 13 == 0, F.lit("원")).otherwise(F.concat(F.when(printed.rlike(r"^\d"), sign).otherwise(""), printed, F.lit("원")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", N.amount(printed).alias("amount"))


def normalize_code(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    printed = F.concat(F.lit("m"), F.lpad(key, 5, "0"), F.lit(".9 / 020.9, M"), F.lpad(key, 5, "0"), F.lit(".9"))
    return _t(spark, sf_dir, "part").select("p_partkey", N.disease_codes(printed).alias("codes"))


def normalize_idnum(spark, sf_dir):
    key = F.lpad(F.col("c_custkey").cast("string"), 6, "8")
    return _t(spark, sf_dir, "customer").select("c_custkey", N.identity_number(F.concat(key, F.lit(" - 1"), F.when(F.col("c_custkey") % 2 == 0, "234567").otherwise(""))).alias("idnum"))


def dictionary_lookup(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(N.dictionary_key(F.concat(F.lit("kk."), F.col("p_partkey").cast("string"))).alias("code"), "p_name")
    cells = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_cells"))
    return cells.withColumn("code", N.dictionary_key(F.concat(F.lit(" KK-"), F.col("l_partkey").cast("string")))).join(names, "code", "left").select("code", "p_name", "n_cells")


def dispute_cells(spark, sf_dir):
    own = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    mark = F.col("o_orderkey") % 11
    other = own.where(mark != 3).withColumn("o_orderstatus", F.when(mark == 5, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return R.disputes(own, other, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def latest_status(spark, sf_dir):
    return R.latest(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def json_extract(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def score_grouping_sets(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 1000).cast("int").alias("prediction"))
    return R.score_grouping_sets(docs.join(_t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"), ["lang", "source"])


def content_dedup(spark, sf_dir):
    return R.content_groups(_t(spark, sf_dir, "documents"))


def evidence_exact(spark, sf_dir):
    return R.exact_evidence(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def text_blocks(spark, sf_dir):
    return T.text_blocks(_t(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


def html_blocks(spark, sf_dir):
    return T.html_headings(_t(spark, sf_dir, "pages"))


def _items(spark, sf_dir):
    """Item rows with a key of their own; repeated (order, line) pairs are kept apart by part and amount."""
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("line"), "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


def prefix_lookup(spark, sf_dir):
    key = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    names = _t(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(key.alias("code"), "p_name")
    cells = _t(spark, sf_dir, "part").select(F.concat(key, F.when(F.col("p_partkey") % 2 == 0, "AB").otherwise("")).alias("code"))
    return O.prefix_lookup(cells, names, "code", "p_name", 6)


def pair_rows(spark, sf_dir):
    left = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    right = left.where("event_id % 7 <> 0")
    return O.pair_rows(left, right, ["user_id", "event_type"], "event_id").withColumn("turn", F.col("turn").cast("long"))


def smallest_container(spark, sf_dir):
    items = _items(spark, sf_dir)
    points = items.groupBy("l_orderkey", "line").agg(F.max("l_quantity").alias("x")).withColumn("y", F.col("line").cast("double"))
    boxes = points.where("line <= 3").select("l_orderkey", F.col("line").alias("box"), (F.col("x") - 10 * F.col("line")).alias("x0"), (F.col("x") + 10).alias("x1"), (F.col("y") - 2).alias("y0"), (F.col("y") + 2).alias("y1"))
    return O.smallest_container(points, boxes, ["l_orderkey"], "line", "box")


def nearest_label(spark, sf_dir):
    items = _items(spark, sf_dir).groupBy("l_orderkey", "line").agg(F.max("l_quantity").alias("x")).withColumn("y", F.col("line").cast("double"))
    anchors = items.where("line % 2 = 0").select("l_orderkey", F.col("line").alias("label"), F.col("x").alias("anchor_x"), F.col("y").alias("anchor_y"))
    return O.nearest_label(items, anchors, ["l_orderkey"], "line", "label", 3.0)


def section_context(spark, sf_dir):
    section = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return O.carry_forward(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", section, "section")


def page_islands(spark, sf_dir):
    return O.islands(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


def evenly_spaced(spark, sf_dir):
    return O.evenly_spaced(_t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 7)


def majority_vote(spark, sf_dir):
    return O.majority(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


def upper_median(spark, sf_dir):
    return O.upper_median(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")


def one_sided_rows(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey")
    return O.one_sided(orders.where("o_custkey % 5 <> 1"), _t(spark, sf_dir, "customer").where("c_custkey % 7 <> 2").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


def next_version(spark, sf_dir):
    return O.next_version(_t(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_size")


def status_dwell(spark, sf_dir):
    return O.status_dwell(_t(spark, sf_dir, "events"), "user_id", "ts", "event_type")


def correction_overlay(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    fixes = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderpriority").alias("v"))
    return O.overlay(base, fixes, "id", "o_orderkey", "v")


def _cells(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    given = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))
    return orders.select(F.col("o_orderpriority").alias("field"), label.alias("label"), given.alias("given"))


def cell_accuracy(spark, sf_dir):
    return O.accuracy(_cells(spark, sf_dir), ["field"], "label", "given")


def top_misses(spark, sf_dir):
    return O.top_misses(O.accuracy(_cells(spark, sf_dir), ["field"], "label", "given"), "field", 3)


def queue_reason(spark, sf_dir):
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    known = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus").where("id % 4 <> 0")
    return O.queue_reason(asked, known, "id", "o_orderstatus", ["F"])


def detail_rules(spark, sf_dir):
    items = _items(spark, sf_dir)
    codes = _t(spark, sf_dir, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"))
    sized = items.join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    found = [
        O.row_arithmetic(sized, "l_orderkey", ["l_quantity", "p_retailprice"], "l_extendedprice"),
        O.low_quality(items, "l_orderkey", F.col("l_returnflag") == "R"), O.unknown_codes(items, codes, "l_orderkey", "l_partkey"),
        O.row_copy(items.withColumn("q", F.col("l_quantity")), "l_orderkey", "q", F.col("line") == 1),
    ]
    return O.run_rules(found).groupBy("rule").agg(F.count(F.lit(1)).alias("n_flags"), F.countDistinct("key").alias("n_docs"))


def empty_columns(spark, sf_dir):
    blank = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).alias("n"), F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("o"))
    return O.empty_columns(blank, "l_orderkey", ["n", "o"])


def export_rows(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("part"), F.array_sort(F.collect_set("l_suppkey")).alias("supplier"))
    return O.table_rows(items, "l_orderkey", ["part", "supplier"]).withColumn("row", F.col("row").cast("long"))


def same_reading(spark, sf_dir):
    name = F.col("c_name")
    other = F.expr("CASE c_custkey % 3 WHEN 0 THEN replace(c_name, '#', ' - ') WHEN 1 THEN substring(c_name, 1, 12) ELSE concat(c_name, 'x9') END")
    flip = F.when(F.col("c_custkey") % 5 == 0, F.translate(name, "09", "O8")).otherwise(name)
    return _t(spark, sf_dir, "customer").select("c_custkey", N.same_text(name, F.when(F.col("c_custkey") % 13 == 0, F.lit("other")).otherwise(other)).alias("same"), N.misread_distance(name, flip).alias("apart"))


def markdown_rows(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", N.markdown_row(F.array("p_name", F.lit("a|b"), "p_brand")).alias("row"))


_QUERIES = (order_item_rules, sum_field, normalize_date, normalize_amount, normalize_code, normalize_idnum, dictionary_lookup, dispute_cells, latest_status, json_extract, score_grouping_sets, content_dedup, evidence_exact, text_blocks, html_blocks,
    prefix_lookup, pair_rows, smallest_container, nearest_label, section_context, page_islands, evenly_spaced, majority_vote, upper_median, one_sided_rows, next_version, status_dwell, correction_overlay, cell_accuracy, top_misses, queue_reason, detail_rules, empty_columns, export_rows, same_reading, markdown_rows)


#: Modules with queries of their own.
_MODULES = (receipts, readings, documents)


def queries() -> dict[str, Query]:
    out = {f.__name__: f for f in _QUERIES}
    for module in _MODULES:
        out |= module.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out = _oracle_sql()
    for module in _MODULES:
        out |= module.oracle_sql()
    return out


def _oracle_sql() -> dict[str, str]:
    return {
        "order_item_rules": """
            SELECT 'DATE.ORDER' AS rule, count(*) AS n_flags FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate::date < o_orderdate::date
            UNION ALL SELECT 'MISSING.REQUIRED', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
        "sum_field": """
            SELECT o_orderkey, o_totalprice::decimal(18,2)::double AS total, parts::double AS parts, n_parts FROM orders
            JOIN (SELECT l_orderkey, sum(l_extendedprice::decimal(18,2)) AS parts, count(*) AS n_parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
            WHERE n_parts >= 2 AND abs(o_totalprice::decimal(18,2) - parts) >= 100""",
        "normalize_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y%m%d') END AS day FROM orders WHERE o_orderdate IS NOT NULL",
        "normalize_amount": """
            SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN
                (CASE WHEN o_orderkey % 7 = 0 AND NOT (o_orderkey % 5 = 0 AND left(floor(p)::bigint::varchar, 1) IN ('0', '1')) THEN '-' ELSE '' END)
                || CASE WHEN o_orderkey % 3 = 0 THEN floor(p)::bigint::varchar ELSE regexp_replace(p::varchar, '\\.?0*$', '') END END AS amount
            FROM (SELECT o_orderkey, o_totalprice::decimal(18,2) AS p FROM orders)""",
        "normalize_code": "SELECT p_partkey, 'M' || lpad(p_partkey::varchar, 5, '0') || '9, D209' AS codes FROM part",
        "normalize_idnum": "SELECT c_custkey, lpad(c_custkey::varchar, 6, '8') || '-1' || CASE WHEN c_custkey % 2 = 0 THEN '234567' ELSE '******' END AS idnum FROM customer",
        "dictionary_lookup": "SELECT 'KK' || l_partkey AS code, p_name, count(*) AS n_cells FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
        "dispute_cells": """
            SELECT o_orderkey, 'missing' AS kind, c AS "column", CASE c WHEN 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END AS own, NULL::varchar AS other
            FROM orders, (VALUES ('o_orderstatus'), ('o_orderpriority')) v(c) WHERE o_orderkey % 11 = 3
            UNION ALL SELECT o_orderkey, 'differs', 'o_orderstatus', o_orderstatus, 'X' FROM orders WHERE o_orderkey % 11 = 5""",
        "latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_events FROM events GROUP BY user_id",
        "json_extract": "SELECT event_id, (props::json->>'k')::bigint AS k FROM events",
        "score_grouping_sets": """
            SELECT lang, source, sum((quality = (n_chars > 1000)::int)::int)::bigint AS n_hit, count(*) AS n_total
            FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())""",
        "content_dedup": "SELECT sha256(text) AS content, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "evidence_exact": r"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE len(regexp_extract_all(b.text, '[^\x20\x09-\x0D]+')) >= 3",
        "text_blocks": r"""
            SELECT doc_id, line_no, text FROM (
                SELECT doc_id, unnest(range(len(l))) AS line_no, regexp_replace(unnest(l), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text
                FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE text <> ''""",
        "html_blocks": "SELECT page_id, len(regexp_extract_all(html, '(?i)<h1[ >]')) AS n_h1, len(regexp_extract_all(html, '(?i)<li[ >]')) AS n_li FROM pages",
        "prefix_lookup": """
            WITH n AS (SELECT lpad(p_partkey::varchar, 6, '0') AS k, p_name FROM part WHERE p_partkey % 3 > 0)
            SELECT lpad(p.p_partkey::varchar, 6, '0') || CASE WHEN p.p_partkey % 2 = 0 THEN 'AB' ELSE '' END AS code, k AS prefix, n.p_name
            FROM part p LEFT JOIN n ON k = lpad(p.p_partkey::varchar, 6, '0')""",
        "pair_rows": """
            WITH a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS turn FROM events),
            b AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS turn FROM events WHERE event_id % 7 <> 0)
            SELECT user_id, event_type, turn, a.event_id, b.event_id AS other_event_id FROM a FULL JOIN b USING (user_id, event_type, turn)""",
        "smallest_container": """
            WITH p AS (SELECT l_orderkey, l_linenumber::bigint AS line, max(l_quantity) AS x, l_linenumber::double AS y FROM lineitem GROUP BY 1, 2, 4),
            b AS (SELECT l_orderkey, line AS box, x - 10 * line AS x0, x + 10 AS x1, y - 2 AS y0, y + 2 AS y1 FROM p WHERE line <= 3)
            SELECT l_orderkey, line, arg_min(box, ((x1 - x0) * (y1 - y0), box)) AS box FROM p JOIN b USING (l_orderkey)
            WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2""",
        "nearest_label": """
            WITH p AS (SELECT l_orderkey, l_linenumber::bigint AS line, max(l_quantity) AS x, l_linenumber::double AS y FROM lineitem GROUP BY 1, 2, 4)
            SELECT p.l_orderkey, p.line, arg_min(a.line, (abs(p.y - a.y), a.line)) AS label, min(abs(p.y - a.y)) AS gap
            FROM p JOIN p a ON a.l_orderkey = p.l_orderkey AND a.line % 2 = 0 AND abs(p.y - a.y) <= 3 AND a.x <= p.x GROUP BY 1, 2""",
        "section_context": """
            SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events""",
        "page_islands": """
            WITH c AS (SELECT user_id, event_id, event_type, (lag(event_type) OVER w IS DISTINCT FROM event_type)::bigint AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
            i AS (SELECT *, (sum(change) OVER (PARTITION BY user_id ORDER BY event_id))::bigint AS island FROM c)
            SELECT user_id, event_type, island, count(*) AS n_rows, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY 1, 2, 3""",
        "evenly_spaced": """
            WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders)
            SELECT DISTINCT o_orderpriority, o_orderkey FROM r JOIN (SELECT unnest(range(7)) AS i) ON pos = CASE WHEN size <= 7 THEN i ELSE (i * size) // 7 END""",
        "majority_vote": """
            SELECT l_orderkey, arg_min(l_returnflag, (-k, l_returnflag)) AS l_returnflag, max(k) AS votes
            FROM (SELECT l_orderkey, l_returnflag, count(*) AS k FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
        "upper_median": "SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS l_quantity FROM lineitem GROUP BY 1",
        "one_sided_rows": """
            SELECT o_custkey, 'missing' AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 5 <> 1) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 2)
            UNION ALL SELECT c_custkey, 'extra' FROM customer WHERE c_custkey % 7 <> 2 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 5 <> 1)""",
        "next_version": "SELECT p_brand, p_type, (max(p_size) + 1)::bigint AS next_version FROM part GROUP BY 1, 2",
        "status_dwell": """
            SELECT event_type AS status, count(*) AS n, sum(epoch_us(nxt) - epoch_us(ts))::bigint AS micros
            FROM (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS nxt FROM events) GROUP BY 1""",
        "correction_overlay": """
            SELECT c_custkey AS id, coalesce(n, c_mktsegment) AS v, n IS NOT NULL AS corrected
            FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""",
        "cell_accuracy": """
            SELECT o_orderpriority AS field, count(*) FILTER (l = g) AS correct, count(l) AS total, count(*) FILTER (l IS NULL AND g IS NOT NULL) AS false_positive
            FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS l, CASE WHEN o_orderkey % 7 = 0 THEN 'X' WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS g FROM orders) GROUP BY 1""",
        "top_misses": """
            SELECT o_orderpriority AS field, count(l) - count(*) FILTER (l = g) AS misses
            FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS l, CASE WHEN o_orderkey % 7 = 0 THEN 'X' WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS g FROM orders)
            GROUP BY 1 HAVING misses > 0 ORDER BY misses DESC, field LIMIT 3""",
        "queue_reason": """
            SELECT c_custkey AS id, CASE WHEN o_orderstatus IS NULL THEN 'not found' WHEN o_orderstatus <> 'F' THEN 'not ready' END AS reason
            FROM customer LEFT JOIN orders ON o_orderkey = c_custkey AND o_orderkey % 4 <> 0""",
        "detail_rules": """
            WITH f AS (
                SELECT 'DETAIL.ROW_ARITH' AS rule, l_orderkey AS key FROM lineitem JOIN part ON p_partkey = l_partkey WHERE abs(l_quantity * p_retailprice - l_extendedprice) >= 100
                UNION ALL SELECT 'DETAIL.LOW_QUALITY', l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5 AND 2 * count(*) FILTER (l_returnflag = 'R') > count(*)
                UNION ALL SELECT 'MASTER.CODE_UNKNOWN', l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)
                UNION ALL SELECT DISTINCT 'RECEIPT.ROW_COPY', a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity = b.l_quantity WHERE a.l_linenumber = 1 AND b.l_linenumber <> 1)
            SELECT rule, count(*) AS n_flags, count(DISTINCT key) AS n_docs FROM f GROUP BY 1""",
        "empty_columns": """
            SELECT 'DETAIL.EMPTY_COLUMN' AS rule, l_orderkey AS key, 'n' AS "column" FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_returnflag = 'N' THEN l_quantity END) = 0
            UNION ALL SELECT 'DETAIL.EMPTY_COLUMN', l_orderkey, 'o' FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_linestatus = 'O' THEN l_tax END) = 0""",
        "export_rows": """
            WITH g AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS part, list_sort(list(DISTINCT l_suppkey)) AS supplier FROM lineitem GROUP BY 1),
            r AS (SELECT *, unnest(range(greatest(len(part), len(supplier)))) AS row FROM g)
            SELECT l_orderkey, row, part[row + 1] AS part, supplier[row + 1] AS supplier FROM r""",
        "same_reading": """
            SELECT c_custkey, c_custkey % 13 <> 0 AS same, CASE WHEN c_custkey % 5 = 0 THEN len(c_name) - len(translate(c_name, '09', '')) ELSE 0 END AS apart FROM customer""",
        "markdown_rows": "SELECT p_partkey, '| ' || p_name || ' | a\\|b | ' || p_brand || ' |' AS row FROM part",
    }
