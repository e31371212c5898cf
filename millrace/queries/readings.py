"""Two readings of item tables and of fields: rows in pairs, what differs, verdicts, review, scores. Derived tables are plain SQL for both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import alignment as A
from millrace.operators import arbitration as V
from millrace.operators import evaluation as E
from millrace.streaming import leases

_NAMES = "CASE row WHEN 0 THEN '진찰료' WHEN 1 THEN '검사료' WHEN 2 THEN '마취료' WHEN 3 THEN '식대' WHEN 4 THEN '영상진단료' WHEN 5 THEN '치료재료대' ELSE '제증명료' END"
#: The second reading lacks rows, has longer names and other ones, and lists its rows from the last to the first.
_ROWS = f"""
    b AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS bigint) - 1 AS row, CAST(sum(l_quantity) AS bigint) AS q FROM {{lineitem}} GROUP BY 1, 2),
    l AS (SELECT doc, row, {_NAMES} AS name, CAST(q AS string) AS q FROM b),
    r AS (SELECT doc, row, 99 - row AS place, CASE WHEN (doc + row) % 11 = 4 THEN '기타료' WHEN (doc + row) % 5 = 1 THEN concat({_NAMES}, '_x') ELSE {_NAMES} END AS name,
        CASE WHEN (doc + row) % 13 = 6 THEN CAST(q + 1 AS string) ELSE CAST(q AS string) END AS q FROM b WHERE (doc + row) % 7 <> 3)"""


def _lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _pairs(spark, sf_dir):
    left = spark.sql(f"WITH {_ROWS} SELECT doc, row AS place, name, q FROM l", lineitem=_lines(spark, sf_dir))
    right = spark.sql(f"WITH {_ROWS} SELECT doc, place, name, q FROM r", lineitem=_lines(spark, sf_dir))
    return A.align(left, right, "doc", ["place"], {"name": "text"}, ["name", "q"])


def row_align(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc", "pair", "name", "q", "other_name", "other_q")


def row_diff(spark, sf_dir):
    return A.row_diff(_pairs(spark, sf_dir), "doc", {"name": "text", "q": "amount"})


_FIELDS = """
    own AS (SELECT o_orderkey AS doc, 'status' AS key, 'text' AS kind, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS value FROM {orders}
        UNION ALL SELECT o_orderkey, 'priority', 'text', CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority END FROM {orders}),
    other AS (SELECT o_orderkey AS doc, 'status' AS key, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS value FROM {orders}
        UNION ALL SELECT o_orderkey, 'priority', CASE WHEN o_orderkey % 7 = 2 THEN 'other' ELSE o_orderpriority END FROM {orders}),
    verdict AS (SELECT doc, key, CASE doc % 4 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'corrected' END AS source, CASE WHEN doc % 4 = 2 THEN value ELSE 'third' END AS value FROM other WHERE doc % 3 <> 0),
    flag AS (SELECT o_orderkey AS doc, 'status' AS key FROM {orders} WHERE o_orderkey % 23 = 4),
    fix AS (SELECT o_orderkey AS doc, 'priority' AS key FROM {orders} WHERE o_orderkey % 19 = 3)"""


def _fields(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return [spark.sql(f"WITH {_FIELDS} SELECT * FROM {name}", orders=orders) for name in ("own", "other", "flag", "verdict", "fix")]


def field_disputes(spark, sf_dir):
    own, other, flag, _, _ = _fields(spark, sf_dir)
    return V.disputed(own, other, flag, ["text"]).select("doc", "key", "differs", "hinted")


def resolve_verdicts(spark, sf_dir):
    return V.resolved(*_fields(spark, sf_dir), ["text"]).select("doc", "key", "value", "source")


def source_counts(spark, sf_dir):
    return V.source_counts(V.resolved(*_fields(spark, sf_dir), ["text"]))


_REVIEW = """
    cells AS (SELECT l_orderkey AS doc, 'items' AS key, CAST(l_linenumber AS bigint) AS row, 'q' AS column, 'amount' AS kind, CAST(max(l_quantity) AS string) AS one,
        CASE WHEN l_orderkey % 6 = 1 THEN concat(CAST(max(l_quantity) AS string), '0') WHEN l_orderkey % 6 = 2 THEN NULL ELSE CAST(max(l_quantity) AS string) END AS two FROM {lineitem} GROUP BY l_orderkey, l_linenumber),
    flags AS (SELECT DISTINCT doc, 'items' AS key, CASE WHEN doc % 4 < 2 THEN row END AS row, CASE WHEN doc % 4 IN (0, 2) THEN 'q' END AS column FROM cells WHERE doc % 9 = 5 AND row = 2)"""


def review_cells(spark, sf_dir):
    cells, flags = (spark.sql(f"WITH {_REVIEW} SELECT * FROM {name}", lineitem=_lines(spark, sf_dir)) for name in ("cells", "flags"))
    return V.review(cells, flags, ["amount"]).select("doc", "row", "review")


def review_counts(spark, sf_dir):
    cells, flags = (spark.sql(f"WITH {_REVIEW} SELECT * FROM {name}", lineitem=_lines(spark, sf_dir)) for name in ("cells", "flags"))
    return V.review_counts(V.review(cells, flags, ["amount"]))


_SUMS = """
    m AS (SELECT o_orderkey AS doc, CAST(floor(o_totalprice) AS bigint) AS t, CAST(floor(o_totalprice / 3) AS bigint) AS a FROM {orders}),
    chosen AS (SELECT doc, 'a' AS key, CAST(CASE WHEN doc % 4 = 1 THEN a + 5000 ELSE a END AS string) AS value, CAST(CASE WHEN doc % 4 = 1 THEN a + 5000 ELSE a END AS string) AS one, CAST(a AS string) AS two, 'one' AS source FROM m
        UNION ALL SELECT doc, 'b', CAST(t - a AS string), CAST(t - a AS string), CAST(t - a + 9000 AS string), 'agree' FROM m
        UNION ALL SELECT doc, 'total', CAST(CASE WHEN doc % 4 = 2 THEN t + 700 ELSE t END AS string), CAST(t AS string), CAST(CASE WHEN doc % 4 = 2 THEN t + 700 ELSE t END AS string), 'two' FROM m)"""


def balance_sums(spark, sf_dir):
    chosen = spark.sql(f"WITH {_SUMS} SELECT * FROM chosen", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return V.balanced(chosen, {"total": ("a", "b")})


_SCORED = """
    rows AS (SELECT o_orderpriority AS field, 'amount' AS kind, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(o_custkey AS string) END AS label,
        CASE WHEN o_orderkey % 5 = 0 THEN '0' WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN concat('1', CAST(o_custkey AS string)) ELSE concat(CAST(o_custkey AS string), '원') END AS given FROM {orders})"""


def score_fields(spark, sf_dir):
    rows = spark.sql(f"WITH {_SCORED} SELECT * FROM rows", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return E.accuracy(E.verdicts(rows, ["amount"]), ["field"])


def auto_pass(spark, sf_dir):
    cells, flags = (spark.sql(f"WITH {_REVIEW} SELECT * FROM {name}", lineitem=_lines(spark, sf_dir)) for name in ("cells", "flags"))
    marked = V.review(cells, flags, ["amount"]).withColumn("correct", F.col("doc") % 10 != 3).withColumn("line", F.col("row"))
    return E.automatic(marked, ["line"]).select("line", "cells", "passed", F.round("pass_rate", 6).alias("pass_rate"), F.round("pass_accuracy", 6).alias("pass_accuracy"))


def _job_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'finish' ELSE 'heartbeat' END")
    return events.select(F.col("user_id").alias("doc"), "event_id", kind.alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 2).alias("worker"), F.col("ts").cast("timestamp").alias("at"))


def lease_takeover(spark, sf_dir):
    return leases.claims(_job_events(spark, sf_dir), 3600.0)


def stale_jobs(spark, sf_dir):
    jobs = spark.sql("SELECT o_orderkey AS doc, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'parsing' WHEN 2 THEN 'completed' ELSE 'extracting' END AS status, o_orderkey % 3 = 0 AS parsed, CAST(o_orderdate AS timestamp) AS updated_at FROM {orders}", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return leases.stale(jobs, "1996-01-01 00:00:00")


_QUERIES = (row_align, row_diff, field_disputes, resolve_verdicts, source_counts, review_cells, review_counts, balance_sums, score_fields, auto_pass, lease_takeover, stale_jobs)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_PAIRED = """,
    ll AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row) - 1 AS pair FROM l),
    m AS (SELECT ll.doc, pair, ll.name, ll.q, r.name AS other_name, r.q AS other_q FROM ll JOIN r ON r.doc = ll.doc AND r.row = ll.row AND r.name <> '기타료'),
    rl AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pair) AS k FROM ll WHERE (doc, pair) NOT IN (SELECT (doc, pair) FROM m)),
    rr AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place) AS k FROM r WHERE name = '기타료'),
    p AS (SELECT * FROM m UNION ALL SELECT rl.doc, pair, rl.name, rl.q, rr.name, rr.q FROM rl LEFT JOIN rr ON rr.doc = rl.doc AND rr.k = rl.k)"""
_JUDGED = """,
    j AS (SELECT own.doc, own.key, own.value AS one, other.value AS two, nullif(own.value, '') IS DISTINCT FROM other.value AS differs, flag.doc IS NOT NULL AS hinted, v.source AS said, v.value AS new, fix.doc IS NOT NULL AS mended, own.doc % 17 = 0 AS blank
        FROM own LEFT JOIN other USING (doc, key) LEFT JOIN flag USING (doc, key) LEFT JOIN verdict v USING (doc, key) LEFT JOIN fix USING (doc, key)),
    s AS (SELECT *, CASE WHEN NOT differs AND NOT hinted THEN 'agree' WHEN blank THEN 'two' WHEN said IS NULL THEN 'unknown' WHEN said IN ('one', 'two') THEN said WHEN new = nullif(one, '') THEN 'one' WHEN new = two THEN 'two' ELSE 'corrected' END AS src FROM j),
    res AS (SELECT doc, key, CASE src WHEN 'two' THEN two WHEN 'corrected' THEN new ELSE one END AS value, CASE WHEN mended AND src IN ('agree', 'one', 'unknown') THEN 'corrected' ELSE src END AS source FROM s)"""
_MARKED = """,
    k AS (SELECT c.doc, c.row, (two IS NULL AND one::double <> 0) OR (two IS NOT NULL AND replace(two, '.00', '.0') <> one) OR EXISTS (SELECT 1 FROM flags f WHERE f.doc = c.doc AND (f.row IS NULL OR f.row = c.row) AND (f."column" IS NULL OR f."column" = c."column")) AS review FROM cells c)"""


def oracle_sql() -> dict[str, str]:
    rows = "WITH " + _ROWS.replace("{lineitem}", "lineitem").replace("AS string", "AS varchar") + _PAIRED
    fields = "WITH " + _FIELDS.replace("{orders}", "orders") + _JUDGED
    marked = "WITH " + _REVIEW.replace("{lineitem}", "lineitem").replace("AS string", "AS varchar").replace("AS column", 'AS "column"') + _MARKED
    return {
        "row_align": rows + " SELECT doc, pair, name, q, other_name, other_q FROM p",
        "row_diff": rows + """ SELECT doc, pair, 'name' AS "column", name AS own, other_name AS other FROM p WHERE other_name IS NULL OR other_name = '기타료' OR (other_name <> name AND length(name) < 4)
            UNION ALL SELECT doc, pair, 'q', q, other_q FROM p WHERE q <> coalesce(other_q, '0')""",
        "field_disputes": fields + " SELECT doc, key, differs, hinted FROM j WHERE differs OR hinted",
        "resolve_verdicts": fields + " SELECT * FROM res",
        "source_counts": fields + " SELECT doc, " + ", ".join(f"count(*) FILTER (source = '{x}') AS {x}" for x in V.SOURCES) + " FROM res GROUP BY doc",
        "review_cells": marked + " SELECT doc, row, review FROM k",
        "review_counts": marked + " SELECT doc, count(*) AS cells, count(*) FILTER (review) AS review FROM k GROUP BY doc",
        "balance_sums": "WITH " + _SUMS.replace("{orders}", "orders").replace("AS string", "AS varchar") + """
            SELECT doc, key, CASE WHEN key = 'a' THEN two ELSE value END::bigint AS value, CASE WHEN key = 'a' AND doc % 4 = 1 THEN 'two' ELSE source END AS source FROM chosen WHERE NOT (key = 'total' AND doc % 4 = 2)
            UNION ALL SELECT doc, key, one::bigint, 'one' FROM chosen WHERE key = 'total' AND doc % 4 = 2""",
        "score_fields": "WITH " + _SCORED.replace("{orders}", "orders").replace("AS string", "AS varchar") + """,
            n AS (SELECT field, coalesce(label, '') = '' AS empty, nullif(label, '') AS l, replace(given, '원', '') AS g FROM rows),
            v AS (SELECT field, empty, coalesce(l, '0') = coalesce(g, '0') AS agrees, l IS NOT DISTINCT FROM g AS strict FROM n)
            SELECT field, count(*) FILTER (NOT empty AND agrees) AS correct, count(*) FILTER (NOT empty) AS total, count(*) FILTER (empty AND NOT agrees) AS fp, count(*) FILTER (NOT empty AND strict) AS strict_correct,
                   count(*) FILTER (NOT empty) AS strict_total, count(*) FILTER (empty AND NOT strict) AS strict_fp FROM v GROUP BY field""",
        "auto_pass": marked + """ SELECT row AS line, count(*) AS cells, count(*) FILTER (NOT review) AS passed, round(count(*) FILTER (NOT review) / count(*), 6) AS pass_rate,
            round(count(*) FILTER (NOT review AND doc % 10 <> 3) / nullif(count(*) FILTER (NOT review), 0), 6) AS pass_accuracy FROM k GROUP BY row""",
        "stale_jobs": """SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 'extract' ELSE 'parse' END AS task FROM orders
            WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 IN (1, 3) AND o_orderdate < TIMESTAMP '1995-12-31 23:50:00')""",
    }
