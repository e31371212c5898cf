"""The ten queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.byte_bpe import round_trip
from millrace.llm.difference_cover import without_repeats
from millrace.llm.hyperminhash import near_duplicates
from millrace.llm.licence_sentences import licences
from millrace.llm.pseudo_likelihood import score
from millrace.llm.quote_links import reply_order
from millrace.llm.repair_grammar import read, write
from millrace.llm.robust_outliers import quality_rules
from millrace.llm.secret_forest import report
from millrace.llm.template_windows import contaminated


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_documents(spark, sf_dir))


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(_documents(spark, sf_dir))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_documents(spark, sf_dir))


def op8_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir)).drop("lang", "source", "text_hash")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_documents(spark, sf_dir))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir)).drop("text_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_forest": op1_secret_forest,
        "op10_template_windows": op10_template_windows,
        "op2_quote_links": op2_quote_links,
        "op3_licence_sentences": op3_licence_sentences,
        "op4_pseudo_likelihood": op4_pseudo_likelihood,
        "op8_repair_grammar": op8_repair_grammar,
        "op5_robust_outliers": op5_robust_outliers,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_difference_cover": op7_difference_cover,
        "op9_hyperminhash": op9_hyperminhash,
    }


#: Words of the whole text, and the lower-casing of A-Z only.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op7_difference_cover": f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
            s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
            m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
            c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM m),
            l AS (SELECT r, list(p) AS gone FROM c GROUP BY r),
            t AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w, gone FROM d LEFT JOIN l USING (r)),
            k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) u ANTI JOIN c USING (r, p) GROUP BY r)
            SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (r)
        """,
        "op9_hyperminhash": f"""
            WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
            s AS (
                SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
                FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
            ),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
            ),
            e AS (
                SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                WHERE 100 * c >= 75 * (x.n + y.n - c)
            ),
            r AS (SELECT a AS doc_id, b AS c FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
            k AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(k.c, d.doc_id)) AS component_id,
                   d.doc_id = least(d.doc_id, coalesce(k.c, d.doc_id)) AS kept
            FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
        """,
    }
