"""Text and HTML tables of documents to blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.documents import LINE_END


def text_blocks(documents: DataFrame) -> DataFrame:
    """A row for each non-blank line: doc_id, line_no (of the lines as given) and the trimmed text."""
    # Line ends of any script, as text has them.
    lines = documents.select("doc_id", F.posexplode(F.split(F.col("text"), LINE_END)).alias("line_no", "text"))
    return lines.withColumn("text", F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).where("text <> ''")


def html_headings(pages: DataFrame) -> DataFrame:
    """page_id with the number of list items and first-level headings."""
    count = lambda tag: F.size(F.regexp_extract_all("html", F.lit(f"(?i)<{tag}[ >]"), F.lit(0))).cast("long")
    return pages.select("page_id", count("h1").alias("n_h1"), count("li").alias("n_li"))
