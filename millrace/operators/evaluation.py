"""Scoring of readings against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import normalise as N


def _same(kinds: list[str], strict: bool) -> Column:
    out = N.same("text", F.col("label"), F.col("given"), strict)
    for kind in kinds:
        out = F.when(F.col("kind") == kind, N.same(kind, F.col("label"), F.col("given"), strict)).otherwise(out)
    return out


def verdicts(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """The rows (label, given, kind) with `verdict` (correct, wrong, fp for a value that the label lacks, skip for none on either side) and `strict`."""
    agrees = _same(kinds, False)
    empty = F.col("label").isNull() | (F.col("label") == "")
    verdict = F.when(empty, F.when(agrees, "skip").otherwise("fp")).otherwise(F.when(agrees, "correct").otherwise("wrong"))
    # Strictly, an empty cell and a zero differ as well.
    strict = F.when(F.col("kind").isin("amount", "number"), N.normalize("amount", F.col("label")).eqNullSafe(N.normalize("amount", F.col("given")))).otherwise(_same(kinds, True))
    return rows.withColumns({"verdict": verdict, "strict": strict})


def accuracy(judged: DataFrame, by: list[str]) -> DataFrame:
    """correct, total, fp and their strict counterparts for each group; rows without a value on either side count only as strict false positives."""
    is_ = lambda *names: F.col("verdict").isin(*names)
    return judged.groupBy(*by).agg(
        F.count_if(is_("correct")).alias("correct"), F.count_if(is_("correct", "wrong")).alias("total"), F.count_if(is_("fp")).alias("fp"),
        F.count_if(is_("correct", "wrong") & F.col("strict")).alias("strict_correct"), F.count_if(is_("correct", "wrong")).alias("strict_total"), F.count_if(is_("fp", "skip") & ~F.col("strict")).alias("strict_fp"),
    )


def without_totals(predicted: DataFrame, labels: DataFrame, doc: str, name: str) -> DataFrame:
    """Predicted rows without sum rows where the document's labels have none."""
    having = labels.where(N.is_total(F.col(name))).select(doc).distinct().withColumn("has", F.lit(True))
    return predicted.join(having, doc, "left").where(F.col("has") | ~N.is_total(F.col(name))).drop("has")


def two_sides(first: DataFrame, last: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of either reading on a common set: a cell that one side lacks counts as empty there."""
    both = first.select(*keys, F.col("value").alias("first")).join(last.select(*keys, F.col("value").alias("last")), keys, "full_outer")
    return both.join(labels.select(*keys, F.col("value").alias("label"), "kind"), keys, "full_outer").na.fill("text", ["kind"])


def automatic(marked: DataFrame, by: list[str]) -> DataFrame:
    """cells, passed (not for review), their rate, and the accuracy among them; `marked` has review and correct."""
    counts = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("review")).alias("passed"), F.count_if(~F.col("review") & F.col("correct")).alias("right"))
    return counts.withColumns({"pass_rate": F.col("passed") / F.col("cells"), "pass_accuracy": F.when(F.col("passed") > 0, F.col("right") / F.col("passed"))}).drop("right")


def manifest_drift(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason): files of a manifest (path, sha256) that are missing or hold other content now."""
    now = files.select("path", F.sha2("content", 256).alias("now"))
    return manifest.join(now, "path", "left").where(~F.col("now").eqNullSafe(F.col("sha256"))).select("path", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("reason"))


def nullish(value: Column) -> Column:
    """Null for words that stand for nothing."""
    return F.when(~F.lower(F.trim(value)).isin("", "null", "none", "nan", "n/a", "-"), value)
