"""Results as flat rows, and rows as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dotted(schema: T.StructType, at: str = "", name: str = "") -> dict[str, Column]:
    """Columns of a nested record by dotted names; a list, of whatever, is one JSON cell."""
    out: dict[str, Column] = {}
    for field in schema.fields:
        path, key = f"{at}`{field.name}`", f"{name}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out |= dotted(field.dataType, f"{path}.", f"{key}.")
        else:
            out[key] = F.to_json(F.col(path)) if isinstance(field.dataType, (T.ArrayType, T.MapType)) else F.col(path)
    return out


def table_rows(results: DataFrame) -> DataFrame:
    """`row` and flat columns: item i of every list of records goes to row i, short lists leave gaps, all else repeats; one row at least.

    Lists of plain values and empty lists stay JSON cells.
    """
    lists = [f.name for f in results.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    size = F.greatest(F.lit(1), *[F.coalesce(F.size(c), F.lit(0)) for c in lists], F.lit(1))
    out = results.withColumn("row", F.explode(F.sequence(F.lit(0), size - 1)))
    out = out.withColumns({c: F.get(F.col(c), F.col("row")) for c in lists})
    flat = dotted(T.StructType([f for f in out.schema.fields if f.name != "row"]))
    return out.select(F.col("row").cast("long").alias("row"), *[c.alias(k) for k, c in flat.items()])


def table(rows: list[DataFrame]) -> DataFrame:
    """All rows under the union of their columns in the order in which they first come; what a row lacks is empty text."""
    columns = list(dict.fromkeys(c for df in rows for c in df.columns))
    text = [df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]) for df in rows]
    out = text[0]
    for df in text[1:]:
        out = out.unionByName(df)
    return out


def project_rows(documents: DataFrame, result: str, schema: int | None = None) -> DataFrame:
    """The flat rows of all documents that have a result (of one schema), with their id, name and status, oldest first."""
    with_result = documents.where(F.col(result).isNotNull())
    if schema is not None:
        with_result = with_result.where(F.col("schema_id") == schema)
    flat = table_rows(with_result.select("document_id", "filename", "status", "created_at", f"{result}.*"))
    return flat.orderBy("created_at", "document_id", "row").drop("created_at")


def write(rows: DataFrame, path: str, kind: str) -> None:
    """Rows as JSON lines, CSV or Parquet; any other kind is an error."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown kind {kind!r}")
    writer = rows.write.mode("overwrite")
    (writer.option("header", "true").option("quoteAll", "true") if kind == "csv" else writer).format(kind).save(path)


def safe_stem(name: Column) -> Column:
    """A file name without its ending and without marks that paths do not bear."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[\\/:*?\"<>|\r\n\t]+", "_")


def replace_dictionary(entries: DataFrame, path: str) -> None:
    """The dictionary's entries as a whole in place of what was there; an empty one is refused."""
    if entries.isEmpty():
        raise ValueError("an empty dictionary would switch off the rules that need one")
    entries.write.mode("overwrite").parquet(path)
