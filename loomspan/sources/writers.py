"""Writers: tables, JSON lines, summaries, CSV reports, versions and replace-or-append loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], at: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}.parquet")


def write_jsonl(df: DataFrame, at: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(at)


def write_summary(row: DataFrame, at: str) -> None:
    """A table of one row as one JSON document, nulls written; more rows are an error."""
    whole = row.groupBy().agg(F.count(F.lit(1)).alias("n"), F.first(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"})).alias("value"))
    one = F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a summary has one row, not "), F.col("n"))))
    whole.select(one.alias("value")).write.mode("overwrite").text(at)


def write_csv(df: DataFrame, at: str) -> None:
    """With a header; nested columns as JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(at)


def replace_version(df: DataFrame, at: str, version: str = "cluster_version") -> None:
    """Rows of the versions in df take the place of those stored for them; other versions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(at)


def load(tables: dict[str, DataFrame], at: str, mode: str, children: dict[str, list[str]] | None = None) -> None:
    """replace: each table is overwritten, and a parent's children that are not supplied are emptied. append: rows are added."""
    if mode not in ("replace", "append"):
        raise ValueError(f"mode must be replace or append: {mode}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite" if mode == "replace" else "append").parquet(f"{at}/{name}.parquet")
        for child in (children or {}).get(name, []) if mode == "replace" else []:
            if child not in tables:
                kept = spark.read.parquet(f"{at}/{child}.parquet").schema
                spark.createDataFrame([], kept).write.mode("overwrite").parquet(f"{at}/{child}.parquet")
