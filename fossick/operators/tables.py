"""Generic tables: profile, catalog search, changes of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, n, nulls, distinct, min, max, mean): one row a column.

    Minimum, maximum and mean of numbers, as doubles with four decimals; null for other columns. One pass for all columns
    but for the distinct counts, of which each reads its own column: together they read the table once more, where one
    aggregation of them all would multiply every row by the number of columns.
    """
    names = columns or df.columns
    number = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(names):
        v = F.col(c)
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.isNull()).alias(f"z{i}")]
        for k, f in (("a", F.min), ("b", F.max), ("m", F.avg)):
            aggs.append((F.round(f(v).cast("double"), 4) if number[c] else F.lit(None).cast("double")).alias(f"{k}{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit("numeric" if number[c] else "other").alias("kind"), F.col(f"n{i}").alias("n"), F.col(f"z{i}").alias("nulls"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(names)]
    counts = [df.select(F.col(c).alias("v")).distinct().agg(F.lit(c).alias("column"), F.count("v").alias("distinct")) for c in names]
    distinct = counts[0]
    for c in counts[1:]:
        distinct = distinct.unionAll(c)
    return one.select(F.inline(F.array(*rows))).join(distinct, "column").select("column", "kind", "n", "nulls", "distinct", "min", "max", "mean")


def search_catalog(spark: SparkSession, tables: dict[str, DataFrame], term: str) -> DataFrame:
    """(table_name, column_name) where the term is in either name, whatever the case."""
    t = term.lower()
    rows = [(n, c) for n, df in tables.items() for c in df.columns if t in n.lower() or t in c.lower()]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def update_rows(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns by name; those that ``rows`` lacks are null."""
    return df.unionByName(rows, allowMissingColumns=True)
