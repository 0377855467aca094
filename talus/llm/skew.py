"""Joins whose hot keys are found by counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than one row in so many has it, so there are fewer hot keys than this.
SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with table (key, n and further columns, one row a key; n: how many rows have the key). Keys that more than
    one row in SHARE has, by all that table counts, are fewer than SHARE and are broadcast; the rows that have them take no
    part in the shuffled join, where they are spread under keys of their own. n goes. Null keys match nothing."""
    total = table.agg(F.sum("n")).first()[0] or 0
    more = [c for c in table.columns if c not in (key, "n")]
    hot = table.where(F.col("n") * SHARE > total).select(F.col(key).alias("_k1"), *(F.col(c).alias(f"_h{k}") for k, c in enumerate(more)), F.lit(True).alias("_hot"))
    cold = table.where(F.col("n") * SHARE <= total).select(F.col(key).alias("_k2"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(more)), F.lit(True).alias("_cold"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_k1"), "left")
    # a row that is served already is dealt by all its values, under a key that no row of the table has
    met = met.withColumns({"_k3": F.when(F.col("_hot").isNull(), F.col(key)), "_spread": F.when(F.col("_hot"), F.xxhash64(*rows.columns)).otherwise(F.lit(0))})
    cold = cold.withColumn("_zero", F.lit(0).cast("long"))
    out = met.join(cold, (F.col("_k3") == F.col("_k2")) & (F.col("_spread") == F.col("_zero")), "left")
    if how == "inner":
        out = out.where("_hot or _cold")
    return out.select(*rows.columns, *(F.coalesce(f"_h{k}", f"_c{k}").alias(c) for k, c in enumerate(more)))
