"""Pairing predictions with truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assize.functions.scoring import extract_score, int_score
from assize.plans.lineage import settle


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows delivered again count once: of each key, the columns of one row."""
    return df.dropDuplicates(list(keys))


def parse_predictions(responses: DataFrame, response: str = "response", *, integer: bool = False, error_fails: bool = False) -> DataFrame:
    """Adds answer and parse_failed.

    A null response is a failed parse. With ``integer`` a missing or worded score is one too; without it, a missing score is
    a null answer. With ``error_fails`` the sentinel "Error" counts as failed as well.
    """
    text = F.col(response)
    answer = int_score(text).cast("string") if integer else extract_score(text)
    failed = text.isNull()
    if integer:
        failed = failed | answer.isNull()
    if error_fails:
        failed = failed | (text == "Error")
    return responses.withColumn("answer", answer).withColumn("parse_failed", F.coalesce(failed, F.lit(True)))


def pair_by_key(predictions: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """Inner join on the key: rows without a partner go, repeated keys multiply, null keys never pair."""
    return predictions.join(truth, key)


def with_ordinal(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Adds the row's ordinal from 0 in the order of ``key`` (ties by the other columns), without gaps."""
    # range borders are sampled: the numbering must see one and the same partitioning
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges by all columns, so that rows of one key may be in several
    fixed = settle(df.repartitionByRange(parts, key, *[c for c in df.columns if c != key]).withColumn("_part", F.spark_partition_id()), "ordinal")
    within = Window.partitionBy("_part").orderBy(key, *[c for c in df.columns if c != key])
    counts = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    numbered = fixed.withColumn("_k", F.row_number().over(within)).join(offsets, "_part")
    return numbered.withColumn(name, (F.col("_k") + F.col("_before") - 1).cast("bigint")).drop("_part", "_k", "_before")


def pair_by_position(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Both sides in the order of their key, row by row; the longer side's rest gets nulls (right's columns end in _right).

    This pairs what stands at the same place even where the keys differ; ``pair_by_key`` is the safe form.
    """
    r = with_ordinal(right, key).select("ordinal", *[F.col(c).alias(f"{c}_right") for c in right.columns])
    return with_ordinal(left, key).join(r, "ordinal", "full")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, fallback: Column, name: str) -> DataFrame:
    """Adds ``name``: the value looked up by key in ``table``, or the fallback where the key isn't in it."""
    t = table.dropDuplicates([key]).select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_in"))
    return df.join(t, df[key] == t["_key"], "left").withColumn(name, F.when(F.col("_in"), F.col("_value")).otherwise(fallback)).drop("_key", "_value", "_in")
