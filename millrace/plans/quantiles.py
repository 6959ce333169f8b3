"""Exact quantiles by distributed selection.

The value at a rank is found digit by digit: the values of a group that agree with
it so far are counted by their next 16 bits, the counts are added up in order, and
the digit in which the rank falls is the next one.  No group's values are ever in
one place; what a task holds are at most 65,536 counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import shared_folder

DIGIT = 16


def _same(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"_v.{n}").eqNullSafe(F.col(f"_w.{n}")) for n in names), F.lit(True))


def exact_quantile(rows: DataFrame, by: Sequence[str], value: Column, q: float = 0.5, out: str = "quantile") -> DataFrame:
    """``by``, the quantile of whole-number values between its two neighbours in proportion, and n; nulls left out.

    The values are written once and read once for each digit.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/quantile-{uuid.uuid4().hex}"
    rows.select(*by, value.cast("long").alias("_value")).filter("_value is not null").write.parquet(path)
    values = spark.read.parquet(path)
    sizes = values.groupBy(*by).agg(F.count("*").alias("n"))
    place = (F.col("n") - 1) * F.lit(q)
    wanted = sizes.select(*by, F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_rank")).withColumn("_left", F.col("_rank")).withColumn("_prefix", F.lit(0).cast("long"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        agrees = F.lit(True) if shift == 64 - DIGIT else F.shiftright("_value", shift + DIGIT) == F.col("_prefix")
        inside = values.alias("_v").join(wanted.alias("_w"), _same(by) & agrees).select(*(F.col(f"_w.{n}").alias(n) for n in by), "_rank", "_left", F.shiftright("_value", shift).alias("_digit"))
        counts = inside.groupBy(*by, "_rank", "_left", "_digit").agg(F.count("*").alias("_n"))
        up = F.sum("_n").over(Window.partitionBy(*by, "_rank").orderBy("_digit"))
        found = counts.withColumn("_up", up).filter((F.col("_up") > F.col("_left")) & (F.col("_up") - F.col("_n") <= F.col("_left")))
        wanted = found.select(*by, "_rank", (F.col("_left") - F.col("_up") + F.col("_n")).alias("_left"), F.col("_digit").alias("_prefix"))
    ends = wanted.groupBy(*by).agg(F.min("_prefix").alias("_low"), F.max("_prefix").alias("_high"))
    joined = sizes.alias("_v").join(ends.alias("_w"), _same(by))
    part = (F.col("n") - 1) * F.lit(q)
    return joined.select(*(F.col(f"_v.{n}").alias(n) for n in by), (F.col("_low") + (F.col("_high") - F.col("_low")) * (part - F.floor(part))).alias(out), "n")
