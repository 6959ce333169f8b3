"""Agreement, rank correlation, gates and golden-set bookkeeping."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import shared_folder
from millrace.settings import DEFAULT, GATES, Settings


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """kappa of two raters, one row; aggregates only the table of label pairs."""
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("same"))
    left = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    right = pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, left["a"].eqNullSafe(right["b"])).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("c"))
    p = F.col("same") / F.col("t").cast("double")
    e = F.col("c") / (F.col("t").cast("double") * F.col("t"))
    kappa = F.when(F.coalesce("t", F.lit(0)) == 0, 1.0).when(F.abs(e - 1) < 1e-9, F.when(F.abs(p - 1) < 1e-9, 1.0).otherwise(0.0)).otherwise((p - e) / (1 - e))
    return total.join(F.broadcast(chance)).select(kappa.alias("kappa"))


def _ranks(counts: DataFrame, value: str, times: Column, out: str) -> DataFrame:
    """(_v, ``out``): average ranks of the values of counted rows, ties sharing their mean, without a window over all of them.

    The different values are sorted in range partitions and written to the shared
    folder, which fixes the partitions; each adds up on its own, and the driver gets
    one total per partition.
    """
    spark = counts.sparkSession
    path = f"{shared_folder(spark)}/ranks-{uuid.uuid4().hex}"
    by_value = counts.groupBy(F.col(value).alias("_v")).agg(F.sum(times).alias("_n"))
    by_value.orderBy("_v").withColumn("_p", F.spark_partition_id()).write.parquet(path)
    by_value = spark.read.parquet(path)
    before, starts = 0, []
    for row in by_value.groupBy("_p").agg(F.sum("_n").alias("t")).orderBy("_p").collect():
        starts.append((row["_p"], before))
        before += row["t"]
    earlier = spark.createDataFrame(starts, "_q int, _before long")
    up = F.sum("_n").over(Window.partitionBy("_p").orderBy("_v"))
    return by_value.withColumn("_up", up).join(F.broadcast(earlier), F.col("_p") == F.col("_q")).select("_v", (F.col("_before") + F.col("_up") - (F.col("_n") - 1) / 2.0).alias(out))


def ranked(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with the average rank of a column."""
    placed = _ranks(rows, value, F.lit(1), out)
    return rows.join(placed, rows[value].eqNullSafe(placed["_v"])).drop("_v")


def spearman_rho(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rho of two orderings, one row; 1 or 0 where a side is constant.

    The rows are read once, to the counts of their different pairs, which all that
    follows is made from.  The mean of average ranks is (n + 1) / 2 on either side.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    rows.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_times")).write.parquet(path)
    pairs = spark.read.parquet(path)
    n = pairs.agg(F.coalesce(F.sum("_times"), F.lit(0))).first()[0]
    ra, rb = (_ranks(pairs, name, F.col("_times"), out).withColumnRenamed("_v", f"_v{out}") for name, out in (("_a", "ra"), ("_b", "rb")))
    both = pairs.join(ra, F.col("_a").eqNullSafe(F.col("_vra"))).join(rb, F.col("_b").eqNullSafe(F.col("_vrb")))
    x, y, times = F.col("ra") - (n + 1) / 2, F.col("rb") - (n + 1) / 2, F.col("_times")
    s = both.agg((F.sum(times * x * x) / n).alias("va"), (F.sum(times * y * y) / n).alias("vb"), (F.sum(times * x * y) / n).alias("c")) if n else spark.createDataFrame([(None, None, None)], "va double, vb double, c double")
    flat_a, flat_b = F.col("va") < 1e-9, F.col("vb") < 1e-9
    rho = F.lit(1.0) if n < 2 else F.when(flat_a & flat_b, 1.0).when(flat_a | flat_b, 0.0).otherwise(F.col("c") / F.sqrt(F.col("va") * F.col("vb")))
    return s.select(rho.alias("rho"))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Probability that a positive outscores a negative, ties half; null without both."""
    r = ranked(rows.select(score, positive), score, "r")
    s = r.agg(F.count_if(positive).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("n"), F.sum(F.when(F.col(positive), F.col("r"))).alias("s"))
    return s.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"))


def decile_rates(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Observed rate by tenth of the scores, the lowest first; tenths by rank."""
    r = ranked(rows.select(score, positive), score, "r").join(F.broadcast(rows.agg(F.count("*").alias("_all"))))
    tenth = F.least(F.lit(10), F.floor((F.col("r") - 0.5) * 10 / F.col("_all")) + 1)
    return r.groupBy(tenth.alias("decile")).agg(F.count("*").alias("n"), F.avg(F.col(positive).cast("double")).alias("rate"))


def gates(values: DataFrame) -> DataFrame:
    """name, value, threshold, higher_is_better, passed; a metric that is missing is 0."""
    table = values.sparkSession.createDataFrame([(k, t, h) for k, (t, h) in GATES.items()], "name string, threshold double, higher_is_better boolean")
    rows = table.join(values.select("name", "value"), "name", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return rows.withColumn("passed", F.when(F.col("higher_is_better"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")))


def regressions(gate_rows: DataFrame, baseline: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """name, before, value of gates that got worse by more than the limit."""
    rows = gate_rows.join(baseline.select("name", F.col("value").alias("before")), "name")
    worse = F.when(F.col("higher_is_better"), F.col("before") - F.col("value")).otherwise(F.col("value") - F.col("before"))
    return rows.filter(worse > settings.max_regression).select("name", "before", "value")


def slice_shortfall(cases: DataFrame, targets: Mapping[str, int]) -> DataFrame:
    """slice, have, target, short: golden cases by slice, empty slices included."""
    table = cases.sparkSession.createDataFrame(sorted(targets.items()), "slice string, target int")
    counted = cases.groupBy("slice").agg(F.count("*").alias("have"))
    return table.join(counted, "slice", "left").select("slice", F.coalesce("have", F.lit(0)).alias("have"), "target", (F.coalesce("have", F.lit(0)) < F.col("target")).alias("short"))
