"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix.  Of
all rates that meet the token constraint of each source, ``sum(size * rate) =
target``, and stay within ``[0, cap]``, entropy balancing takes the one closest
to the data as it is, in relative entropy per document:

    minimise  sum over documents of rate * ln(rate) - rate + 1

Its convex dual has one multiplier for each source; the rates are the
exponential tilts ``min(cap, exp(multiplier * size / scale))``, so a source that
must grow repeats its long documents first and one that must shrink gives those
up first, while short ones stay near one copy.  Newton's method solves the dual;
each iteration is one distributed aggregation of gradient and curvature by
source, within a bracket that falls back to bisection.  The documents enter the
dual only through their source and size, so the iterations run over the counts
by (source, size), which lose nothing and are far fewer than the documents.  The
multipliers are a table of one row a source, which no driver holds.

Rates become whole copies by error diffusion: within a source, sizes descend,
and each size takes the number of copies that brings the words taken so far
nearest to the words due so far; what one size misses goes to the next smaller.
The total misses its target by less than the largest size of which one copy more
or less is left to decide, usually a few words.  Among documents of one size the
ones with the smallest hashes get the additional copy, up to a last one that is
found by counts of hash buckets and a ranking within the one bucket at the
boundary; so no source, size or group of copies is gathered in one task, the
documents themselves are joined once, and reruns agree.

Null texts have size 0; documents of size 0 weigh nothing and have rate 1.  A
null source is a source, the last in order.  Sources of total size 0 have target
0.  Rows with equal ids are separate rows, of which all or none get the
additional copy.  An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import WORD_PATTERN, checkpointed

#: Weights by rank of the source, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Copies of a document, and words of a source against its size, at most.
CAP = 3.0
BUCKETS = 256
MAX_ITERATIONS = 80
TOLERANCE = 1e-10
#: Sources of which the table of multipliers is broadcast; beyond it is joined.
MOST_BROADCAST = 100_000


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their rank from 0 by code point, null last; no task sees all of them.

    The rows are range-partitioned; the driver gets one count per partition.
    """
    placed = checkpointed(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before = np.cumsum([0, *(row["n"] for row in counts)]).tolist()
    offsets = placed.sparkSession.createDataFrame([(row["part"], start) for row, start in zip(counts, before)], "part long, before long")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), F.shiftright("at", 33) == F.col("part")).withColumn("rank", F.col("before") + within).drop("at", "part", "before")


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, total, rank to these and target: shares of the sum by weight, none above ``cap`` times its size.

    What exceeds a cap is shared again by weight among the sources below theirs,
    until none is above: the level, words per weight, rises to where what is
    capped below it leaves just that level for the others.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight)
    full = cap * F.col("total")
    level, capped = 0.0, -1
    while True:
        below = full / F.col("weight") < level
        row = weighed.agg(
            F.sum("total").alias("all"), F.sum(F.when(below, F.col("total")).otherwise(0)).alias("capped"),
            F.sum(F.when(~below, F.col("weight"))).alias("open"), F.sum(below.cast("long")).alias("n"),
        ).first()
        if row["open"] is None or row["n"] == capped:
            break
        level, capped = (row["all"] - cap * row["capped"]) / row["open"], row["n"]
    return weighed.withColumn("target", F.when(full / F.col("weight") < level, full).otherwise(level * F.col("weight")))


def rate(cap: float = CAP) -> Column:
    """Rate of a size under its source's multiplier, to nine places, so that reruns round alike."""
    return F.round(F.least(F.lit(cap), F.exp(F.col("multiplier") * F.col("size") / F.col("scale"))), 9)


def solve_dual(cells: DataFrame, due: DataFrame, cap: float = CAP, iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> tuple[DataFrame, int]:
    """(source, scale, multiplier; iterations taken) by Newton's method on the dual.

    ``cells``: source, size, n; ``due``: source, total, target.  An iteration
    aggregates, over the cells of each source, the words its present rates take
    and the curvature (of documents below the cap).  A step that leaves the
    bracket of multipliers known to be too low and too high halves it instead.
    """
    moments = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"))
    scale = F.coalesce(F.col("squares") / F.nullif(F.col("words").cast("double"), F.lit(0.0)), F.lit(1.0))
    moments = moments.withColumnRenamed("source", "m_source")
    # at the upper end the shortest text reaches the cap; at the lower one no text has a copy
    highest = F.log(F.lit(cap)) * F.col("scale")
    start = F.when(F.col("target") >= cap * F.col("total"), F.col("high")).otherwise(0.0)
    state = due.join(moments, due["source"].eqNullSafe(moments["m_source"])).select("source", "total", "target", scale.alias("scale"))
    state = checkpointed(state.withColumn("low", -700.0 * F.col("scale")).withColumn("high", highest).withColumn("multiplier", start).withColumn("missing", F.lit(0.0)))
    few = state.count() <= MOST_BROADCAST
    kept = ["total", "target", "scale", "low", "high"]
    taken = F.least(F.lit(cap), F.exp(F.col("multiplier") * F.col("size") / F.col("scale"))) * F.col("size") * F.col("n")
    free = F.col("multiplier") * F.col("size") / F.col("scale") < F.log(F.lit(cap))
    for iteration in range(1, iterations + 1):
        present = state.drop("missing").withColumnRenamed("source", "s_source")
        joined = cells.join(F.broadcast(present) if few else present, cells["source"].eqNullSafe(present["s_source"]))
        sums = joined.groupBy("source").agg(
            *(F.first(c).alias(c) for c in [*kept, "multiplier"]),
            F.sum(taken).alias("taken"),
            F.sum(F.when(free, taken * F.col("size") / F.col("scale")).otherwise(0.0)).alias("curvature"),
        )
        gradient = F.col("taken") - F.col("target")
        settled = (F.abs(gradient) <= tolerance * F.col("target")) | (F.col("target") >= cap * F.col("total"))
        low = F.when(gradient < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gradient > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - gradient / F.nullif(F.col("curvature"), F.lit(0.0))
        moved = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        state = checkpointed(sums.select("source", "total", "target", "scale", low.alias("low"), high.alias("high"), F.when(settled, F.col("multiplier")).otherwise(moved).alias("multiplier"), F.when(settled, 0.0).otherwise(1.0).alias("missing")))
        if not state.agg(F.max("missing")).first()[0]:
            break
    return state.select("source", "scale", "multiplier"), iteration


_PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("extra", T.LongType())])


def diffuse(sizes: np.ndarray, counts: np.ndarray, rates: np.ndarray, cap: float = CAP) -> tuple[np.ndarray, np.ndarray]:
    """Copies for all of a size, and how many of its documents get one more.

    ``sizes`` descend; the words taken follow the words due.  Copies stay within
    one of the whole numbers on both sides of the rate, and within the cap.
    """
    low = np.floor(rates).astype(np.int64)
    least, most = (np.maximum(low - 1, 0) * counts).tolist(), (np.minimum(low + 2, int(cap)) * counts).tolist()
    chosen, missing = [], 0.0
    for i, (size, due) in enumerate(zip(sizes.tolist(), (rates * counts).tolist())):
        chosen.append(min(max(round(due + missing / size if size else due), least[i]), most[i]))
        missing += (due - chosen[i]) * size
    copies = np.array(chosen, np.int64)
    return copies // counts, copies % counts


def plan_copies(cells: DataFrame, multipliers: DataFrame, cap: float = CAP) -> DataFrame:
    """source, size, copies, extra for each cell.

    A group is one source's different sizes: as many rows as document lengths
    occur, however many documents there are.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        copies, extra = diffuse(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy(), cap)
        return pd.DataFrame({"source": [None if key[1] else key[0]] * len(pdf), "size": pdf["size"].to_numpy(), "copies": copies, "extra": extra})

    present = multipliers.withColumnRenamed("source", "s_source")
    rated = cells.join(present, cells["source"].eqNullSafe(present["s_source"])).select("source", "size", "n", rate(cap).alias("rate"))
    keyed = rated.select("source", "size", "n", "rate", F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"))
    return keyed.groupBy("key", "none").applyInPandas(run, _PLAN)


def _measures(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    """doc_id, source, size in words, and a hash of the id; native expressions."""
    doc_id = docs[id_col].cast("long")
    return [
        doc_id.alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(doc_id).alias("h"),
        F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).alias("bucket"),
    ]


def _assigned(sized: DataFrame, carried: DataFrame, weights: Sequence[float], cap: float) -> tuple[DataFrame, DataFrame]:
    """(rows of ``carried`` with taken_copies; source, source_size, target).

    ``sized`` has the measures of all documents, ``carried`` the same ones with
    whatever else is to be kept.
    """
    buckets = checkpointed(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    cells = checkpointed(buckets.groupBy("source", "size").agg(F.sum("n").alias("n")))
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    goals = checkpointed(with_targets(ranked(totals), weights, cap).select("source", "total", "target"))
    multipliers, _ = solve_dual(cells, goals, cap)
    plan = plan_copies(cells, multipliers, cap)
    due = goals.select(F.col("source").alias("at"), F.col("total").alias("source_size"), "target")
    # how many documents of a cell come before a bucket in the order of the hashes
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("n")
    counted = buckets.withColumn("before", before)
    planned = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "copies", "extra")
    b = counted.join(planned, counted["source"].eqNullSafe(planned["p_source"]) & (counted["size"] == planned["p_size"]))
    share = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before")))
    b = checkpointed(b.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "copies", F.col("n").alias("b_n"), share.alias("share")))

    def within(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side, rows["source"].eqNullSafe(side["b_source"]) & (rows["size"] == side["b_size"]) & (rows["bucket"] == side["b_bucket"]))

    # the last document of a boundary bucket that gets one more, by hash and id
    place = F.struct("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"))
    rank = F.row_number().over(Window.partitionBy("b_source", "b_size", "b_bucket").orderBy("place"))
    split = within(sized, b.filter("share > 0 and share < b_n")).withColumn("place", place)
    last = split.withColumn("r", rank).filter("r = share").select(F.col("b_source").alias("l_source"), F.col("b_size").alias("l_size"), F.col("b_bucket").alias("l_bucket"), F.col("place").alias("last"))
    b = checkpointed(b.join(last, b["b_source"].eqNullSafe(last["l_source"]) & (b["b_size"] == last["l_size"]) & (b["b_bucket"] == last["l_bucket"]), "left").drop("l_source", "l_size", "l_bucket"))
    more = (F.col("share") == F.col("b_n")) | F.coalesce(place <= F.col("last"), F.lit(False))
    return within(carried, b).withColumn("taken_copies", F.col("copies") + F.when(more, 1).otherwise(0)), due


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken."""
    sized = checkpointed(docs.select(*_measures(docs, id_col, text_col, source_col)))
    rows, due = _assigned(sized, sized, weights, cap)
    joined = rows.join(due, rows["source"].eqNullSafe(due["at"]))
    return joined.select("doc_id", "size", "source_size", "target", F.col("taken_copies").alias("copies"), (F.col("size") * F.col("taken_copies")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    names = docs.columns
    measures = _measures(docs, id_col, text_col, source_col)
    sized = checkpointed(docs.select(*measures))
    rows, _ = _assigned(sized, docs.select(*measures, F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(names))).alias("mr_row")), weights, cap)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("taken_copies").cast("int")))
    return rows.select("mr_row", copies.alias("mr_copy")).select(*(F.col(f"mr_row.c{i}").alias(c) for i, c in enumerate(names)))
