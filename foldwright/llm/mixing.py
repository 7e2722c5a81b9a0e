"""Mixing sources to target weights by entropy balancing.

Among all document rates r with 0 <= r <= LIMIT whose words meet the target of every source, the balanced rates have the least
relative entropy to one copy each.  Their dual is convex with one multiplier per source, and the rates are the exponential tilt
r = min(LIMIT, exp(lambda * size / mean size)).  Newton steps with a bracket solve it; each step sums gradient and curvature
over a (source, size) histogram with one job.  Rates become whole copies by carrying the rounding error in words from document
to document, large ones first, in bounded pieces of a source; what is left over turns single documents over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.common import WORD, drop_stored, store

LIMIT = 3.0
PIECE = 1024


def source_targets(sizes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Word targets from (source, size): source, source_size, docs, weight, target.

    Sources in code-point order, null last, weigh 1, 2, 3 and so on in turn.  A target stops at ``limit`` times the size of its
    source; the excess goes to the others by weight.  The level c with sum(min(limit * size, c * weight)) = total is read off
    prefix sums over the sources ordered by limit * size / weight.  The tables here have one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    totals = totals.withColumn("weight", ((place - 1) % 3 + 1).cast("double")).withColumn("most", limit * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        totals.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    fits = F.col("level") * F.col("weight") <= F.col("most")
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = steps.withColumn("c", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(whole))
    return steps.select(
        "source", "source_size", "docs", "weight", F.least(F.col("most"), F.coalesce(F.col("c") * F.col("weight"), F.col("most"))).alias("target")
    )


def balance(histogram: DataFrame, targets: DataFrame, limit: float = LIMIT, tolerance: float = 1e-6, max_steps: int = 80) -> DataFrame:
    """Multipliers of the dual: source, lam (null where the target is the limit itself), mean.

    ``histogram`` has (source, size, n).  Every step is one aggregation; the state stays a table with a row per source, and only
    the number of open sources reaches the driver.
    """
    state = store(
        targets.select(
            "source", "target", (F.col("source_size") / F.col("docs")).alias("mean"),
            F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            ((F.col("source_size") == 0) | (F.col("target") >= limit * F.col("source_size") * (1 - 1e-12))).alias("closed"),
        ).withColumn("saturated", F.col("closed")),
        "dual",
    )
    z = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
    inside = tilt < limit
    words = F.col("n") * F.col("size")
    for _ in range(max_steps):
        if state.filter(~F.col("closed")).isEmpty():
            break
        open_state = state.filter(~F.col("closed")).select(F.col("source").alias("of"), "lam", "mean")
        sums = (
            histogram.join(open_state, F.col("source").eqNullSafe(F.col("of")))
            .groupBy("source")
            .agg(F.sum(words * F.least(tilt, F.lit(limit))).alias("got"), F.sum(F.when(inside, words * z * tilt).otherwise(0.0)).alias("slope"))
            .select(F.col("source").alias("of"), "got", "slope")
        )
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.col("slope")
        reach = F.greatest(F.lit(1.0), F.abs(F.col("lam")))
        fallback = F.when(F.col("low2").isNull(), F.col("high2") - reach).when(F.col("high2").isNull(), F.col("low2") + reach).otherwise((F.col("low2") + F.col("high2")) / 2)
        lower = F.coalesce(F.col("low2"), F.col("high2") - 4 * reach)
        upper = F.coalesce(F.col("high2"), F.col("low2") + 4 * reach)
        good = (F.col("slope") > 0) & (newton > lower) & (newton < upper)
        close = (F.abs(gap) <= tolerance * F.col("target")) | ((F.col("high2") - F.col("low2")) <= 1e-13 * reach)
        after = (
            state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
            .withColumn("low2", low).withColumn("high2", high)
            .withColumn("done", F.col("closed") | F.coalesce(close, F.lit(False)))
            .select(
                "source", "target", "mean", F.when(F.col("done"), F.col("lam")).when(good, newton).otherwise(fallback).alias("lam"),
                F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("done").alias("closed"), "saturated",
            )
        )
        after = store(after, "dual")
        drop_stored(state)
        state = after
    return state.select("source", F.when(~F.col("saturated"), F.col("lam")).alias("lam"), "mean")


def carry_rounding(piece: pa.Table) -> pa.Table:
    """Whole copies of one piece: the error in words is carried on, largest documents first."""
    piece = piece.take(pc.sort_indices(piece, sort_keys=[("size", "descending"), ("doc_id", "ascending"), ("text_key", "ascending")]))
    sizes, rates = piece["size"].to_numpy(), piece["rate"].to_numpy()
    copies = np.floor(rates + 1e-9).astype(np.int64)
    error = 0.0
    for i, (s, part) in enumerate(zip(sizes.tolist(), (rates - copies).tolist(), strict=True)):
        if s and part > 0:
            error += part * s
            if 2 * error >= s:
                copies[i] += 1
                error -= s
    open_rates = rates > np.floor(rates + 1e-9)
    while True:  # turn single documents over while that brings the piece nearer to its words
        up = np.where(open_rates & (copies <= rates), np.abs(error - sizes), np.inf)
        down = np.where(open_rates & (copies > rates), np.abs(error + sizes), np.inf)
        i, step = (int(up.argmin()), 1) if up.min(initial=np.inf) <= down.min(initial=np.inf) else (int(down.argmin()), -1)
        if not len(sizes) or min(up[i], down[i]) >= abs(error):
            break
        copies[i] += step
        error -= step * int(sizes[i])
    return piece.drop_columns(["piece"]).append_column("copies", pa.array(copies))


def mix_sources(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per input row: doc_id, source, text_key, size, source_size, target, rate, copies, taken.

    size counts the words of the whole text (null: 0); copies is 0 to ``limit``; taken = copies * size.  Rows of size 0 have rate 1
    and take no words.  Null sources form one source.  Repeated rows are separate rows; equal sizes are rounded in id order, so
    reruns agree.  An empty table, or one without words, gives no taken words.  Pieces are hashed so that none holds much more
    than PIECE documents, whatever the size of the source.
    """
    rows = store(
        docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "sizes",
    )
    targets = store(source_targets(rows, limit), "targets")
    histogram = store(rows.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    duals = balance(histogram, targets, limit)
    sources = targets.select(F.col("source").alias("of"), "source_size", "target", "docs").join(
        duals.select(F.col("source").alias("also"), "lam", "mean"), F.col("of").eqNullSafe(F.col("also"))
    )
    tilt = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))), F.lit(limit))
    # nine digits: sums taken in another order must not turn a document over
    rate = F.round(F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(tilt, F.lit(limit))), 9)
    rated = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    piece = F.pmod(F.xxhash64("doc_id", "text_key"), F.ceil(F.col("docs") / PIECE))
    rated = rated.select("doc_id", "source", "text_key", "size", "rate", piece.alias("piece"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rated.drop("piece").schema)
    copies = rated.groupBy("source", "piece").applyInArrow(carry_rounding, f"{fields}, copies long")
    return copies.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as its copies say, with the columns of ``docs``.

    Rows that agree in doc_id, source and text are one document whose copies are added.
    """
    copies = mix_sources(docs, limit).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").cast("int").alias("n")).filter("n > 0")
    copies = copies.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("text_key").alias("mix_key"), "n")
    left = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("a"), F.col("source").alias("b"), F.xxhash64("text").alias("c"))
    left = left.dropDuplicates(["a", "b", "c"])
    same = F.col("a").eqNullSafe(F.col("mix_id")) & F.col("b").eqNullSafe(F.col("mix_source")) & (F.col("c") == F.col("mix_key"))
    return left.join(copies, same).select("row", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("row.*")
