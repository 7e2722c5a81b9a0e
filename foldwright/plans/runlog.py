"""Analysis of run logs: numbering, incumbents, budgets, reuse savings and summaries.

A log row is one evaluation of a configuration.  Logs of one stamp can be long, so everything
that depends on the order of the rows uses :func:`foldwright.operators.ordered.running`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.constants import FAILED_COST, MIN_STAGE_SECONDS
from foldwright.operators.ordered import Running, running


def number_runs(log: DataFrame, keys: list[str], order: list[str], name: str = "eval") -> DataFrame:
    """1-based evaluation number per stamp."""
    return running(log, keys, order, [Running(name, "count")])


def incumbents(log: DataFrame, keys: list[str], order: list[str], cost: str = "cost") -> DataFrame:
    """Rows whose cost is strictly below every earlier cost, with their own number."""
    seen = running(log, keys, order, [Running("_best", "min", cost, exclusive=True)])
    better = seen.filter(F.col("_best").isNull() | (F.col(cost) < F.col("_best"))).drop("_best")
    return number_runs(better, keys, order)


def wallclock(log: DataFrame, keys: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """Add ``eval`` and ``wallclock_time``: the seconds since the first row of the stamp."""
    micros = log.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    out = running(micros, keys, order, [Running("eval", "count"), Running("_start", "min", "_us")])
    return out.withColumn("wallclock_time", (F.col("_us") - F.col("_start")) / 1e6).drop("_us", "_start")


def within_budget(timed: DataFrame, seconds: float | None = None, runs: int | None = None) -> DataFrame:
    """Rows before the budget is exhausted; both limits are strict, and no limit keeps everything."""
    cut: Column = F.lit(False)
    if seconds:
        cut = cut | (F.col("wallclock_time") > seconds)
    if runs:
        cut = cut | (F.col("eval") > runs)
    return timed.filter(~cut)


def cumulative_hits(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running totals of reuse hits and of evaluated stages."""
    return running(log, keys, order, [Running("cache_hits", "sum", "hits"), Running("total_evaluations", "sum", "calls")])


def hit_ratio(log: DataFrame, keys: list[str]) -> DataFrame:
    """calls, fits, hits = calls - fits, and their ratio per group."""
    hits = F.sum("calls") - F.sum("fits")
    return log.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("fits").alias("fits"), hits.alias("hits"), (hits / F.sum("calls")).alias("ratio")
    )


def first_seen(log: DataFrame, prefix: str, order: str, runtime: str = "runtime") -> DataFrame:
    """(prefix, first_eval, first_runtime): the stored runtime of every prefix; it is never updated."""
    return log.groupBy(prefix).agg(F.min(order).alias("first_eval"), F.min_by(runtime, order).alias("first_runtime"))


def add_back_runtime(runs: DataFrame, prefixes: DataFrame, run_id: str, prefix: str, order: str) -> DataFrame:
    """Add to every run the stored runtime of each of its prefixes that an earlier run had.

    ``prefixes`` is (run_id, order, prefix, prefix_runtime).  A frequent prefix makes a skewed join
    key; the other side has one row per prefix, so the split of the left side is free.
    """
    stored = first_seen(prefixes, prefix, order, "prefix_runtime")
    extra = (
        prefixes.join(stored, prefix)
        .groupBy(run_id)
        .agg(F.sum(F.when(F.col(order) > F.col("first_eval"), F.col("first_runtime")).otherwise(0.0)).alias("_extra"))
    )
    return runs.join(extra, run_id, "left").withColumn("runtime_without_reuse", F.col("runtime") + F.coalesce("_extra", F.lit(0.0))).drop("_extra")


def reuse_discount(prefixes: DataFrame, cache: DataFrame, config_id: str = "config_id", prefix: str = "prefix_key") -> DataFrame:
    """(config_id, discount): stored runtimes of the prefixes of a configuration that are in the cache."""
    return (
        prefixes.join(cache.select(prefix, F.col("runtime").alias("_r")), prefix, "left")
        .groupBy(config_id)
        .agg(F.sum(F.coalesce("_r", F.lit(0.0))).alias("discount"))
    )


def distinct_prefixes(prefixes: DataFrame, prefix: str = "prefix_key") -> DataFrame:
    return prefixes.select(prefix).distinct()


def worth_keeping(stages: DataFrame, minimum: float = MIN_STAGE_SECONDS) -> DataFrame:
    """Stages that ran longer than the minimum, or that were already a hit."""
    return stages.filter((F.col("runtime") > minimum) | F.col("hit"))


def mean_cost(log: DataFrame, config: str) -> DataFrame:
    return log.groupBy(config).agg(F.avg("cost").alias("mean_cost"), F.count(F.lit(1)).alias("runs"))


def best_config(log: DataFrame, config: str, keys: list[str] | None = None) -> DataFrame:
    """Configuration with the lowest mean cost; the smaller configuration on a tie."""
    means = log.groupBy(*(keys or []), config).agg(F.avg("cost").alias("mean_cost"))
    first = F.struct(F.col("mean_cost"), F.col(config))
    return means.groupBy(*(keys or [])).agg(F.min(first).alias("b")).select(*(keys or []), F.col(f"b.{config}").alias(config), "b.mean_cost")


def step_totals(log: DataFrame, timing: str = "pipeline_steps_timing", keys: list[str] | None = None) -> DataFrame:
    """Summed seconds per step of a MAP<STRING,DOUBLE> column."""
    return (
        log.select(*(keys or []), F.explode(timing).alias("step", "_s"))
        .groupBy(*(keys or []), "step")
        .agg(F.sum("_s").alias("seconds"), F.count(F.lit(1)).alias("calls"))
    )


def compare_passes(log: DataFrame, keys: list[str], pass_col: str, passes: list[str], runtime: str = "runtime") -> DataFrame:
    """Mean runtime per pass as columns, and the speed-up of the last pass over the first."""
    wide = log.groupBy(*keys).pivot(pass_col, passes).agg(F.avg(runtime))
    return wide.withColumn("speedup", F.col(passes[0]) / F.col(passes[-1]))


def repeat_means(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("repeats"))


def run_status(log: DataFrame, exit_status: str = "exit_status", result: str = "result") -> DataFrame:
    """Map how a run ended to (status, cost): only a finished run keeps its result."""
    status = (
        F.when(F.col(exit_status) == "timeout", "TIMEOUT")
        .when(F.col(exit_status) == "memory", "MEMOUT")
        .when((F.col(exit_status) == "0") & F.col(result).isNotNull(), "SUCCESS")
        .otherwise("CRASHED")
    )
    out = log.withColumn("status", status)
    return out.withColumn("cost", F.when(F.col("status") == "SUCCESS", F.col(result)).otherwise(F.lit(FAILED_COST)))


def attach_test_scores(trajectory: DataFrame, scores: DataFrame, config: str) -> DataFrame:
    """Left join of the test error onto every incumbent."""
    return trajectory.join(scores.select(config, F.col("test_error").alias("test_performance")), config, "left")


def replay_summary(log: DataFrame, keys: list[str], config: str, order: str) -> DataFrame:
    """Per stamp: the incumbent, its cost, evaluations, hit ratio and total runtime saved."""
    return log.groupBy(*keys).agg(
        F.min_by(config, F.struct("cost", order)).alias("incumbent"),
        F.min("cost").alias("best_cost"),
        F.count(F.lit(1)).alias("evaluations"),
        (F.sum("hits") / F.sum("calls")).alias("hit_ratio"),
        F.sum("saved").alias("saved"),
    )
