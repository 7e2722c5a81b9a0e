"""Run-log analysis over the events: user is the stamp, value the cost, event type the step."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.plans import runlog as L
from workloads.base import query, r, table

ORDER = ["ts", "event_id"]
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
_NUMBERED = f"e AS (SELECT event_id, ts, user_id AS stamp, event_type AS step, value AS cost, {_K} AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS eval FROM events)"


def run_log(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("stamp"), F.col("event_type").alias("step"), F.col("value").alias("cost"), k.alias("k")
    )


def with_prefix(log):
    return log.withColumn("prefix_key", F.md5(F.concat_ws(":", "step", (F.col("k") % 10).cast("string"))))


_PREFIX = "md5(step || ':' || CAST(k % 10 AS VARCHAR))"


@query("run_numbers", f"WITH {_NUMBERED} SELECT event_id, stamp, eval FROM e")
def _(spark, sf):
    return L.number_runs(run_log(spark, sf), ["stamp"], ORDER).select("event_id", "stamp", "eval")


@query(
    "incumbent_trajectory",
    f"""WITH {_NUMBERED}, b AS (SELECT *, min(cost) OVER (PARTITION BY stamp ORDER BY eval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
SELECT event_id, stamp, round(cost, 6) AS cost, row_number() OVER (PARTITION BY stamp ORDER BY eval) AS eval FROM b WHERE best IS NULL OR cost < best""",
)
def _(spark, sf):
    out = L.incumbents(run_log(spark, sf), ["stamp"], ORDER)
    return out.select("event_id", "stamp", F.round("cost", 6).alias("cost"), "eval")


@query(
    "incumbent_trajectory_global",
    """WITH b AS (SELECT event_id, value, min(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, ts FROM events)
SELECT event_id, round(value, 6) AS cost, row_number() OVER (ORDER BY ts, event_id) AS eval FROM b WHERE best IS NULL OR value < best""",
)
def _(spark, sf):
    out = L.incumbents(run_log(spark, sf), [], ORDER)
    return out.select("event_id", F.round("cost", 6).alias("cost"), "eval")


_TIMED = f"{_NUMBERED}, w AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY stamp)) / 1e6 AS wallclock_time FROM e)"


@query("wallclock_offsets", f"WITH {_TIMED} SELECT event_id, stamp, eval, round(wallclock_time, 6) AS wallclock_time FROM w")
def _(spark, sf):
    out = L.wallclock(run_log(spark, sf), ["stamp"], ORDER)
    return out.select("event_id", "stamp", "eval", F.round("wallclock_time", 6).alias("wallclock_time"))


@query("within_budget", f"WITH {_TIMED} SELECT event_id, stamp, eval FROM w WHERE NOT (wallclock_time > 1000000 OR eval > 40)")
def _(spark, sf):
    out = L.within_budget(L.wallclock(run_log(spark, sf), ["stamp"], ORDER), 1_000_000.0, 40)
    return out.select("event_id", "stamp", "eval")


_HITS = f"{_NUMBERED}, h AS (SELECT *, {_PREFIX} AS prefix_key FROM e), g AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY stamp, prefix_key ORDER BY eval) > 1 THEN 1 ELSE 0 END AS hit FROM h)"


def _with_hits(spark, sf):
    """A row is a hit when its stamp had the same prefix before."""
    log = with_prefix(run_log(spark, sf))
    first = log.groupBy("stamp", "prefix_key").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    joined = log.join(first, ["stamp", "prefix_key"])
    return joined.withColumn("hits", (F.col("f.event_id") != F.col("event_id")).cast("bigint")).withColumn("calls", F.lit(1).cast("bigint")).drop("f")


@query(
    "cumulative_hits",
    f"WITH {_HITS} SELECT event_id, stamp, CAST(sum(hit) OVER o AS BIGINT) AS cache_hits, count(*) OVER o AS total_evaluations FROM g WINDOW o AS (PARTITION BY stamp ORDER BY eval)",
)
def _(spark, sf):
    return L.cumulative_hits(_with_hits(spark, sf), ["stamp"], ORDER).select("event_id", "stamp", "cache_hits", "total_evaluations")


@query(
    "hit_ratio",
    f"WITH {_HITS} SELECT step, count(*) AS calls, CAST(count(*) - sum(hit) AS BIGINT) AS fits, CAST(sum(hit) AS BIGINT) AS hits, round(sum(hit) / count(*), 6) AS ratio FROM g GROUP BY step",
)
def _(spark, sf):
    log = _with_hits(spark, sf).withColumn("fits", F.col("calls") - F.col("hits"))
    return L.hit_ratio(log, ["step"]).withColumn("ratio", F.round("ratio", 6))


_TWO = """p AS (SELECT event_id, cost, unnest([md5('coarse:' || step), md5('fine:' || step || ':' || CAST(k % 10 AS VARCHAR))]) AS prefix_key, unnest([cost / 10, cost / 5]) AS prefix_runtime FROM e)"""


def _two_prefixes(log):
    """Every run has a coarse and a fine prefix with its own stage runtime."""
    coarse = F.struct(F.md5(F.concat_ws(":", F.lit("coarse"), "step")).alias("prefix_key"), (F.col("cost") / 10).alias("prefix_runtime"))
    fine = F.struct(F.md5(F.concat_ws(":", F.lit("fine"), "step", (F.col("k") % 10).cast("string"))).alias("prefix_key"), (F.col("cost") / 5).alias("prefix_runtime"))
    return log.select("event_id", "cost", F.explode(F.array(coarse, fine)).alias("p")).select("event_id", "cost", "p.prefix_key", "p.prefix_runtime")


@query(
    "first_seen_add_back",
    f"""WITH {_NUMBERED}, {_TWO}, f AS (SELECT prefix_key, min(event_id) AS first_eval, arg_min(prefix_runtime, event_id) AS rt FROM p GROUP BY prefix_key),
x AS (SELECT event_id, sum(CASE WHEN event_id > first_eval THEN rt ELSE 0 END) AS extra FROM p JOIN f USING (prefix_key) GROUP BY event_id)
SELECT event_id, round(cost, 4) AS runtime, round(cost + extra, 4) AS runtime_without_reuse FROM e JOIN x USING (event_id)""",
)
def _(spark, sf):
    log = run_log(spark, sf)
    runs = log.select("event_id", F.col("cost").alias("runtime"))
    out = L.add_back_runtime(runs, _two_prefixes(log), "event_id", "prefix_key", "event_id")
    return out.select("event_id", F.round("runtime", 4).alias("runtime"), F.round("runtime_without_reuse", 4).alias("runtime_without_reuse"))


@query(
    "first_seen_runtimes",
    f"WITH {_NUMBERED}, {_TWO} SELECT prefix_key, min(event_id) AS first_eval, round(arg_min(prefix_runtime, event_id), 6) AS first_runtime FROM p GROUP BY prefix_key",
)
def _(spark, sf):
    return L.first_seen(_two_prefixes(run_log(spark, sf)), "prefix_key", "event_id", "prefix_runtime").withColumn("first_runtime", F.round("first_runtime", 6))


@query(
    "reuse_discount",
    f"""WITH {_NUMBERED}, {_TWO}, c AS (SELECT prefix_key, arg_min(prefix_runtime, event_id) AS runtime FROM p WHERE cost > 50 GROUP BY prefix_key)
SELECT event_id AS config_id, round(sum(coalesce(runtime, 0)), 6) AS discount FROM p LEFT JOIN c USING (prefix_key) GROUP BY event_id""",
)
def _(spark, sf):
    p = _two_prefixes(run_log(spark, sf))
    cache = p.filter("cost > 50").groupBy("prefix_key").agg(F.min_by("prefix_runtime", "event_id").alias("runtime"))
    return L.reuse_discount(p.withColumnRenamed("event_id", "config_id"), cache).withColumn("discount", F.round("discount", 6))


@query("distinct_prefixes", f"WITH {_NUMBERED}, {_TWO} SELECT DISTINCT prefix_key FROM p")
def _(spark, sf):
    return L.distinct_prefixes(_two_prefixes(run_log(spark, sf)))


@query("stages_worth_keeping", f"WITH {_HITS} SELECT event_id, stamp, hit = 1 AS hit FROM g WHERE cost / 100 > 1.0 OR hit = 1")
def _(spark, sf):
    stages = _with_hits(spark, sf).select("event_id", "stamp", (F.col("cost") / 100).alias("runtime"), (F.col("hits") == 1).alias("hit"))
    return L.worth_keeping(stages).select("event_id", "stamp", "hit")


@query("mean_cost", f"WITH {_NUMBERED} SELECT k AS config, round(avg(cost), 9) AS mean_cost, count(*) AS runs FROM e GROUP BY k")
def _(spark, sf):
    return L.mean_cost(run_log(spark, sf).withColumnRenamed("k", "config"), "config").withColumn("mean_cost", F.round("mean_cost", 9))


@query(
    "best_config",
    f"""WITH {_NUMBERED}, m AS (SELECT stamp, k AS config, avg(cost) AS c FROM e GROUP BY stamp, k)
SELECT stamp, config, round(c, 9) AS mean_cost FROM m QUALIFY row_number() OVER (PARTITION BY stamp ORDER BY c, config) = 1""",
)
def _(spark, sf):
    out = L.best_config(run_log(spark, sf).withColumnRenamed("k", "config"), "config", ["stamp"])
    return out.withColumn("mean_cost", F.round("mean_cost", 9))


@query(
    "step_runtime_totals",
    f"""WITH {_NUMBERED}, t AS (SELECT stamp, unnest([step, 'score']) AS step, unnest([cost / 10, 0.5]) AS s FROM e)
SELECT stamp, step, round(sum(s), 4) AS seconds, count(*) AS calls FROM t GROUP BY stamp, step""",
)
def _(spark, sf):
    log = run_log(spark, sf).withColumn("pipeline_steps_timing", F.create_map(F.col("step"), F.col("cost") / 10, F.lit("score"), F.lit(0.5)))
    return L.step_totals(log, keys=["stamp"]).withColumn("seconds", F.round("seconds", 4))


_PASSES = ["uncached_1", "uncached_2", "cold", "warm"]


@query(
    "timing_passes",
    f"""WITH {_NUMBERED}, t AS (SELECT step, k % 7 AS config, ['uncached_1', 'uncached_2', 'cold', 'warm'][(k // 25) + 1] AS p, cost FROM e),
a AS (SELECT step, config, avg(cost) FILTER (p = 'uncached_1') AS u1, avg(cost) FILTER (p = 'uncached_2') AS u2, avg(cost) FILTER (p = 'cold') AS c, avg(cost) FILTER (p = 'warm') AS w FROM t GROUP BY step, config)
SELECT step, config, round(u1, 9) AS uncached_1, round(u2, 9) AS uncached_2, round(c, 9) AS cold, round(w, 9) AS warm, round(u1 / w, 9) AS speedup FROM a""",
)
def _(spark, sf):
    names = F.array(*[F.lit(p) for p in _PASSES])
    log = run_log(spark, sf).select("step", (F.col("k") % 7).alias("config"), F.get(names, F.floor(F.col("k") / 25).cast("int")).alias("p"), F.col("cost").alias("runtime"))
    out = L.compare_passes(log, ["step", "config"], "p", _PASSES)
    return out.select("step", "config", *[F.round(c, 9).alias(c) for c in [*_PASSES, "speedup"]])


@query("repeat_means", f"WITH {_NUMBERED} SELECT step, round(avg(cost), 9) AS mean, count(cost) AS repeats FROM e GROUP BY step")
def _(spark, sf):
    return L.repeat_means(run_log(spark, sf), ["step"], "cost").withColumn("mean", F.round("mean", 9))


@query(
    "run_status",
    f"""WITH {_NUMBERED}, s AS (SELECT event_id, CASE WHEN k < 10 THEN 'timeout' WHEN k < 20 THEN 'memory' WHEN step = 'error' THEN '1' ELSE '0' END AS x, nullif(k, 33) AS k, cost FROM e)
SELECT event_id, CASE WHEN x = 'timeout' THEN 'TIMEOUT' WHEN x = 'memory' THEN 'MEMOUT' WHEN x = '0' AND k IS NOT NULL THEN 'SUCCESS' ELSE 'CRASHED' END AS status,
       round(CASE WHEN x = '0' AND k IS NOT NULL THEN cost ELSE 1234567890 END, 6) AS cost FROM s""",
)
def _(spark, sf):
    log = run_log(spark, sf)
    ended = F.when(F.col("k") < 10, "timeout").when(F.col("k") < 20, "memory").when(F.col("step") == "error", "1").otherwise("0")
    out = L.run_status(log.select("event_id", ended.alias("exit_status"), F.when(F.col("k") != 33, F.col("cost")).alias("result")))
    return out.select("event_id", "status", F.round("cost", 6).alias("cost"))


@query(
    "trajectory_with_test_scores",
    f"""WITH {_NUMBERED}, b AS (SELECT *, min(cost) OVER (PARTITION BY stamp ORDER BY eval ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e),
i AS (SELECT * FROM b WHERE best IS NULL OR cost < best), t AS (SELECT k, avg(cost) AS s FROM e WHERE k < 60 GROUP BY k)
SELECT event_id, stamp, k AS config, round(s, 9) AS test_performance FROM i LEFT JOIN t USING (k)""",
)
def _(spark, sf):
    log = run_log(spark, sf).withColumnRenamed("k", "config")
    scores = log.filter("config < 60").groupBy("config").agg(F.avg("cost").alias("test_error"))
    out = L.attach_test_scores(L.incumbents(log, ["stamp"], ORDER), scores, "config")
    return out.select("event_id", "stamp", "config", F.round("test_performance", 9).alias("test_performance"))


@query(
    "log_replay_summary",
    f"""WITH {_HITS} SELECT stamp, arg_min(k, (cost, event_id)) AS incumbent, round(min(cost), 6) AS best_cost, count(*) AS evaluations,
round(sum(hit) / count(*), 6) AS hit_ratio, round(sum(CASE WHEN hit = 1 THEN cost / 10 ELSE 0 END), 4) AS saved FROM g GROUP BY stamp""",
)
def _(spark, sf):
    log = _with_hits(spark, sf).withColumn("saved", F.when(F.col("hits") == 1, F.col("cost") / 10).otherwise(0.0))
    out = L.replay_summary(log, ["stamp"], "k", "event_id")
    return out.select("stamp", "incumbent", r("best_cost").alias("best_cost"), "evaluations", r("hit_ratio").alias("hit_ratio"), r("saved", 4).alias("saved"))
