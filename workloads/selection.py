"""Evaluation of configurations on folds of the given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators.folds import stratified_folds
from foldwright.plans.evaluate import evaluate, random_search, test_error
from foldwright.plans.runlog import best_config
from foldwright.plans.trie import evaluate_trie
from workloads.base import query, r, table, vectors


def make_config(rescaling: str, preprocessor: str, classifier: str, **params: str) -> dict[str, str]:
    base = {
        "one_hot_encoder:__choice__": "one_hot_encoding",
        "imputation:__choice__": "imputer",
        "imputation:imputer:strategy": "mean",
        "rescaling:__choice__": rescaling,
        "balancing:__choice__": "balancer",
        "feature_preprocessor:__choice__": preprocessor,
        "classifier:__choice__": classifier,
    }
    return {**base, **params}


CONFIGS = [
    ("scaled-gaussian", make_config("standard_scaler", "no_preprocessing", "gaussian_nb")),
    ("scaled-lda", make_config("standard_scaler", "no_preprocessing", "lda")),
    ("ranged-percentile", make_config("minmax", "select_percentile", "multinomial_nb", **{"feature_preprocessor:select_percentile:percentile": "50"})),
    ("broken-qda", make_config("standard_scaler", "no_preprocessing", "qda", **{"classifier:qda:reg_param": "9.5"})),
]


@query("evaluate_shared_prefix")
def _(spark, sf):
    rows = stratified_folds(vectors(spark, sf), 2)
    out = evaluate(rows, CONFIGS, 10, 2)
    return out.select("config_id", "fold", "status", "prefix_hit", r("cost").alias("cost"))


@query("evaluate_without_sharing")
def _(spark, sf):
    rows = stratified_folds(vectors(spark, sf), 2)
    out = evaluate(rows, CONFIGS, 10, 2, share_prefix=False)
    return out.select("config_id", "fold", "status", "prefix_hit", r("cost").alias("cost"))


@query("held_out_test_error")
def _(spark, sf):
    df = vectors(spark, sf)
    error = test_error(df.filter("row_id % 5 <> 0"), df.filter("row_id % 5 = 0"), CONFIGS[0][1], 10)
    return df.agg(F.count(F.lit(1)).alias("rows_used")).withColumn("test_error", F.round(F.lit(error), 6))


@query("random_search_best")
def _(spark, sf):
    rows = stratified_folds(vectors(spark, sf), 2)
    log = random_search(rows, 6, 10, 2, seed=3, preprocessors=["no_preprocessing", "select_percentile", "pca"], classifiers=["gaussian_nb", "bernoulli_nb", "lda"])
    return best_config(log, "config_id").withColumn("mean_cost", F.round("mean_cost", 6))


_ORDER_ROWS = """
item AS (SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, (o_orderkey % 3)::INT AS fold,
                [CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END, (o_custkey % 50)::DOUBLE, year(o_orderdate) - 1990.0, month(o_orderdate)::DOUBLE] AS x,
                CASE WHEN o_custkey % 11 = 0 THEN 2 ELSE least(o_custkey % 13, 4) + 3 END AS code FROM orders)"""

TRIE_CONFIGS = [
    (f"{strategy}-{name}", make_config(rescaling, "no_preprocessing", classifier, **{"imputation:imputer:strategy": strategy, "one_hot_encoder:one_hot_encoding:minimum_fraction": "0.08"}))
    for strategy in ("mean", "most_frequent")
    for name, rescaling, classifier in (("standard", "standard_scaler", "gaussian_nb"), ("minmax", "minmax", "multinomial_nb"), ("unit", "normalize", "gaussian_nb"), ("plain", "no_rescaling", "bernoulli_nb"))
]


def order_rows(spark, sf):
    """(row_id, label, fold, features) of the orders: four numbers, one with gaps, and a category at position 2 with gaps."""
    c = F.col
    code = F.when(c("o_custkey") % 11 != 0, F.least(c("o_custkey") % 13, F.lit(4)))
    values = [F.when(c("o_orderkey") % 7 != 0, c("o_totalprice")), c("o_custkey") % 50, code, F.year("o_orderdate") - 1990, F.month("o_orderdate")]
    label = F.when(c("o_orderstatus") == "F", 0).when(c("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders").select(
        c("o_orderkey").alias("row_id"), label.alias("label"), (c("o_orderkey") % 3).cast("int").alias("fold"), F.array(*[v.cast("double") for v in values]).alias("features")
    )


@query(
    "trie_fold_costs",
    f"""WITH {_ORDER_ROWS},
held AS (SELECT unnest([0, 1, 2]) AS h),
share AS (SELECT h, code, count(*) / sum(count(*)) OVER (PARTITION BY h) AS part FROM item, held WHERE fold <> h GROUP BY h, code),
kept AS (SELECT DISTINCT h, CASE WHEN part >= 0.08 THEN code ELSE 1 END AS code FROM share),
cells AS (SELECT h, row_id, fold, label, 'n' || i AS pos, x[i] AS x FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM item), held
          UNION ALL
          SELECT k.h, row_id, fold, label, 'c' || k.code, CASE WHEN k.code = coalesce(own.code, 1) THEN 1.0 ELSE 0.0 END
          FROM item JOIN kept k ON true LEFT JOIN kept own ON own.h = k.h AND own.code = item.code),
fills AS (SELECT 'mean' AS strategy, h, pos, avg(x) AS v FROM cells WHERE fold <> h GROUP BY h, pos
          UNION ALL
          SELECT 'most_frequent', h, pos, arg_min(x, (-n, x)) FROM (SELECT h, pos, x, count(*) AS n FROM cells WHERE fold <> h AND x IS NOT NULL GROUP BY h, pos, x) GROUP BY h, pos),
filled AS (SELECT strategy, h, row_id, fold, label, pos, coalesce(x, v) AS x FROM cells JOIN fills USING (h, pos)),
ranges AS (SELECT strategy, h, pos, avg(x) AS mu, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi FROM filled WHERE fold <> h GROUP BY strategy, h, pos),
norms AS (SELECT strategy, h, row_id, sqrt(sum(x * x)) AS norm FROM filled GROUP BY strategy, h, row_id),
scaled AS (SELECT strategy, h, row_id, fold, label, pos,
                  unnest(['standard', 'minmax', 'unit', 'plain']) AS name,
                  unnest([(x - mu) / (CASE WHEN sd = 0 THEN 1 ELSE sd END), (x - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END), x / (CASE WHEN norm = 0 THEN 1 ELSE norm END), x]) AS x
           FROM filled JOIN ranges USING (strategy, h, pos) JOIN norms USING (strategy, h, row_id)),
prior AS (SELECT h, label AS c, count(*) AS n, ln(count(*) / sum(count(*)) OVER (PARTITION BY h)) AS lp FROM item, held WHERE fold <> h GROUP BY h, label),
model AS (SELECT strategy, name, h, label AS c, pos, avg(x) AS mean, var_pop(x) + 1e-9 AS var, sum(greatest(x, 0)) AS total, count(*) FILTER (x > 0) AS positive, count(*) AS n
          FROM scaled WHERE fold <> h GROUP BY strategy, name, h, label, pos),
shares AS (SELECT *, ln((total + 1.0) / (sum(total) OVER w + count(*) OVER w)) AS logp, (positive + 1.0) / (n + 2.0) AS p FROM model WINDOW w AS (PARTITION BY strategy, name, h, c)),
ll AS (SELECT strategy, name, h, row_id, label, c, max(lp) + sum(CASE name WHEN 'minmax' THEN greatest(x, 0) * logp WHEN 'plain' THEN CASE WHEN x > 0 THEN ln(p) ELSE ln(1 - p) END
              ELSE -0.5 * (ln(2 * pi() * var) + (x - mean) * (x - mean) / var) END) AS s
       FROM scaled JOIN shares USING (strategy, name, h, pos) JOIN prior USING (h, c) WHERE fold = h GROUP BY strategy, name, h, row_id, label, c),
pred AS (SELECT strategy, name, h, label, c AS prediction FROM ll QUALIFY row_number() OVER (PARTITION BY strategy, name, h, row_id ORDER BY s DESC, c) = 1),
rec AS (SELECT strategy, name, h, label, greatest(count(*) FILTER (label = prediction), 1e-15) AS tp, count(*) AS n FROM pred GROUP BY strategy, name, h, label)
SELECT strategy || '-' || name AS config_id, h AS fold, 'SUCCESS' AS status, round(1 - (sum(tp / n) + (3 - count(*))) / 3.0, 6) + 0 AS cost FROM rec GROUP BY strategy, name, h""",
)
def _(spark, sf):
    out = evaluate_trie(order_rows(spark, sf), TRIE_CONFIGS, 3, 3, categorical=[2])
    return out.select("config_id", F.col("instance").alias("fold"), "status", r("cost").alias("cost"))


@query("trie_run_records")
def _(spark, sf):
    """Records of a run log: which cached steps each run found, and the totals so far."""
    out = evaluate_trie(order_rows(spark, sf), TRIE_CONFIGS, 3, 3, categorical=[2])
    return out.select("eval", "instance", "config_id", "prefix_hits", "cache_hits", "total_evaluations", r("cost").alias("cost"))
