"""Column statistics, encoding, imputation, scaling, selection and projection over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foldwright.functions.exprs import clip_nonnegative, to_float32, transform_selected
from foldwright.operators.agglomerate import FeatureAgglomeration, column_distances
from foldwright.operators.encode import fit_one_hot
from foldwright.operators.moments import category_frequencies, class_weights, column_stats, label_set_id, with_class_weights
from foldwright.operators.project import (
    PCA,
    FastICA,
    KernelPCA,
    KitchenSinks,
    Nystroem,
    PolynomialFeatures,
    covariance,
)
from foldwright.operators.select import (
    LinearSelect,
    SelectPercentile,
    TreeSelect,
    by_rate,
    chi2_scores,
    f_scores,
    top_percentile,
)
from foldwright.operators.steps import Identity
from foldwright.operators.tabular import Imputer, MinMaxScaler, RowNormalizer, StandardScaler, impute_columns, scale_columns
from foldwright.operators.trees import RandomTreesEmbedding
from workloads.base import SHIFTED_CELLS, item_matrix, query, r, shifted_items, table, vectors

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ITEM_CELLS = """
item AS (SELECT l_orderkey * 10 + l_linenumber AS row_id,
                CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
                [l_quantity, l_extendedprice, l_discount, l_tax] AS v FROM lineitem),
cells AS (SELECT row_id, label, unnest([0, 1, 2, 3]) AS pos, unnest(v) AS x FROM item)
"""
VEC_CELLS = """
cells AS (SELECT vec_id AS row_id, label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
"""


def long_out(df, name="value", digits=6):
    """(row_id, pos, value) of a feature array, to compare cell by cell."""
    return df.select("row_id", F.posexplode_outer("features").alias("pos", "_x")).select("row_id", "pos", r("_x", digits).alias(name))


def column_checksum(df, digits=4):
    """Per output column: count, mean, and extremes over all rows."""
    return df.select(F.posexplode_outer("features").alias("pos", "x")).groupBy("pos").agg(
        F.count("x").alias("n"), r(F.avg("x"), digits).alias("mean"), r(F.min("x"), digits).alias("lo"), r(F.max("x"), digits).alias("hi")
    )


CHECKSUM_SQL = """SELECT pos, count(x) AS n, round(avg(x), 4) + 0 AS mean, round(min(x), 4) + 0 AS lo, round(max(x), 4) + 0 AS hi FROM {t} GROUP BY pos"""


# ---------------------------------------------------------------- statistics

@query(
    "column_stats",
    f"""WITH {ITEM_CELLS}, named AS (SELECT ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][pos + 1] AS "column", nullif(x, 0) AS x FROM cells),
freq AS (SELECT "column", x, count(*) AS c FROM named WHERE x IS NOT NULL GROUP BY ALL),
modes AS (SELECT "column", x AS mode FROM freq QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c DESC, x) = 1)
SELECT "column", count(x) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS min,
       round(max(x), 4) AS max, round(median(x), 4) AS median, round(any_value(mode), 4) AS mode
FROM named JOIN modes USING ("column") GROUP BY "column" """,
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in MEASURES])
    s = column_stats(df, MEASURES)
    return s.select("column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "median", "mode")])


@query(
    "category_frequencies",
    """WITH c AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part
UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part)
SELECT "column", value, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (PARTITION BY "column"), 6) AS share FROM c GROUP BY "column", value""",
)
def _(spark, sf):
    return category_frequencies(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]).withColumn("share", F.round("share", 6))


@query(
    "class_weights",
    """WITH c AS (SELECT l_returnflag AS label, count(*) AS cnt FROM lineitem GROUP BY ALL)
SELECT label, cnt, round((1.0 / cnt) / avg(1.0 / cnt) OVER (), 6) AS weight FROM c""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "label")
    return class_weights(df, "label").withColumn("weight", F.round("weight", 6))


@query(
    "label_set_weights",
    """WITH s AS (SELECT doc_id, CAST(quality + 2 * toxic AS BIGINT) AS label_set FROM labels),
c AS (SELECT label_set, count(*) AS cnt FROM s GROUP BY ALL),
w AS (SELECT label_set, (1.0 / cnt) / avg(1.0 / cnt) OVER () AS weight FROM c)
SELECT doc_id, label_set, round(weight, 6) AS weight FROM s JOIN w USING (label_set)""",
)
def _(spark, sf):
    df = table(spark, sf, "labels").select("doc_id", label_set_id(F.array("quality", "toxic")).alias("label_set"))
    return with_class_weights(df, "label_set").select("doc_id", "label_set", F.round("weight", 6).alias("weight"))


@query("class_list", "SELECT DISTINCT CAST(label AS INTEGER) AS label FROM embeddings")
def _(spark, sf):
    return vectors(spark, sf).select(F.col("label").cast("int").alias("label")).distinct()


# ---------------------------------------------------------------- one-hot

def one_hot_sql(fraction: float | None) -> str:
    kept = f"CASE WHEN cnt / sum(cnt) OVER (PARTITION BY col) >= {fraction} THEN raw ELSE 1 END" if fraction else "raw"
    return f"""
WITH raws AS (
  SELECT p_partkey, unnest([0, 1, 2]) AS col,
         unnest([CAST(substr(p_brand, 7) AS BIGINT) + 3, p_size + 3, coalesce(nullif(p_size % 7, 0) + 3, 2)]) AS raw FROM part),
freq AS (SELECT col, raw, count(*) AS cnt FROM raws GROUP BY ALL),
codes AS (SELECT col, raw, {kept} AS code FROM freq),
dict AS (SELECT col, code, row_number() OVER (ORDER BY col, code) - 1 AS out FROM (SELECT DISTINCT col, code FROM codes))
SELECT p_partkey, string_agg(CAST(out AS VARCHAR), ',' ORDER BY out) AS active
FROM raws JOIN codes USING (col, raw) JOIN dict USING (col, code) GROUP BY p_partkey"""


def _one_hot(spark, sf, fraction):
    df = table(spark, sf, "part").select(
        "p_partkey",
        F.substring("p_brand", 7, 4).cast("double").alias("brand"),
        F.col("p_size").cast("double").alias("size"),
        F.nullif(F.col("p_size") % 7, F.lit(0)).cast("double").alias("phase"),
    )
    model = fit_one_hot(df, ["brand", "size", "phase"], fraction)
    return model.transform(df).select("p_partkey", F.array_join("active", ",").alias("active"))


@query("one_hot_minimum_fraction", one_hot_sql(0.021))
def _(spark, sf):
    return _one_hot(spark, sf, 0.021)


@query("one_hot_all_values", one_hot_sql(None))
def _(spark, sf):
    return _one_hot(spark, sf, None)


# ---------------------------------------------------------------- imputation and scaling

def _impute_sql(value: str) -> str:
    return f"""
WITH t AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS d, nullif(l_quantity, 1) AS q FROM lineitem),
f AS (SELECT {value.format(c='d')} AS fd, {value.format(c='q')} AS fq FROM t)
SELECT l_orderkey, l_linenumber, round(coalesce(d, fd), 6) AS d, round(coalesce(q, fq), 6) AS q FROM t, f"""


def _impute(spark, sf, strategy):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("d"), F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("q")
    )
    return impute_columns(df, ["d", "q"], strategy).select("l_orderkey", "l_linenumber", F.round("d", 6).alias("d"), F.round("q", 6).alias("q"))


@query("impute_mean", _impute_sql("avg({c})"))
def _(spark, sf):
    return _impute(spark, sf, "mean")


@query("impute_median", _impute_sql("median({c})"))
def _(spark, sf):
    return _impute(spark, sf, "median")


@query(
    "impute_most_frequent",
    _impute_sql("max((SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1))"),
)
def _(spark, sf):
    return _impute(spark, sf, "most_frequent")


@query(
    "impute_array",
    f"""WITH {ITEM_CELLS}, t AS (SELECT row_id, pos, nullif(x, 0) AS x FROM cells), f AS (SELECT pos, avg(x) AS m FROM t GROUP BY pos)
SELECT row_id, pos, round(coalesce(x, m), 6) AS value FROM t JOIN f USING (pos)""",
)
def _(spark, sf):
    df = item_matrix(spark, sf).withColumn("features", F.transform("features", lambda x: F.nullif(x, F.lit(0.0))))
    return long_out(Imputer("mean").fit(df).transform(df))


@query(
    "standard_scaler",
    f"""WITH {VEC_CELLS}, p AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM cells GROUP BY pos)
SELECT row_id, pos, round((x - m) / s, 6) + 0 AS value FROM cells JOIN p USING (pos)""",
)
def _(spark, sf):
    df = vectors(spark, sf)
    return long_out(StandardScaler().fit(df).transform(df))


@query(
    "standard_scaler_large_mean",
    f"""WITH {SHIFTED_CELLS}, p AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY pos)
SELECT row_id, pos, round((x - m) / s, 4) + 0 AS value FROM cells JOIN p USING (pos)""",
)
def _(spark, sf):
    df = shifted_items(spark, sf)
    return long_out(StandardScaler().fit(df).transform(df)).withColumn("value", r("value", 4))


@query(
    "standard_scaler_columns",
    """WITH p AS (SELECT avg(l_quantity) a, stddev_pop(l_quantity) b, avg(l_tax) c, stddev_pop(l_tax) d FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - a) / b, 6) + 0 AS l_quantity, round((l_tax - c) / d, 6) + 0 AS l_tax FROM lineitem, p""",
)
def _(spark, sf):
    df = scale_columns(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "standard")
    return df.select("l_orderkey", "l_linenumber", r("l_quantity").alias("l_quantity"), r("l_tax").alias("l_tax"))


@query(
    "minmax_scaler",
    f"""WITH {VEC_CELLS}, p AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM cells GROUP BY pos)
SELECT row_id, pos, round(CASE WHEN hi = lo THEN 0 ELSE (x - lo) / (hi - lo) END, 6) + 0 AS value FROM cells JOIN p USING (pos)""",
)
def _(spark, sf):
    df = vectors(spark, sf)
    return long_out(MinMaxScaler().fit(df).transform(df))


@query(
    "row_normalize",
    f"""WITH {VEC_CELLS}, p AS (SELECT row_id, sqrt(sum(x * x)) AS n FROM cells GROUP BY row_id)
SELECT row_id, pos, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0 AS value FROM cells JOIN p USING (row_id)""",
)
def _(spark, sf):
    df = vectors(spark, sf)
    return long_out(RowNormalizer("l2").fit(df).transform(df))


@query(
    "row_normalize_l1",
    f"""WITH {VEC_CELLS}, p AS (SELECT row_id, sum(abs(x)) AS n FROM cells GROUP BY row_id)
SELECT row_id, pos, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0 AS value FROM cells JOIN p USING (row_id)""",
)
def _(spark, sf):
    df = vectors(spark, sf)
    return long_out(RowNormalizer("l1").fit(df).transform(df))


@query("no_rescaling", f"WITH {VEC_CELLS} SELECT row_id, pos, round(x, 6) + 0 AS value FROM cells")
def _(spark, sf):
    df = vectors(spark, sf)
    return long_out(Identity().fit(df).transform(df))


@query("clip_nonnegative", f"WITH {VEC_CELLS} SELECT row_id, pos, round(greatest(x, 0), 6) + 0 AS value FROM cells")
def _(spark, sf):
    return long_out(vectors(spark, sf).withColumn("features", clip_nonnegative("features")))


@query("narrow_float32", "WITH p AS (SELECT o_orderkey, round(CAST(CAST(o_totalprice / 3 AS FLOAT) AS DOUBLE), 2) AS value FROM orders) SELECT * FROM p")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", to_float32(F.array(F.col("o_totalprice") / 3)).alias("a"))
    return df.select("o_orderkey", F.round(F.col("a")[0].cast("double"), 2).alias("value"))


@query(
    "transform_selected_columns",
    f"""WITH {ITEM_CELLS} SELECT row_id, CASE pos WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS pos,
round(CASE WHEN pos IN (1, 3) THEN x * 2 ELSE x END, 6) AS value FROM cells""",
)
def _(spark, sf):
    fn = lambda a: F.transform(a, lambda x: x * 2)
    return long_out(item_matrix(spark, sf).withColumn("features", transform_selected("features", [1, 3], fn)))


# ---------------------------------------------------------------- univariate selection

CHI2_SQL = f"""
{VEC_CELLS}, pos_cells AS (SELECT row_id, label, pos, greatest(x, 0) AS x FROM cells),
obs AS (SELECT label, pos, sum(x) AS o, count(*) AS n FROM pos_cells GROUP BY label, pos),
tot AS (SELECT pos, sum(o) AS s, sum(n) AS n FROM obs GROUP BY pos),
chi AS (SELECT obs.pos, sum((o - obs.n / tot.n * s) * (o - obs.n / tot.n * s) / (obs.n / tot.n * s)) AS score FROM obs JOIN tot USING (pos) GROUP BY obs.pos)
"""
ITEM_CHI2_SQL = CHI2_SQL.replace(VEC_CELLS, ITEM_CELLS)
F_SQL = """
obs AS (SELECT label, pos, sum(x) AS s, sum(x * x) AS ss, count(*) AS n FROM cells GROUP BY label, pos),
tot AS (SELECT pos, sum(s) AS s, sum(ss) AS ss, sum(n) AS n, sum(s * s / n) AS between_, count(*) AS k FROM obs GROUP BY pos),
fs AS (SELECT pos, ((between_ - s * s / n) / (k - 1)) / ((ss - between_) / (n - k)) AS score FROM tot)
"""


@query("chi2_scores", f"WITH {CHI2_SQL} SELECT pos, round(score, 6) AS score FROM chi")
def _(spark, sf):
    return chi2_scores(vectors(spark, sf)).select("pos", F.round("score", 6).alias("score"))


@query("chi2_pvalues", f"WITH {ITEM_CHI2_SQL} SELECT pos, round(score, 4) AS score, round(exp(-score / 2), 6) + 0 AS pvalue FROM chi")
def _(spark, sf):
    return chi2_scores(item_matrix(spark, sf)).select("pos", F.round("score", 4).alias("score"), r("pvalue").alias("pvalue"))


@query("f_scores", f"WITH {VEC_CELLS}, {F_SQL} SELECT pos, round(score, 6) AS score FROM fs")
def _(spark, sf):
    return f_scores(vectors(spark, sf)).select("pos", F.round("score", 6).alias("score"))


@query(
    "select_percentile_chi2",
    f"""WITH {CHI2_SQL} SELECT pos, round(score, 6) AS score FROM chi
WHERE score > (SELECT quantile_cont(score, 0.7) FROM chi)""",
)
def _(spark, sf):
    return top_percentile(chi2_scores(vectors(spark, sf)), 30.0).select("pos", F.round("score", 6).alias("score"))


@query(
    "select_percentile_transform",
    f"""WITH {VEC_CELLS}, {F_SQL},
kept AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS out FROM fs WHERE score > (SELECT quantile_cont(score, 0.8) FROM fs))
SELECT row_id, CAST(out AS INTEGER) AS pos, round(x, 6) + 0 AS value FROM cells JOIN kept USING (pos)""",
)
def _(spark, sf):
    df = vectors(spark, sf)
    return long_out(SelectPercentile(20.0, "f_classif").fit(df).transform(df))


def _rate_sql(condition: str) -> str:
    return f"""WITH {ITEM_CHI2_SQL}, p AS (SELECT pos, exp(-score / 2) AS pvalue, count(*) OVER () AS d, row_number() OVER (ORDER BY exp(-score / 2), pos) AS i FROM chi)
SELECT pos, round(pvalue, 6) + 0 AS pvalue FROM p WHERE {condition}"""


@query("select_rates_fpr", _rate_sql("pvalue < 0.4"))
def _(spark, sf):
    return by_rate(chi2_scores(item_matrix(spark, sf)), 0.4, "fpr").select("pos", r("pvalue").alias("pvalue"))


@query("select_rates_fwe", _rate_sql("pvalue < 0.4 / d"))
def _(spark, sf):
    return by_rate(chi2_scores(item_matrix(spark, sf)), 0.4, "fwe").select("pos", r("pvalue").alias("pvalue"))


@query("select_rates_fdr", _rate_sql("pvalue <= (SELECT max(pvalue) FROM p WHERE pvalue <= 0.5 * i / d)"))
def _(spark, sf):
    return by_rate(chi2_scores(item_matrix(spark, sf)), 0.5, "fdr").select("pos", r("pvalue").alias("pvalue"))


@query(
    "f_pvalues",
    f"""WITH {ITEM_CELLS}, {F_SQL.replace("AS score FROM tot", "AS score, n - k AS d2 FROM tot")}
SELECT pos, round(score, 6) AS score, round(exp(-d2 / 2.0 * ln(1 + 2 * score / d2)), 6) + 0 AS pvalue FROM fs""",
)
def _(spark, sf):
    return f_scores(item_matrix(spark, sf)).select("pos", F.round("score", 6).alias("score"), r("pvalue").alias("pvalue"))


@query(
    "f_scores_large_mean",
    f"""WITH {SHIFTED_CELLS},
obs AS (SELECT label, pos, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM cells GROUP BY label, pos),
tot AS (SELECT pos, avg(x) AS m, count(*) AS n FROM cells GROUP BY pos)
SELECT obs.pos, round(sum(obs.n * (obs.m - tot.m) * (obs.m - tot.m)) / 2 / (sum(obs.n * v) / (any_value(tot.n) - 3)) / any_value(tot.n), 4) + 0 AS score_per_row
FROM obs JOIN tot USING (pos) GROUP BY obs.pos""",
)
def _(spark, sf):
    df = shifted_items(spark, sf)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return f_scores(df).withColumn("n", rows).select("pos", r(F.col("score") / F.col("n"), 4).alias("score_per_row"))


@query("tree_importance_select")
def _(spark, sf):
    df = vectors(spark, sf).persist()
    return column_checksum(TreeSelect(n_estimators=20, max_depth=5).fit(df).transform(df))


@query("linear_model_select")
def _(spark, sf):
    df = vectors(spark, sf).persist()
    return column_checksum(LinearSelect(C=0.1, max_iter=20).fit(df).transform(df))


# ---------------------------------------------------------------- projections

@query(
    "covariance_matrix",
    f"""WITH {VEC_CELLS}, m AS (SELECT pos, avg(x) AS m FROM cells GROUP BY pos),
z AS (SELECT row_id, pos, x - m AS z FROM cells JOIN m USING (pos)), n AS (SELECT count(*) AS n FROM embeddings)
SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(sum(a.z * b.z) / (any_value(n) - 1), 6) + 0 AS cov
FROM z a JOIN z b USING (row_id), n GROUP BY a.pos, b.pos""",
)
def _(spark, sf):
    return covariance(vectors(spark, sf)).select("i", "j", r("cov").alias("cov"))


@query("pca_projection")
def _(spark, sf):
    df = vectors(spark, sf)
    return column_checksum(PCA(0.9).fit(df).transform(df))


@query("pca_whitened_variance", f"WITH {VEC_CELLS} SELECT DISTINCT CAST(pos AS INTEGER) AS pos, 1.0::DOUBLE AS variance, 0.0::DOUBLE AS mean FROM cells WHERE pos < 5")
def _(spark, sf):
    df = vectors(spark, sf)
    out = PCA(n_components=5, whiten=True).fit(df).transform(df)
    cells = out.select(F.posexplode_outer("features").alias("pos", "x"))
    return cells.groupBy("pos").agg(r(F.var_samp("x"), 5).alias("variance"), r(F.avg("x"), 5).alias("mean"))


@query(
    "polynomial_features",
    f"""WITH {ITEM_CELLS.replace("[l_quantity, l_extendedprice, l_discount, l_tax]", "[l_quantity, l_discount * 10, l_tax * 10]").replace("[0, 1, 2, 3]", "[0, 1, 2]")},
w AS (SELECT row_id, v[1] AS a, v[2] AS b, v[3] AS c FROM item)
SELECT row_id, unnest(range(0, 10))::INTEGER AS pos,
       round(unnest([1, a, b, c, a * a, a * b, a * c, b * b, b * c, c * c]), 6) + 0 AS value FROM w""",
)
def _(spark, sf):
    df = item_matrix(spark, sf).withColumn("features", F.array(F.col("features")[0], F.col("features")[2] * 10, F.col("features")[3] * 10))
    return long_out(PolynomialFeatures(2).fit(df).transform(df))


@query(
    "polynomial_interactions",
    f"""WITH {ITEM_CELLS}, w AS (SELECT row_id, v[1] AS a, v[3] * 10 AS b, v[4] * 10 AS c FROM item),
o AS (SELECT unnest(range(0, 7))::INTEGER AS pos, unnest([a, b, c, a * b, a * c, b * c, a * b * c]) AS x FROM w)
{CHECKSUM_SQL.format(t="o")}""",
)
def _(spark, sf):
    df = item_matrix(spark, sf).withColumn("features", F.array(F.col("features")[0], F.col("features")[2] * 10, F.col("features")[3] * 10))
    return column_checksum(PolynomialFeatures(3, interaction_only=True, include_bias=False).fit(df).transform(df))


_SINK_W = np.array([[0.11, -0.07, 0.05], [0.0003, 0.0002, -0.0001], [1.5, -2.5, 0.5], [3.0, 1.0, -2.0]])
_SINK_B = np.array([0.3, 1.7, 4.1])
_SINK_SQL = ", ".join(
    "sqrt(2.0 / 3) * cos(v[1] * {} + v[2] * {} + v[3] * {} + v[4] * {} + {})".format(*_SINK_W[:, j], _SINK_B[j]) for j in range(3)
)


@query("random_fourier_features", f"WITH {ITEM_CELLS}, o AS (SELECT unnest([0, 1, 2]) AS pos, unnest([{_SINK_SQL}]) AS x FROM item) {CHECKSUM_SQL.format(t='o')}")
def _(spark, sf):
    df = item_matrix(spark, sf)
    return column_checksum(KitchenSinks(weights=_SINK_W, offset=_SINK_B).fit(df).transform(df))


@query("random_fourier_features_seeded")
def _(spark, sf):
    df = vectors(spark, sf)
    return column_checksum(KitchenSinks(gamma=0.5, n_components=50).fit(df).transform(df))


@query(
    "nystroem_kernel_rows",
    """WITH land AS (SELECT vec_id AS lid, embedding AS l FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 8)
SELECT vec_id AS row_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY md5(CAST(lid AS VARCHAR)), lid) - 1 AS INTEGER) AS pos,
       round(exp(-0.05 * list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - l[i]::DOUBLE) * (embedding[i]::DOUBLE - l[i]::DOUBLE)))), 6) + 0 AS value
FROM embeddings, land""",
)
def _(spark, sf):
    from foldwright.functions.arrow import map_matrix
    from foldwright.operators.project import kernel_matrix

    df = vectors(spark, sf)
    basis = Nystroem("rbf", n_components=8, gamma=0.05).landmarks(df)
    return long_out(df.withColumn("features", map_matrix(lambda x: kernel_matrix(x, basis, "rbf", 0.05, 3, 0.0), F.col("features"))))


@query("nystroem_map")
def _(spark, sf):
    df = vectors(spark, sf)
    return column_checksum(Nystroem("rbf", n_components=50, gamma=0.05).fit(df).transform(df))


@query("nystroem_chi2_map")
def _(spark, sf):
    df = vectors(spark, sf)
    return column_checksum(Nystroem("chi2", n_components=50, gamma=0.1).fit(df).transform(df))


@query("kernel_pca")
def _(spark, sf):
    df = vectors(spark, sf)
    return column_checksum(KernelPCA(n_components=10, kernel="rbf", gamma=0.05, landmarks=100).fit(df).transform(df))


@query("fast_ica")
def _(spark, sf):
    df = vectors(spark, sf).persist()
    return column_checksum(FastICA(n_components=10, max_iter=15).fit(df).transform(df), 2)


@query(
    "column_distances_euclidean",
    f"""WITH {VEC_CELLS} SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 5) + 0 AS distance
FROM cells a JOIN cells b USING (row_id) GROUP BY a.pos, b.pos""",
)
def _(spark, sf):
    return column_distances(vectors(spark, sf), "euclidean").select("i", "j", r("distance", 5).alias("distance"))


@query(
    "column_distances_manhattan",
    f"""WITH {VEC_CELLS} SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(sum(abs(a.x - b.x)), 5) + 0 AS distance
FROM cells a JOIN cells b USING (row_id) GROUP BY a.pos, b.pos""",
)
def _(spark, sf):
    return column_distances(vectors(spark, sf), "manhattan").select("i", "j", r("distance", 5).alias("distance"))


@query(
    "column_distances_cosine",
    f"""WITH {VEC_CELLS} SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j,
round(1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 5) + 0 AS distance
FROM cells a JOIN cells b USING (row_id) GROUP BY a.pos, b.pos""",
)
def _(spark, sf):
    return column_distances(vectors(spark, sf), "cosine").select("i", "j", r("distance", 5).alias("distance"))


@query("feature_agglomeration")
def _(spark, sf):
    df = vectors(spark, sf)
    return column_checksum(FeatureAgglomeration(n_clusters=12).fit(df).transform(df))


def _tree_draw(kind: str, attempt: str = "") -> str:
    text = f"'1:{kind}:' || tree || ':' || node{attempt}"
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def _tree_level(k: int) -> str:
    return f"""
x{k} AS MATERIALIZED (SELECT a.row_id, tree, node, x FROM (SELECT *, CAST(floor({_tree_draw("column")} * d) AS BIGINT) AS pos FROM l{k}, width) a JOIN cells USING (row_id, pos)),
s{k} AS (SELECT tree, node, min(x) AS lo, max(x) AS hi FROM x{k} GROUP BY tree, node),
t{k} AS (SELECT *, lo + {_tree_draw("threshold", " || ':0'")} * (hi - lo) AS cut FROM s{k}),
l{k + 1} AS MATERIALIZED (SELECT row_id, tree, CASE WHEN lo = hi THEN node WHEN x <= CASE WHEN cut < hi THEN cut ELSE lo END THEN 2 * node ELSE 2 * node + 1 END AS node
  FROM x{k} JOIN t{k} USING (tree, node))"""


@query(
    "random_trees_embedding",
    f"""WITH {VEC_CELLS}, width AS (SELECT max(pos) + 1 AS d FROM cells),
l0 AS (SELECT vec_id AS row_id, tree, CAST(1 AS BIGINT) AS node FROM embeddings, range(10) r(tree)), {", ".join(_tree_level(k) for k in range(3))}
SELECT CAST(tree * 16 + node AS INTEGER) AS leaf, count(*) AS n FROM l3 GROUP BY ALL""",
)
def _(spark, sf):
    df = vectors(spark, sf).persist()
    out = RandomTreesEmbedding(n_estimators=10, max_depth=3).fit(df).transform(df)
    return out.select("row_id", F.explode_outer("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
