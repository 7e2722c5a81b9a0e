"""Folds, balanced accuracy and naive Bayes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators.folds import stratified_folds
from foldwright.operators.metrics import bac_binary, bac_multiclass, bac_multilabel, class_confusion, confusion_counts, cost
from foldwright.operators.naive_bayes import (
    class_sizes,
    bernoulli_stats,
    fit_naive_bayes,
    gaussian_stats,
    log_priors,
    multinomial_stats,
)
from foldwright.functions import exprs as X
from foldwright.operators.discriminant import LDA, QDA, within_covariance
from foldwright.operators import svm
from foldwright.operators.linear import SGD, KernelSVM, LinearSVM, OneVsRestMultilabel, PairModel, PassiveAggressive, pair_votes
from foldwright.operators.neighbors import KNeighbors, nearest, vote
from foldwright.operators.steps import Identity
from foldwright.operators.trees import AdaBoost, DecisionTree, ExtraTrees, GradientBoosting, RandomForest, samme_round
from workloads.base import SHIFTED_CELLS, item_matrix, query, r, shifted_items, table, vectors
from workloads.preparation import ITEM_CELLS, VEC_CELLS

FOLDS_SQL = """
SELECT vec_id AS row_id, label,
       (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS fold
FROM embeddings
"""

# long form of the embeddings with a fold per row
CELLS_SQL = f"""
folds AS ({FOLDS_SQL}),
cells AS (SELECT vec_id AS row_id, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT f.row_id, f.label, f.fold, c.pos, c.x FROM folds f JOIN cells c USING (row_id)),
inst AS (SELECT unnest(range(0, 5)) AS held)
"""

SCALED_SQL = f"""
WITH {CELLS_SQL},
scale AS (
  SELECT held, pos, avg(x) AS mu,
         CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd
  FROM m JOIN inst ON m.fold <> inst.held GROUP BY held, pos),
nb AS (
  SELECT s.held, m.label, m.pos, avg((x - mu) / sd) AS mean, var_pop((x - mu) / sd) + 1e-9 AS var
  FROM m JOIN scale s ON m.fold <> s.held AND m.pos = s.pos GROUP BY s.held, m.label, m.pos),
prior AS (
  SELECT held, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY held)) AS lp
  FROM folds JOIN inst ON fold <> held GROUP BY held, label),
ll AS (
  SELECT m.row_id, m.label, m.fold, nb.label AS c,
         any_value(lp) + sum(-0.5 * (ln(2 * pi() * var) + ((x - mu) / sd - mean) * ((x - mu) / sd - mean) / var)) AS score
  FROM m JOIN scale s ON m.fold = s.held AND m.pos = s.pos
         JOIN nb ON nb.held = m.fold AND nb.pos = m.pos
         JOIN prior p ON p.held = m.fold AND p.label = nb.label
  GROUP BY m.row_id, m.label, m.fold, nb.label),
pred AS (
  SELECT row_id, label, fold, c AS prediction FROM ll
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, c) = 1)
"""


@query("stratified_folds", f"SELECT row_id, label, CAST(fold AS INTEGER) AS fold FROM ({FOLDS_SQL})")
def _(spark, sf):
    return stratified_folds(vectors(spark, sf), 5).select("row_id", "label", "fold")


@query(
    "cv_scaled_gaussian_cost",
    SCALED_SQL
    + """
, rec AS (
  SELECT fold, label,
         greatest(sum(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 1e-15) AS tp,
         sum(CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END) AS fn
  FROM pred GROUP BY fold, label)
SELECT CAST(fold AS INTEGER) AS fold,
       round((sum(tp / greatest(tp + fn, 1e-15)) + (10 - count(*))) / 10.0, 6) + 0 AS bac,
       round(1 - (sum(tp / greatest(tp + fn, 1e-15)) + (10 - count(*))) / 10.0, 6) + 0 AS cost
FROM rec GROUP BY fold
""",
)
def _(spark, sf):
    folded = stratified_folds(vectors(spark, sf), 5)
    model = fit_naive_bayes(folded, "gaussian", fold="fold", k=5, standardize=True)
    scored = bac_multiclass(model.predict(folded), "label", "prediction", 10, ["fold"])
    return scored.select("fold", r("bac").alias("bac"), r(cost("bac")).alias("cost"))


@query("cv_scaled_gaussian_predictions", SCALED_SQL + " SELECT row_id, CAST(fold AS INTEGER) AS fold, label, prediction FROM pred")
def _(spark, sf):
    folded = stratified_folds(vectors(spark, sf), 5)
    model = fit_naive_bayes(folded, "gaussian", fold="fold", k=5, standardize=True)
    return model.predict(folded).select("row_id", "fold", "label", "prediction")


# ---------------------------------------------------------------- balanced accuracy

@query(
    "confusion_counts",
    """WITH t AS (SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS p FROM lineitem)
SELECT l_returnflag, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
       count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM t GROUP BY l_returnflag""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_linestatus") == "O").cast("int").alias("y"), X.binarize(F.col("l_discount") * 10).alias("p")
    )
    return confusion_counts(df, "y", "p", ["l_returnflag"])


_CLASS_SQL = """t AS (SELECT l_linestatus, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, CAST(l_linenumber + l_orderkey AS BIGINT) % 3 AS p FROM lineitem)"""


def _class_rows(spark, sf):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf, "lineitem").select("l_linestatus", flag.alias("y"), ((F.col("l_linenumber") + F.col("l_orderkey")) % 3).cast("int").alias("p"))


@query(
    "class_confusion",
    f"""WITH {_CLASS_SQL}, c AS (SELECT unnest([0, 1, 2]) AS c)
SELECT l_linestatus, c AS "class", count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y <> c AND p = c) AS fp,
       count(*) FILTER (y = c AND p <> c) AS fn, count(*) FILTER (y <> c AND p <> c) AS tn FROM t, c GROUP BY ALL""",
)
def _(spark, sf):
    return class_confusion(_class_rows(spark, sf), "y", "p", ["l_linestatus"])


@query(
    "bac_binary",
    """WITH t AS (SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS p FROM lineitem),
c AS (SELECT l_returnflag, greatest(sum(y * p), 1e-15)::DOUBLE AS tp, sum(y * (1 - p)) AS fn, greatest(sum((1 - y) * (1 - p)), 1e-15)::DOUBLE AS tn, sum((1 - y) * p) AS fp FROM t GROUP BY ALL)
SELECT l_returnflag, round(0.5 * (tp / greatest(tp + fn, 1e-15) + tn / greatest(tn + fp, 1e-15)), 6) AS bac FROM c""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))
    return bac_binary(df, "y", "p", ["l_returnflag"]).select("l_returnflag", r("bac").alias("bac"))


@query(
    "bac_multiclass",
    f"""WITH {_CLASS_SQL}, c AS (SELECT l_linestatus, y, greatest(count(*) FILTER (y = p), 1e-15)::DOUBLE AS tp, count(*) FILTER (y <> p) AS fn FROM t GROUP BY l_linestatus, y),
k AS (SELECT unnest(range(0, 4)) AS y), s AS (SELECT DISTINCT l_linestatus FROM t)
SELECT l_linestatus, round(avg(coalesce(tp / greatest(tp + fn, 1e-15), 1.0)), 6) AS bac
FROM s CROSS JOIN k LEFT JOIN c USING (l_linestatus, y) GROUP BY l_linestatus""",
)
def _(spark, sf):
    return bac_multiclass(_class_rows(spark, sf), "y", "p", 4, ["l_linestatus"]).select("l_linestatus", r("bac").alias("bac"))


@query(
    "bac_multilabel",
    """WITH t AS (SELECT lang, quality, toxic, CASE WHEN n_chars / (n_chars + 500.0) >= 0.5 THEN 1 ELSE 0 END AS p0, CASE WHEN 500.0 / (n_chars + 500.0) >= 0.5 THEN 1 ELSE 0 END AS p1
           FROM labels JOIN documents USING (doc_id)),
u AS (SELECT lang, 0 AS pos, quality AS y, p0 AS p FROM t UNION ALL SELECT lang, 1, toxic, p1 FROM t),
c AS (SELECT lang, pos, greatest(sum(y * p), 1e-15)::DOUBLE AS tp, sum(y * (1 - p)) AS fn, greatest(sum((1 - y) * (1 - p)), 1e-15)::DOUBLE AS tn, sum((1 - y) * p) AS fp FROM u GROUP BY ALL)
SELECT lang, round(avg(0.5 * (tp / greatest(tp + fn, 1e-15) + tn / greatest(tn + fp, 1e-15))), 6) AS bac FROM c GROUP BY lang""",
)
def _(spark, sf):
    n = F.col("n_chars").cast("double")
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", F.array("quality", "toxic").alias("y"), F.array(n / (n + 500.0), F.lit(500.0) / (n + 500.0)).alias("p")
    )
    return bac_multilabel(df, "y", "p", ["lang"]).select("lang", r("bac").alias("bac"))


# ---------------------------------------------------------------- scalar functions

@query(
    "sigmoid_pair",
    """WITH t AS (SELECT l_orderkey, l_linenumber, greatest(least(l_extendedprice / 1000 - 30, 20), -20) AS s FROM lineitem),
u AS (SELECT *, 1 / (1 + exp(-s)) AS p FROM t), v AS (SELECT *, CASE WHEN p > 0.999999 THEN 1.0 WHEN p < 0.0000001 THEN 0.0 ELSE p END AS q FROM u)
SELECT l_orderkey, l_linenumber, round(1 - q, 6) + 0 AS p0, round(q, 6) + 0 AS p1 FROM v""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.sigmoid_pair(F.col("l_extendedprice") / 1000 - 30).alias("p"))
    return df.select("l_orderkey", "l_linenumber", r(F.col("p")[0]).alias("p0"), r(F.col("p")[1]).alias("p1"))


@query(
    "softmax_rows",
    f"WITH {VEC_CELLS}, m AS (SELECT *, max(x) OVER (PARTITION BY row_id) AS top FROM cells) "
    "SELECT row_id, pos, round(exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY row_id), 6) + 0 AS p FROM m",
)
def _(spark, sf):
    return vectors(spark, sf).select("row_id", F.posexplode(X.softmax("features")).alias("pos", "x")).select("row_id", "pos", r("x").alias("p"))


@query(
    "positive_probs",
    """SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS p0, CASE WHEN l_linestatus = 'O' THEN round(l_tax, 6) ELSE 0.0 END AS p1 FROM lineitem""",
)
def _(spark, sf):
    d, t = F.col("l_discount"), F.col("l_tax")
    pair = F.array(F.array(1 - d, d), F.when(F.col("l_linestatus") == "O", F.array(1 - t, t)).otherwise(F.array(F.lit(1.0))))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.positive_probs(pair).alias("p"))
    return df.select("l_orderkey", "l_linenumber", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


@query(
    "argmax_decision",
    f"WITH {VEC_CELLS} SELECT row_id, CAST(min(pos) AS INTEGER) AS best FROM cells c WHERE x = (SELECT max(x) FROM cells d WHERE d.row_id = c.row_id) GROUP BY row_id",
)
def _(spark, sf):
    return vectors(spark, sf).select("row_id", X.argmax_index("features").alias("best"))


@query(
    "one_hot_labels",
    "SELECT vec_id AS row_id, CAST(unnest(range(0, 10)) AS INTEGER) AS class, CAST(label = unnest(range(0, 10)) AS INTEGER) AS hot FROM embeddings",
)
def _(spark, sf):
    return vectors(spark, sf).select("row_id", F.posexplode(X.one_hot("label", 10)).alias("class", "hot"))


@query(
    "argmax_one_hot",
    """WITH t AS (SELECT l_orderkey, l_linenumber, [l_discount, l_tax, 0.05] AS a FROM lineitem),
u AS (SELECT *, list_position(a, list_max(a)) AS b FROM t)
SELECT l_orderkey, l_linenumber, CAST(b = 1 AS INTEGER) AS h0, CAST(b = 2 AS INTEGER) AS h1, CAST(b = 3 AS INTEGER) AS h2 FROM u""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.argmax_one_hot(F.array("l_discount", "l_tax", F.lit(0.05))).alias("h"))
    return df.select("l_orderkey", "l_linenumber", *[F.col("h")[i].alias(f"h{i}") for i in range(3)])


@query("binarize_half", "SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 >= 0.5 AS INTEGER) AS decision FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.binarize(F.col("l_discount") * 10).alias("decision"))


@query(
    "number_and_flag_parsing",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS head, lower(trim(p_type)) AS kind,
CASE WHEN regexp_matches(substr(p_brand, 7), '^[0-9]+$') THEN CAST(substr(p_brand, 7) AS BIGINT) END AS brand,
CASE WHEN regexp_matches(p_name, '^[0-9]+$') THEN 1 END AS not_a_number, lower(CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END) = 'true' AS large FROM part""",
)
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.split("p_name", " ")[0].alias("head"),
        F.lower(F.trim("p_type")).alias("kind"),
        X.parse_number(F.substring("p_brand", 7, 10)).alias("brand"),
        X.parse_number("p_name").cast("int").alias("not_a_number"),
        X.true_string(F.when(F.col("p_size") > 25, "True").otherwise("False")).alias("large"),
    )


@query(
    "code_maps",
    """SELECT event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS task,
CASE WHEN user_id % 2 = 0 THEN 7 ELSE 10 END AS metric, CASE WHEN value < 1 THEN 6 ELSE 5 END AS prop, count(*) AS n FROM events GROUP BY ALL""",
)
def _(spark, sf):
    e = F.col("event_type")
    name = F.when(e == "click", "binary.classification").when(e == "view", "multiclass.classification").when(e == "error", "multilabel.classification").otherwise("regression")
    df = table(spark, sf, "events").select(
        "event_type",
        X.task_code(name).alias("task"),
        X.metric_code(F.when(F.col("user_id") % 2 == 0, "bac_metric").otherwise("r2")).alias("metric"),
        X.property_code(F.when(F.col("value") < 1, "sparse").otherwise("dense")).alias("prop"),
    )
    return df.groupBy("event_type", "task", "metric", "prop").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- naive Bayes

@query(
    "gaussian_class_moments",
    f"WITH {VEC_CELLS} SELECT label, pos, count(*) AS n, round(avg(x), 6) + 0 AS mean, round(var_pop(x) + 1e-9, 6) AS var FROM cells GROUP BY label, pos",
)
def _(spark, sf):
    return gaussian_stats(vectors(spark, sf), "label", "features").select("label", "pos", "n", r("mean").alias("mean"), F.round("var", 6).alias("var"))


@query(
    "gaussian_moments_large_mean",
    f"""WITH {SHIFTED_CELLS}, c AS (SELECT pos, avg(x) AS mu, stddev_pop(x) AS sd FROM cells GROUP BY pos)
SELECT label, pos, count(*) AS n, round((avg(x) - any_value(mu)) / any_value(sd), 4) + 0 AS mean, round(var_pop(x) / any_value(sd * sd), 5) AS var
FROM cells JOIN c USING (pos) GROUP BY label, pos""",
)
def _(spark, sf):
    stats = gaussian_stats(shifted_items(spark, sf), "label", "features", standardize=True)
    return stats.select("label", "pos", "n", r("mean", 4).alias("mean"), F.round("var", 5).alias("var"))


@query(
    "gaussian_predictions",
    f"""WITH {VEC_CELLS}, nb AS (SELECT label AS c, pos, avg(x) AS mean, var_pop(x) + 1e-9 AS var FROM cells GROUP BY label, pos),
prior AS (SELECT label AS c, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM embeddings GROUP BY label),
ll AS (SELECT row_id, c, any_value(lp) + sum(-0.5 * (ln(2 * pi() * var) + (x - mean) * (x - mean) / var)) AS s FROM cells JOIN nb USING (pos) JOIN prior USING (c) GROUP BY row_id, c)
SELECT row_id, c AS prediction FROM ll QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY s DESC, c) = 1""",
)
def _(spark, sf):
    df = vectors(spark, sf)
    return fit_naive_bayes(df, "gaussian").predict(df).select("row_id", "prediction")


_SHARES_SQL = """, top AS (SELECT *, max(s) OVER (PARTITION BY row_id) AS m FROM ll)
SELECT row_id, c, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY row_id), 4) + 0 AS p FROM top"""


def _probability_rows(df, classes):
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("c"), F.col("probability").alias("p"))
    return df.select("row_id", F.explode(pairs).alias("e")).select("row_id", F.col("e.c").alias("c"), r(F.col("e.p"), 4).alias("p"))


@query(
    "gaussian_probabilities",
    f"""WITH {VEC_CELLS}, nb AS (SELECT label AS c, pos, avg(x) AS mean, var_pop(x) + 1e-9 AS var FROM cells GROUP BY label, pos),
prior AS (SELECT label AS c, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM embeddings GROUP BY label),
ll AS (SELECT row_id, c, any_value(lp) + sum(-0.5 * (ln(2 * pi() * var) + (x - mean) * (x - mean) / var)) AS s FROM cells JOIN nb USING (pos) JOIN prior USING (c) GROUP BY row_id, c)"""
    + _SHARES_SQL,
)
def _(spark, sf):
    df = vectors(spark, sf)
    model = fit_naive_bayes(df, "gaussian")
    return _probability_rows(model.probabilities(df), model.classes)


@query("class_log_priors", "SELECT label, count(*) AS n_c, round(ln(count(*) / sum(count(*)) OVER ()), 6) AS log_prior FROM embeddings GROUP BY label")
def _(spark, sf):
    return log_priors(class_sizes(vectors(spark, sf), "label"), [], "label").select("label", "n_c", F.round("log_prior", 6).alias("log_prior"))


_BERNOULLI = f"""{VEC_CELLS}, nc AS (SELECT label AS c, count(*) AS n_c FROM embeddings GROUP BY label),
b AS (SELECT label AS c, pos, (sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) + 1.0) / (any_value(n_c) + 2.0) AS p FROM cells JOIN nc ON label = c GROUP BY label, pos)"""


@query("bernoulli_parameters", f"WITH {_BERNOULLI} SELECT c AS label, pos, round(p, 6) AS p FROM b")
def _(spark, sf):
    return bernoulli_stats(vectors(spark, sf), "label", "features").select("label", "pos", F.round("p", 6).alias("p"))


@query(
    "bernoulli_predictions",
    f"""WITH {_BERNOULLI}, ll AS (SELECT row_id, c, any_value(ln(n_c / (SELECT count(*) FROM embeddings))) + sum(CASE WHEN x > 0 THEN ln(p) ELSE ln(1 - p) END) AS s
FROM cells JOIN b USING (pos) JOIN nc USING (c) GROUP BY row_id, c)
SELECT row_id, c AS prediction FROM ll QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY s DESC, c) = 1""",
)
def _(spark, sf):
    df = vectors(spark, sf)
    return fit_naive_bayes(df, "bernoulli").predict(df).select("row_id", "prediction")


@query(
    "bernoulli_probabilities",
    f"""WITH {_BERNOULLI}, ll AS (SELECT row_id, c, any_value(ln(n_c / (SELECT count(*) FROM embeddings))) + sum(CASE WHEN x > 0 THEN ln(p) ELSE ln(1 - p) END) AS s
FROM cells JOIN b USING (pos) JOIN nc USING (c) GROUP BY row_id, c)"""
    + _SHARES_SQL,
)
def _(spark, sf):
    df = vectors(spark, sf)
    model = fit_naive_bayes(df, "bernoulli")
    return _probability_rows(model.probabilities(df), model.classes)


_MULTINOMIAL = f"""{VEC_CELLS}, nj AS (SELECT label AS c, pos, sum(greatest(x, 0)) AS n FROM cells GROUP BY label, pos),
t AS (SELECT c, pos, ln((n + 0.5) / (sum(n) OVER (PARTITION BY c) + 0.5 * 64)) AS logp FROM nj)"""


@query("multinomial_parameters", f"WITH {_MULTINOMIAL} SELECT c AS label, pos, round(logp, 6) AS logp FROM t")
def _(spark, sf):
    return multinomial_stats(vectors(spark, sf), "label", "features", 0.5).select("label", "pos", F.round("logp", 6).alias("logp"))


@query(
    "multinomial_predictions",
    f"""WITH {_MULTINOMIAL}, ll AS (SELECT row_id, c, sum(greatest(x, 0) * logp) - ln(10) AS s FROM cells JOIN t USING (pos) GROUP BY row_id, c)
SELECT row_id, c AS prediction FROM ll QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY s DESC, c) = 1""",
)
def _(spark, sf):
    df = vectors(spark, sf)
    return fit_naive_bayes(df, "multinomial", alpha=0.5, fit_prior=False).predict(df).select("row_id", "prediction")


@query(
    "multinomial_probabilities",
    f"""WITH {_MULTINOMIAL}, ll AS (SELECT row_id, c, sum(greatest(x, 0) * logp) - ln(10) AS s FROM cells JOIN t USING (pos) GROUP BY row_id, c)"""
    + _SHARES_SQL,
)
def _(spark, sf):
    df = vectors(spark, sf)
    model = fit_naive_bayes(df, "multinomial", alpha=0.5, fit_prior=False)
    return _probability_rows(model.probabilities(df), model.classes)


TOKENS_SQL = r"""
docs AS (SELECT doc_id, quality AS label, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> '') AS words FROM documents JOIN labels USING (doc_id)),
toks AS (SELECT doc_id, label, unnest(words) AS word FROM docs),
cnt AS (SELECT doc_id, label, word, count(*) AS n FROM toks GROUP BY ALL),
vocab AS (SELECT count(DISTINCT word) AS d FROM cnt),
cw AS (SELECT label, word, sum(n) AS n FROM cnt GROUP BY ALL),
tot AS (SELECT label, sum(n) AS n FROM cw GROUP BY label),
grid AS (SELECT l.label, w.word, ln((coalesce(cw.n, 0) + 1.0) / (l.n + d)) AS logp
         FROM tot l CROSS JOIN (SELECT DISTINCT word FROM cnt) w LEFT JOIN cw ON cw.label = l.label AND cw.word = w.word, vocab)
"""


@query(
    "multinomial_text_scores",
    f"""WITH {TOKENS_SQL}, prior AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM docs GROUP BY label)
SELECT c.doc_id, g.label, round(sum(c.n * g.logp) + any_value(lp), 4) AS score
FROM cnt c JOIN grid g USING (word) JOIN prior p ON p.label = g.label GROUP BY c.doc_id, g.label""",
)
def _(spark, sf):
    from foldwright.operators.naive_bayes import multinomial_sparse_scores, multinomial_sparse_stats

    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    words = docs.select("doc_id", "label", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    cells = words.groupBy("doc_id", "label", "word").agg(F.count(F.lit(1)).alias("n"))
    logp = multinomial_sparse_stats(cells, "label", "word", "n", 1.0)
    priors = log_priors(class_sizes(docs, "label"), [], "label")
    out = multinomial_sparse_scores(cells.drop("label"), logp, priors, "doc_id", "word", "n", "label")
    return out.select("doc_id", "label", F.round("score", 4).alias("score"))


# ---------------------------------------------------------------- nearest neighbours

def _nearest_sql(distance: str, k: int) -> str:
    return f"""WITH pairs AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, {distance} AS d FROM embeddings q, embeddings t WHERE (q.vec_id + 1) % 5 = 0 AND (t.vec_id + 1) % 5 <> 0),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, tid) AS rank FROM pairs QUALIFY rank <= {k})"""


_L2 = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE))))"
_L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE)))"


def _held_out(spark, sf):
    """Every fifth vector is a query, the others are the training rows."""
    df = vectors(spark, sf)
    test = (F.col("row_id") + 1) % 5 == 0
    return df.filter(~test), df.filter(test)


@query("nearest_euclidean", _nearest_sql(_L2, 5) + " SELECT qid, tid, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM best")
def _(spark, sf):
    train, test = _held_out(spark, sf)
    return nearest(train, test, 5, 2).select("qid", "tid", "rank", F.round("distance", 6).alias("distance"))


@query("nearest_manhattan", _nearest_sql(_L1, 5) + " SELECT qid, tid, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM best")
def _(spark, sf):
    train, test = _held_out(spark, sf)
    return nearest(train, test, 5, 1).select("qid", "tid", "rank", F.round("distance", 6).alias("distance"))


@query(
    "neighbor_vote_distance",
    _nearest_sql(_L2, 7)
    + """, v AS (SELECT qid, label, sum(1 / d) AS v FROM best GROUP BY qid, label)
SELECT qid AS row_id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC, label) = 1""",
)
def _(spark, sf):
    train, test = _held_out(spark, sf)
    return vote(nearest(train, test, 7, 2), "distance").select(F.col("qid").alias("row_id"), "prediction")


@query(
    "neighbor_vote_uniform",
    _nearest_sql(_L2, 7)
    + """, v AS (SELECT qid, label, count(*) AS v FROM best GROUP BY qid, label)
SELECT qid AS row_id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC, label) = 1""",
)
def _(spark, sf):
    train, test = _held_out(spark, sf)
    return KNeighbors(7, "uniform", 2).fit(train).predict(test).select("row_id", "prediction")


@query(
    "neighbor_probabilities",
    _nearest_sql(_L2, 7)
    + """, v AS (SELECT qid, label, count(*) AS v FROM best GROUP BY qid, label), q AS (SELECT DISTINCT qid FROM v), c AS (SELECT DISTINCT label FROM embeddings)
SELECT q.qid AS row_id, c.label AS c, round(coalesce(v, 0) / 7.0, 4) + 0 AS p FROM q CROSS JOIN c LEFT JOIN v ON v.qid = q.qid AND v.label = c.label""",
)
def _(spark, sf):
    train, test = _held_out(spark, sf)
    model = KNeighbors(7, "uniform", 2).fit(train)
    return _probability_rows(model.probabilities(test), model.classes)


# ---------------------------------------------------------------- discriminants

@query(
    "within_class_covariance",
    f"""WITH {VEC_CELLS}, m AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY label, pos), z AS (SELECT row_id, pos, x - m AS z FROM cells JOIN m USING (label, pos)),
n AS (SELECT count(*) - count(DISTINCT label) AS n FROM embeddings)
SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(sum(a.z * b.z) / any_value(n), 6) + 0 AS cov FROM z a JOIN z b USING (row_id), n GROUP BY a.pos, b.pos""",
)
def _(spark, sf):
    return within_covariance(vectors(spark, sf)).select("i", "j", r("cov").alias("cov"))


def _held_out_bac(spark, sf, classifier):
    """Balanced accuracy on every fifth row after fitting on the others.

    The labels of the vectors are independent of the vectors, so the class to learn is the position
    of the largest of the first three coordinates.
    """
    largest = X.argmax_index(F.slice("features", 1, 3))
    train, test = (part.withColumn("label", largest) for part in _held_out(spark, sf))
    out = classifier.fit(train.persist()).predict(test)
    return bac_multiclass(out, "label", "prediction", 3, []).select(r("bac").alias("bac"))


@query("lda_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, LDA())


@query("lda_shrunk_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, LDA("auto"))


@query("qda_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, QDA(0.5))


def _two_measures(spark, sf):
    """Quantity and discount in percent of every order line, with the return flag as class."""
    items = item_matrix(spark, sf)
    return items.withColumn("features", F.array(F.col("features")[0].cast("double"), F.col("features")[2].cast("double") * 100.0))


_TWO_MEASURES = """item AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
                  CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) * 100.0 AS y FROM lineitem),
mean AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM item GROUP BY label),
scatter AS (SELECT label, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy
            FROM item JOIN mean USING (label) GROUP BY label),
"""
_CLASS_SCORES = """one AS (SELECT x, y, max(s) FILTER (label = 0) AS s0, max(s) FILTER (label = 1) AS s1, max(s) FILTER (label = 2) AS s2 FROM score GROUP BY x, y)
SELECT row_id, round(s0, 4) + 0 AS score_0, round(s1, 4) + 0 AS score_1, round(s2, 4) + 0 AS score_2,
       CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS prediction FROM item JOIN one USING (x, y)"""


def _class_scores(model, df):
    out = model.predict(model.scores(df))
    return out.select("row_id", *[r(F.col("scores")[c], 4).alias(f"score_{c}") for c in range(3)], F.col("prediction").cast("int").alias("prediction"))


@query(
    "lda_scores",
    f"""WITH {_TWO_MEASURES}
pooled AS (SELECT sum(sxx) / (sum(n) - count(*)) AS a, sum(sxy) / (sum(n) - count(*)) AS b, sum(syy) / (sum(n) - count(*)) AS d, sum(n) AS total FROM scatter),
line AS (SELECT label, (mx * d - my * b) / (a * d - b * b) AS wx, (my * a - mx * b) / (a * d - b * b) AS wy, mx, my, ln(n / total) AS prior FROM scatter CROSS JOIN pooled),
spot AS (SELECT DISTINCT x, y FROM item),
score AS (SELECT x, y, l.label, x * wx + y * wy - 0.5 * (mx * wx + my * wy) + prior AS s FROM spot CROSS JOIN line l),
{_CLASS_SCORES}""",
)
def _(spark, sf):
    df = _two_measures(spark, sf)
    return _class_scores(LDA().fit(df), df)


@query(
    "qda_scores",
    f"""WITH {_TWO_MEASURES}
blend AS (SELECT label, mx, my, n, 0.9 * sxx / (n - 1) + 0.1 AS a, 0.9 * sxy / (n - 1) AS b, 0.9 * syy / (n - 1) + 0.1 AS d, sum(n) OVER () AS total FROM scatter),
spot AS (SELECT DISTINCT x, y FROM item),
score AS (SELECT x, y, c.label, ln(n / total) - 0.5 * ln(a * d - b * b)
            - 0.5 * (d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b) AS s FROM spot CROSS JOIN blend c),
{_CLASS_SCORES}""",
)
def _(spark, sf):
    df = _two_measures(spark, sf)
    return _class_scores(QDA(0.1).fit(df), df)


# ---------------------------------------------------------------- trees, linear models

@query("decision_tree_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, DecisionTree(max_depth=0.5, min_samples_leaf=2))


@query("random_forest_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, RandomForest(n_estimators=20, max_depth=6))


@query("extra_trees_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, ExtraTrees(n_estimators=20, max_depth=6))


def _flag_rows(spark, sf):
    """Two classes: whether quantity times discount of an order line is large, from its four measures."""
    large = (F.col("features")[0] * F.col("features")[2] > 1.2).cast("int")
    df = item_matrix(spark, sf).select("row_id", "features", large.alias("label"))
    test = F.col("row_id") % 5 == 0
    return df.filter(~test), df.filter(test)


@query("gradient_boosting_bac")
def _(spark, sf):
    train, test = _flag_rows(spark, sf)
    out = GradientBoosting(n_estimators=5, max_depth=2).fit(train).predict(test)
    return bac_multiclass(out, "label", "prediction", 2, []).select(r("bac").alias("bac"))


@query("adaboost_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, AdaBoost(n_estimators=5, max_depth=3, checkpoint_every=5))


@query("adaboost_samme_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, AdaBoost(n_estimators=5, max_depth=3, algorithm="SAMME", checkpoint_every=5))


@query(
    "boosting_round_error",
    """WITH t AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, (l_linenumber + l_orderkey) % 3 AS p, 1 + l_discount AS w FROM lineitem)
SELECT round(sum(w), 4) AS total, round(sum(CASE WHEN y <> p THEN w ELSE 0 END) / sum(w), 6) AS error FROM t""",
)
def _(spark, sf):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    df = table(spark, sf, "lineitem").select(flag.alias("y"), ((F.col("l_linenumber") + F.col("l_orderkey")) % 3).alias("p"), (1 + F.col("l_discount")).alias("w"))
    return samme_round(df, "y", "p", "w").select(F.round("total", 4).alias("total"), F.round("error", 6).alias("error"))


@query("linear_svm_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, LinearSVM(max_iter=15))


@query("kernel_svm_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, KernelSVM(gamma=0.05, landmarks=60, max_iter=15))


@query("sgd_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, SGD("log", alpha=1e-3, n_iter=8))


@query("sgd_hinge_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, SGD("hinge", "elasticnet", alpha=1e-3, n_iter=8, average=True))


@query("passive_aggressive_bac")
def _(spark, sf):
    return _held_out_bac(spark, sf, PassiveAggressive(C=0.1, n_iter=6))


@query("multilabel_one_vs_rest")
def _(spark, sf):
    n = F.col("n_chars").cast("double")
    df = (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
        .select("doc_id", F.array("quality", "toxic").alias("labels"), F.array(F.log1p(n), F.sqrt(n)).alias("features"))
        .persist()
    )
    model = OneVsRestMultilabel(lambda label: DecisionTree(max_depth=1.0, label=label)).fit(df)
    out = model.predict(df).withColumn("score", F.col("prediction").cast("array<double>"))
    return bac_multilabel(out, "labels", "score", []).select(r("bac").alias("bac"))


@query(
    "pair_votes",
    """WITH pairs AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, unnest([0, 0, 1]) AS i, unnest([1, 2, 2]) AS j,
                      unnest([l_discount - 0.05, l_tax - 0.04, l_quantity / 50 - 0.5]) AS d FROM lineitem),
s AS (SELECT row_id, i AS c, -d AS conf, CASE WHEN d >= 0 THEN 1 ELSE 0 END AS v FROM pairs UNION ALL SELECT row_id, j, d, CASE WHEN d < 0 THEN 1 ELSE 0 END FROM pairs),
g AS (SELECT row_id, c, sum(conf) AS conf, sum(v) AS v FROM s GROUP BY ALL), m AS (SELECT greatest(abs(max(conf)), abs(min(conf))) AS m FROM g)
SELECT row_id, c AS "class", round(v + conf * (0.5 - 2.220446049250313e-16) / m, 6) + 0 AS score FROM g, m""",
)
def _(spark, sf):
    e = lambda i, j, d: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), d.alias("d"))
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.explode(F.array(e(0, 1, F.col("l_discount") - 0.05), e(0, 2, F.col("l_tax") - 0.04), e(1, 2, F.col("l_quantity") / 50 - 0.5))).alias("e"),
    )
    pairs = rows.select("row_id", "e.i", "e.j", F.col("e.d").alias("decision"))
    return pair_votes(pairs).select("row_id", "class", r("score").alias("score"))


# ---------------------------------------------------------------- squared-hinge machines on one column

_SVM_STEPS = 14


def _newton_sql(problems: str, rows: str) -> str:
    """Newton steps of the l2 problems (p, positive, negative or NULL) over rows (y, x) with C = 0.01: CTEs s0 ... s14 of (p, w, b)."""
    start = f"""rows AS (SELECT y, x, count(*) AS s FROM ({rows}) GROUP BY y, x), problems AS ({problems}),
cases AS MATERIALIZED (SELECT p, x, s, CASE WHEN y = positive THEN 1.0 ELSE -1.0 END AS y FROM rows JOIN problems ON y = positive OR negative IS NULL OR y = negative),
s0 AS (SELECT p, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM problems)"""
    step = """, s{n} AS MATERIALIZED (
  SELECT p, w - (h22 * gw - h12 * gb) / (h11 * h22 - h12 * h12) AS w, b - (h11 * gb - h12 * gw) / (h11 * h22 - h12 * h12) AS b
  FROM (SELECT p, w, b, 1 + 0.02 * sum(s * x * x) FILTER (slack > 0) AS h11, 0.02 * sum(s * x) FILTER (slack > 0) AS h12, 1 + 0.02 * sum(s) FILTER (slack > 0) AS h22,
               w - 0.02 * sum(s * y * slack * x) FILTER (slack > 0) AS gw, b - 0.02 * sum(s * y * slack) FILTER (slack > 0) AS gb
        FROM (SELECT p, w, b, x, s, y, 1 - y * (w * x + b) AS slack FROM cases JOIN s{m} USING (p)) GROUP BY p, w, b))"""
    return start + "".join(step.format(n=n, m=n - 1) for n in range(1, _SVM_STEPS + 1))


def _priced(spark, sf):
    """(row_id, label, features) of the line items: class by return flag, the price per hundred thousand."""
    return item_matrix(spark, sf).select("row_id", "label", F.array(F.get("features", F.lit(1)) / 100000).alias("features"))


_PRICED_SQL = "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_extendedprice / 100000 AS x FROM lineitem"


@query(
    "linear_svm_weights",
    f"""WITH {_newton_sql("SELECT unnest([0, 1, 2]) AS p, unnest([0, 1, 2]) AS positive, NULL::INT AS negative", _PRICED_SQL)}
SELECT p AS class, round(w, 5) + 0 AS weight, round(b, 5) + 0 AS intercept, round((w * w + b * b) / 2 + 0.01 * sum(s * greatest(0, 1 - y * (w * x + b)) ** 2), 4) + 0 AS loss, true AS settled
FROM cases JOIN s{_SVM_STEPS} USING (p) GROUP BY p, w, b""",
)
def _(spark, sf):
    df = _priced(spark, sf)
    machine = LinearSVM(C=0.01, tol=1e-9)
    classes = [0, 1, 2]
    w = machine.weights(df, classes)
    rows = svm.training_rows(df, classes, "label", "features")
    loss, gap = svm.loss_and_gradient(rows, machine.problems(classes), w, 0.01)
    table_ = [(c, float(w[c, 0]), float(w[c, 1]), float(loss[c]), bool(gap[c] < 1e-5)) for c in classes]
    out = spark.createDataFrame(table_, "class int, weight double, intercept double, loss double, settled boolean")
    return out.select("class", r("weight", 5).alias("weight"), r("intercept", 5).alias("intercept"), r("loss", 4).alias("loss"), "settled")


@query(
    "one_against_one_votes",
    f"""WITH {_newton_sql("SELECT unnest([0, 1, 2]) AS p, unnest([0, 0, 1]) AS positive, unnest([1, 2, 2]) AS negative", _PRICED_SQL)},
d AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, positive AS i, negative AS j, w * l_extendedprice / 100000 + b AS d FROM lineitem, problems JOIN s{_SVM_STEPS} USING (p)),
v AS (SELECT row_id, i AS c, -d AS conf, CASE WHEN d >= 0 THEN 1 ELSE 0 END AS v FROM d UNION ALL SELECT row_id, j, d, CASE WHEN d < 0 THEN 1 ELSE 0 END FROM d),
g AS (SELECT row_id, c, sum(conf) AS conf, sum(v) AS v FROM v GROUP BY ALL), m AS (SELECT greatest(abs(max(conf)), abs(min(conf))) AS m FROM g)
SELECT row_id, c AS "class", round(v + conf * (0.5 - 2.220446049250313e-16) / m, 4) + 0 AS score FROM g, m""",
)
def _(spark, sf):
    df = _priced(spark, sf)
    pairs = [svm.Problem(0, 1), svm.Problem(0, 2), svm.Problem(1, 2)]
    w = svm.solve(svm.training_rows(df, [0, 1, 2], "label", "features"), pairs, 1, 0.01, tol=1e-9)
    model = PairModel(Identity().fit(df), w, [0, 1, 2], "features")
    return pair_votes(model.pair_rows(df)).select("row_id", "class", r("score", 4).alias("score"))
