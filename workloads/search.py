"""Candidate configurations drawn from the order keys: legality, forbidden pairs, prefixes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foldwright.functions import exprs as X
from foldwright.operators.folds import downsample, split_by_index
from foldwright.plans import candidates as C
from foldwright.plans.prefixes import prefix_keys, prefix_reuse
from foldwright.plans.space import (
    FORBIDDEN_PAIRS,
    FORBIDDEN_VALUES,
    NODES,
    PARAMS,
    STEP_NAMES,
    defaults_map,
    nodes_of,
    nodes_table,
    params_table,
    steps_table,
)
from workloads.base import query, table, vectors

# ---------------------------------------------------------------- the space as SQL values


def _q(s):
    return "NULL" if s is None else "'" + str(s) + "'"


def _list(items):
    return "[" + ", ".join(_q(i) for i in items) + "]::VARCHAR[]"


NODE_VALUES = ", ".join(
    f"('{s}', {STEP_NAMES.index(s)}, '{n}', {nodes_of(s).index(n)}, {len(nodes_of(s))}, {_list(i)}, {_list(o)})" for s, n, i, o in NODES
)
PARAM_VALUES = ", ".join(
    f"('{p.step}', '{p.node}', '{p.key}', '{p.kind}', {'NULL' if p.low is None else repr(float(p.low))}::DOUBLE, "
    f"{'NULL' if p.high is None else repr(float(p.high))}::DOUBLE, {p.log}, {_list(p.choices)}, {_q(p.default)}, "
    f"{_q(f'{p.step}:{p.node}:{p.parent}' if p.parent else None)}, {_list(p.parent_values)})"
    for p in PARAMS
)
PAIR_VALUES = ", ".join(f"('{p}', '{c}')" for p, c in FORBIDDEN_PAIRS)


def _u(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


DRAW_SQL = f"""
node(step, spos, node, idx, n, inp, outp) AS (VALUES {NODE_VALUES}),
param(step, node, key, kind, low, high, log, choices, dflt, parent, pvalues) AS (VALUES {PARAM_VALUES}),
ids AS (SELECT o_orderkey AS id FROM orders),
step(step, n) AS (SELECT step, max(n) FROM node GROUP BY step),
turn AS MATERIALIZED (SELECT id, step, CAST(floor({_u("'1:' || CAST(id AS VARCHAR) || ':' || step")} * n) AS INTEGER) AS idx FROM ids CROSS JOIN step),
choice AS MATERIALIZED (SELECT id, step, spos, node, inp, outp FROM turn JOIN node USING (step, idx)),
drawn AS MATERIALIZED (
  SELECT id, p.step, p.key, p.kind, {_u("'1:' || CAST(id AS VARCHAR) || ':' || p.key")} AS u, low, high, log, choices, parent, pvalues
  FROM choice c JOIN param p ON p.step = c.step AND p.node = c.node),
vals AS MATERIALIZED (
  SELECT id, step, key, parent, pvalues,
    CASE WHEN kind = 'cat' THEN choices[CAST(floor(u * len(choices)) AS INTEGER) + 1] END AS txt,
    CASE WHEN kind = 'float' AND log THEN exp(ln(low) + u * (ln(high) - ln(low)))
         WHEN kind = 'float' THEN low + u * (high - low)
         WHEN kind = 'int' AND log THEN floor(exp(ln(low - 0.5) + u * (ln(high + 0.5) - ln(low - 0.5))) + 0.5)
         WHEN kind = 'int' THEN floor(low + u * (high - low + 1)) END AS num FROM drawn),
active AS MATERIALIZED (
  SELECT v.id, v.step, v.key, v.txt, v.num FROM vals v LEFT JOIN vals p ON p.id = v.id AND p.key = v.parent
  WHERE v.parent IS NULL OR list_contains(v.pvalues, p.txt)),
config AS (
  SELECT id, step, step || ':__choice__' AS key, node AS txt, NULL::DOUBLE AS num FROM choice
  UNION ALL SELECT id, step, key, txt, num FROM active),
forbidden(pre, clf) AS (VALUES {PAIR_VALUES}),
picked AS (SELECT id, max(node) FILTER (step = 'feature_preprocessor') AS pre, max(node) FILTER (step = 'classifier') AS clf FROM choice GROUP BY id)
"""


def _clause_sql(clause: dict) -> str:
    parts = [f"max(CASE WHEN key = '{k}' AND txt IN ({', '.join(_q(v) for v in vals)}) THEN 1 ELSE 0 END) = 1" for k, vals in clause.items()]
    return "(" + " AND ".join(parts) + ")"


ALLOWED_SQL = f"""
clash AS (SELECT id FROM config GROUP BY id HAVING {' OR '.join(_clause_sql(c) for c in FORBIDDEN_VALUES)}),
allowed AS (SELECT id FROM picked WHERE (pre, clf) NOT IN (SELECT (pre, clf) FROM forbidden) AND id NOT IN (SELECT id FROM clash))
"""


IDS_PER_TASK = 100_000


def _ids(spark, sf):
    """Order keys.  A split holds millions of them, but each key costs a drawing: spread them by their number (read from the footers)."""
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(ids.count() / IDS_PER_TASK))
    return ids if ids.rdd.getNumPartitions() >= tasks else ids.repartition(tasks)


def order_candidates(spark, sf, steps=None):
    return C.draw_candidates(_ids(spark, sf), "id", 1, steps=steps)


def drawn_number(value):
    """The number of a drawn value.  Names begin with a letter; they are not tried, as each failed cast costs an exception."""
    return F.when(F.ascii(value) < ord("A"), F.col(value).try_cast("double"))


def entries(df, *keep):
    """(id, key, txt, num) rows of a configuration map: categorical text or a rounded number."""
    number = drawn_number("value")
    # explode_outer: a plain explode adds a size filter that would evaluate the drawing twice
    cells = df.select(*keep, F.explode_outer("config").alias("key", "value")).filter("key IS NOT NULL")
    return cells.select(
        *keep, "key", F.when(number.isNull(), F.col("value")).alias("txt"), (F.round(number, 6) + 0.0).alias("num")
    )


_ENTRY = "key, txt, round(num, 6) + 0 AS num"


@query("draw_candidates", f"WITH {DRAW_SQL} SELECT id, {_ENTRY} FROM config")
def _(spark, sf):
    return entries(order_candidates(spark, sf), "id")


@query("allowed_candidates", f"WITH {DRAW_SQL}, {ALLOWED_SQL} SELECT id FROM allowed")
def _(spark, sf):
    return C.allowed(order_candidates(spark, sf)).select("id")


@query(
    "forbidden_pair_census",
    f"WITH {DRAW_SQL} SELECT pre AS preprocessor, clf AS classifier, count(*) AS n FROM picked WHERE (pre, clf) IN (SELECT (pre, clf) FROM forbidden) GROUP BY ALL",
)
def _(spark, sf):
    drawn = C.draw_choices(_ids(spark, sf), "id", 1).select(F.col("feature_preprocessor").alias("preprocessor"), F.col("classifier"))
    pairs = C.forbidden_table(spark)
    return drawn.join(F.broadcast(pairs), ["preprocessor", "classifier"], "left_semi").groupBy("preprocessor", "classifier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "step_parameters",
    f"WITH {DRAW_SQL} SELECT a.id, split_part(key, ':', 3) AS param, txt, round(num, 6) + 0 AS num FROM active a WHERE step = 'classifier'",
)
def _(spark, sf):
    df = order_candidates(spark, sf).select("id", X.node_params("config", "classifier").alias("config"))
    return entries(df, "id").withColumnRenamed("key", "param")


@query("project_steps", f"WITH {DRAW_SQL} SELECT id, {_ENTRY} FROM config WHERE step IN ('imputation', 'rescaling')")
def _(spark, sf):
    return entries(order_candidates(spark, sf).withColumn("config", X.project_step("config", ["imputation", "rescaling"])), "id")


@query(
    "fill_defaults",
    f"""WITH {DRAW_SQL}, s AS (SELECT id FROM picked WHERE clf = 'sgd'), d AS (SELECT key, dflt FROM param WHERE node = 'sgd'),
x AS (SELECT s.id, split_part(d.key, ':', 3) AS param, a.key AS found, a.txt, a.num, d.dflt FROM s CROSS JOIN d LEFT JOIN active a ON a.id = s.id AND a.key = d.key)
SELECT id, param, CASE WHEN found IS NULL THEN CASE WHEN try_cast(dflt AS DOUBLE) IS NULL THEN dflt END ELSE txt END AS txt,
       round(CASE WHEN found IS NULL THEN try_cast(dflt AS DOUBLE) ELSE num END, 6) + 0 AS num FROM x""",
)
def _(spark, sf):
    df = order_candidates(spark, sf).filter(X.chosen_node("config", "classifier") == "sgd")
    filled = df.select("id", X.fill_defaults(X.node_params("config", "classifier"), defaults_map("classifier", "sgd")).alias("config"))
    return entries(filled, "id").withColumnRenamed("key", "param")


@query(
    "config_prefix",
    f"""WITH {DRAW_SQL} SELECT id, {_ENTRY} FROM config WHERE step IN ('one_hot_encoder', 'imputation', 'rescaling', 'balancing', 'feature_preprocessor')""",
)
def _(spark, sf):
    drawn = order_candidates(spark, sf, STEP_NAMES[: STEP_NAMES.index("feature_preprocessor") + 1])
    return entries(drawn.withColumn("config", X.prefix_of("config", STEP_NAMES, "feature_preprocessor")), "id")


_PREFIX_SQL = """
pk AS (SELECT id, md5(string_agg(key || '=' || txt, ';' ORDER BY key || '=' || txt)) AS prefix_key FROM config
       WHERE step IN ('imputation', 'rescaling', 'balancing') GROUP BY id)
"""


@query("prefix_keys", f"WITH {DRAW_SQL}, {_PREFIX_SQL} SELECT id, prefix_key FROM pk")
def _(spark, sf):
    return prefix_keys(order_candidates(spark, sf), {"scaled": ["imputation", "rescaling", "balancing"]}).select("id", "prefix_key")


@query(
    "prefix_reuse_counts",
    f"WITH {DRAW_SQL}, {_PREFIX_SQL} SELECT prefix_key, count(*) AS candidates, count(*) - 1 AS reused FROM pk GROUP BY prefix_key",
)
def _(spark, sf):
    keys = prefix_keys(order_candidates(spark, sf), {"scaled": ["imputation", "rescaling", "balancing"]})
    return prefix_reuse(keys).select("prefix_key", "candidates", "reused")


# ---------------------------------------------------------------- batches and recombination

_BATCH_SQL = f"""{DRAW_SQL.replace("ids AS (SELECT o_orderkey AS id FROM orders)", "ids AS (SELECT o_orderkey AS id FROM orders)")},
rows_ AS (SELECT id, id // 4 AS batch_id, id % 4 AS position FROM ids),
mix AS (
  SELECT r.id, r.batch_id, c.key, c.txt, c.num FROM rows_ r JOIN config c ON c.id = r.batch_id * 4 AND c.step <> 'classifier'
  UNION ALL SELECT r.id, r.batch_id, c.key, c.txt, c.num FROM rows_ r JOIN config c ON c.id = r.id AND c.step = 'classifier')
"""


@query("two_step_batches", f"WITH {_BATCH_SQL} SELECT id, batch_id, {_ENTRY} FROM mix")
def _(spark, sf):
    return entries(C.draw_batches(_ids(spark, sf), "id", 4), "id", "batch_id")


@query(
    "two_step_random_sizes",
    f"""WITH r AS (SELECT o_orderkey // 5 AS batch_id, o_orderkey % 5 AS position FROM orders)
SELECT batch_id, count(*) AS n FROM r WHERE position < 1 + floor({_u("'1:' || CAST(batch_id AS VARCHAR) || ':size'")} * 4) GROUP BY batch_id""",
)
def _(spark, sf):
    return C.draw_batches(_ids(spark, sf), "id", 5, random_size=True).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("recombined_batches", f"WITH {_BATCH_SQL} SELECT id, batch_id, {_ENTRY} FROM mix WHERE id % 4 <> 0")
def _(spark, sf):
    ids = _ids(spark, sf)
    batch = F.floor(F.col("id") / 4).cast("bigint")
    starts = C.draw_candidates(ids.filter("id % 4 = 0"), "id", 1, steps=C.CONSTANT_STEPS).withColumn("batch_id", batch)
    others = C.draw_candidates(ids.filter("id % 4 <> 0"), "id", 1, steps=C.VARIABLE_STEPS).withColumn("batch_id", batch)
    return entries(C.recombine(starts, others, "batch_id"), "id", "batch_id")


@query("union_of_batches", "SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part")
def _(spark, sf):
    a = C.draw_candidates(_ids(spark, sf), "id", 1).select("id", "config", F.lit("orders").alias("source"))
    b = C.draw_candidates(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", 2).select("id", "config", F.lit("parts").alias("source"))
    return C.union_batches(a, b).groupBy("source").agg(F.count("config").alias("n"))


# ---------------------------------------------------------------- legality

def _walk_sql(source: str) -> str:
    """Chained state of (sparse, signed) over the six chosen nodes of every row of ``source``."""
    sql, prev = "", source
    for i in range(6):
        sql += f"""
w{i} AS (SELECT s.* REPLACE (
    CASE WHEN list_contains(outp, 'DENSE') THEN FALSE WHEN list_contains(outp, 'SPARSE') THEN TRUE ELSE sparse END AS sparse,
    CASE WHEN list_contains(outp, 'SIGNED') THEN TRUE WHEN list_contains(outp, 'UNSIGNED') THEN FALSE ELSE signed END AS signed,
    legal AND (CASE WHEN sparse THEN list_contains(inp, 'SPARSE') ELSE list_contains(inp, 'DENSE') END) AND (signed OR list_contains(inp, 'UNSIGNED')) AS legal)
  FROM {prev} s JOIN choice c ON c.id = s.id AND c.spos = {i}),"""
        prev = f"w{i}"
    return sql.rstrip(",")


_KIND_SQL = "start_ AS (SELECT id, id % 3 = 0 AS sparse, id % 2 = 0 AS signed, TRUE AS legal, id % 3 = 0 AS sparse0, id % 2 = 0 AS signed0 FROM ids)"
LEGAL_SQL = f"{DRAW_SQL}, {_KIND_SQL}, {_walk_sql('start_')}"


def _legal_candidates(spark, sf):
    drawn = C.with_choices(order_candidates(spark, sf)).withColumn("sparse", F.col("id") % 3 == 0).withColumn("signed", F.col("id") % 2 == 0)
    return drawn.withColumn("legal", C.is_legal({s: F.col(s) for s in STEP_NAMES}, F.col("sparse"), F.col("signed")))


@query("legal_candidates", f"WITH {LEGAL_SQL} SELECT id, sparse0 AS sparse, signed0 AS signed, legal FROM w5")
def _(spark, sf):
    return _legal_candidates(spark, sf).select("id", "sparse", "signed", "legal")


@query(
    "active_choices",
    f"WITH {LEGAL_SQL} SELECT DISTINCT step, node FROM choice JOIN w5 USING (id) WHERE legal AND sparse0 AND NOT signed0",
)
def _(spark, sf):
    rows = _legal_candidates(spark, sf).filter(F.col("sparse") & ~F.col("signed"))
    return C.active_choices(rows, STEP_NAMES)


_FULL_SQL = f"""
node(step, spos, node, idx, n, inp, outp) AS (VALUES {NODE_VALUES}),
kinds AS (SELECT a AS sparse0, b AS signed0 FROM (VALUES (TRUE), (FALSE)) x(a), (VALUES (TRUE), (FALSE)) y(b)),
combos AS (SELECT row_number() OVER () AS id, k.sparse0, k.signed0, n0.node AS c0, n1.node AS c1, n2.node AS c2, n3.node AS c3, n4.node AS c4, n5.node AS c5
  FROM kinds k, node n0, node n1, node n2, node n3, node n4, node n5
  WHERE n0.spos = 0 AND n1.spos = 1 AND n2.spos = 2 AND n3.spos = 3 AND n4.spos = 4 AND n5.spos = 5),
choice AS (SELECT id, spos, node, inp, outp FROM (SELECT id, unnest(range(0, 6)) AS spos, unnest([c0, c1, c2, c3, c4, c5]) AS node FROM combos) JOIN node USING (spos, node)),
start_ AS (SELECT id, sparse0 AS sparse, signed0 AS signed, TRUE AS legal, sparse0, signed0 FROM combos), {_walk_sql('start_')}
"""


@query(
    "legal_combinations_per_dataset",
    f"""WITH {_FULL_SQL}, legal AS (SELECT sparse0 AS sparse, signed0 AS signed, c5 AS classifier, count(*) FILTER (legal) AS legal_combinations FROM w5 JOIN combos USING (id, sparse0, signed0) GROUP BY ALL),
ds AS (SELECT user_id, avg(CASE WHEN value < 10 THEN 1.0 ELSE 0 END) > 0.4 AS sparse, min(value) >= 0.1 AS signed FROM events GROUP BY user_id)
SELECT user_id, sparse, signed, classifier, legal_combinations FROM ds JOIN legal USING (sparse, signed)""",
)
def _(spark, sf):
    kinds = C.legal_table(spark).groupBy("sparse", "signed", "classifier").agg(F.count(F.when(F.col("legal"), 1)).alias("legal_combinations"))
    sets = table(spark, sf, "events").groupBy("user_id").agg(
        (F.avg(F.when(F.col("value") < 10, 1.0).otherwise(0.0)) > 0.4).alias("sparse"), (F.min("value") >= 0.1).alias("signed")
    )
    return sets.join(kinds, ["sparse", "signed"]).select("user_id", "sparse", "signed", "classifier", "legal_combinations")


@query(
    "never_legal_chains",
    """WITH rows_ AS (SELECT p_type AS a, o_orderpriority AS b, l_returnflag AS c,
  NOT (p_type = 'SMALL' AND o_orderpriority = '1-URGENT') AND NOT (o_orderpriority = '2-HIGH' AND l_returnflag = 'N')
  AND NOT (p_type = 'ECONOMY' AND o_orderpriority = '2-HIGH' AND l_returnflag = 'A') AND NOT (p_type = 'LARGE') AS legal
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
m AS (SELECT a, b, c, max(legal::INT) AS ok FROM rows_ GROUP BY ALL),
t AS (SELECT * FROM m WHERE a IN (SELECT a FROM m WHERE ok = 1) AND b IN (SELECT b FROM m WHERE ok = 1) AND c IN (SELECT c FROM m WHERE ok = 1)),
ab AS (SELECT a, b FROM t GROUP BY a, b HAVING max(ok) = 0), bc AS (SELECT b, c FROM t GROUP BY b, c HAVING max(ok) = 0),
abc AS (SELECT a, b, c FROM t WHERE ok = 0 AND (a, b) NOT IN (SELECT (a, b) FROM ab) AND (b, c) NOT IN (SELECT (b, c) FROM bc))
SELECT 0 AS start, 2 AS length, a || '|' || b AS chain FROM ab UNION ALL SELECT 1, 2, b || '|' || c FROM bc UNION ALL SELECT 0, 3, a || '|' || b || '|' || c FROM abc""",
)
def _(spark, sf):
    p, o, f = F.col("p_type"), F.col("o_orderpriority"), F.col("l_returnflag")
    legal = (
        ~((p == "SMALL") & (o == "1-URGENT")) & ~((o == "2-HIGH") & (f == "N")) & ~((p == "ECONOMY") & (o == "2-HIGH") & (f == "A")) & ~(p == "LARGE")
    )
    rows = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
        .join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
        .join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
        .select("p_type", "o_orderpriority", "l_returnflag", legal.alias("legal"))
    )
    out = C.never_legal_chains(rows, ["p_type", "o_orderpriority", "l_returnflag"])
    return out.select("start", "length", F.array_join("chain", "|").alias("chain"))


# ---------------------------------------------------------------- the space against the drawn configurations

@query(
    "node_usage",
    f"WITH {DRAW_SQL}, u AS (SELECT step, node, count(*) AS drawn FROM choice GROUP BY ALL) "
    "SELECT n.step, CAST(spos AS INTEGER) AS pos, n.node, list_contains(inp, 'SPARSE') AS takes_sparse, list_contains(inp, 'UNSIGNED') AS takes_unsigned, coalesce(drawn, 0) AS drawn FROM node n LEFT JOIN u USING (step, node)",
)
def _(spark, sf):
    cells = C.with_choices(order_candidates(spark, sf)).select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("node")) for s in STEP_NAMES])).alias("e")
    )
    used = cells.groupBy("e.step", "e.node").agg(F.count(F.lit(1)).alias("drawn"))
    space = nodes_table(spark).join(steps_table(spark).select("step", "pos"), "step")
    return space.join(used, ["step", "node"], "left").select(
        "step", "pos", "node", F.array_contains("input", "SPARSE").alias("takes_sparse"), F.array_contains("input", "UNSIGNED").alias("takes_unsigned"),
        F.coalesce("drawn", F.lit(0)).alias("drawn"),
    )


@query(
    "parameter_usage",
    f"WITH {DRAW_SQL}, u AS (SELECT key, count(*) AS drawn, round(avg(num), 4) + 0 AS mean FROM active GROUP BY key) "
    "SELECT p.key, kind, parent IS NOT NULL AS conditional, coalesce(drawn, 0) AS drawn, mean FROM param p LEFT JOIN u USING (key)",
)
def _(spark, sf):
    used = order_candidates(spark, sf).select(F.explode_outer("config").alias("key", "value")).groupBy("key").agg(
        F.count(F.lit(1)).alias("drawn"), (F.round(F.avg(drawn_number("value")), 4) + 0.0).alias("mean")
    )
    space = params_table(spark).select(F.concat_ws(":", "step", "node", "param").alias("key"), "kind", F.col("parent").isNotNull().alias("conditional"))
    return space.join(used, "key", "left").select("key", "kind", "conditional", F.coalesce("drawn", F.lit(0)).alias("drawn"), "mean")


# ---------------------------------------------------------------- row subsets

@query("downsample_rows", "SELECT vec_id AS row_id, label FROM embeddings WHERE vec_id < 100")
def _(spark, sf):
    return downsample(vectors(spark, sf), 100).select("row_id", "label")


@query(
    "split_by_index",
    "SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    train, test = split_by_index(docs, table(spark, sf, "labels").select("doc_id"), "doc_id")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
