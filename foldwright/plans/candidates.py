"""Candidate configurations: drawing, recombination, legality and forbidden combinations.

A configuration is a MAP<STRING,STRING>.  Every random choice is a hash of (seed, id, name), so
candidates are drawn by a projection over a table of ids: no shuffle, no state, and a retry of a
task draws the same rows.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.exprs import chosen_node, config_key, overlay, project_step, uniform_hash
from foldwright.plans.space import CONSTANT_STEPS, FORBIDDEN_VALUES, NODES, PARAMS, STEP_NAMES, VARIABLE_STEPS, Param, forbidden_table, nodes_of


# ---------------------------------------------------------------- drawing

_SPACE_TYPE = (
    "array<struct<node:string,params:array<struct<key:string,kind:string,log:boolean,low:double,high:double,"
    "choices:array<string>,parent:string,parent_choices:array<string>,parent_values:array<string>>>>>"
)


def _param_entry(p: Param) -> dict:
    parent = next((q for q in PARAMS if (q.step, q.node, q.name) == (p.step, p.node, p.parent)), None)
    return {
        "key": p.key, "kind": p.kind, "log": p.log, "low": p.low, "high": p.high, "choices": list(p.choices),
        "parent": parent.key if parent else None, "parent_choices": list(parent.choices) if parent else [],
        "parent_values": list(p.parent_values),
    }


def _node_literals(step: str, names: list[str]) -> Column:
    """Constant array of (node, its parameters) for one step; one literal that Spark folds once."""
    space = [{"node": n, "params": [_param_entry(p) for p in PARAMS if (p.step, p.node) == (step, n)]} for n in names]
    return F.from_json(F.lit(json.dumps(space)), _SPACE_TYPE)


def _at(options: Column, u: Column) -> Column:
    return F.get(options, F.floor(u * F.size(options)).cast("int"))


def draw_value(p: Column, u: Column) -> Column:
    """Value of a parameter (a struct) as a string, for a uniform number in [0, 1)."""
    spread = lambda lo, hi: F.exp(F.log(lo) + u * (F.log(hi) - F.log(lo)))
    return (
        F.when(p["kind"] == "cat", _at(p["choices"], u))
        .when((p["kind"] == "float") & p["log"], spread(p["low"], p["high"]).cast("string"))
        .when(p["kind"] == "float", (p["low"] + u * (p["high"] - p["low"])).cast("string"))
        .when(p["log"], F.floor(spread(p["low"] - 0.5, p["high"] + 0.5) + 0.5).cast("int").cast("string"))
        .otherwise(F.floor(p["low"] + u * (p["high"] - p["low"] + 1)).cast("int").cast("string"))
    )


def draw_config(
    seed: int, id_col: Column, preprocessors: list[str] | None = None, classifiers: list[str] | None = None, steps: list[str] | None = None
) -> Column:
    """One configuration per id: a node per step, then the active parameters of the chosen nodes.

    With ``steps`` only these are drawn; no draw depends on another step, so this is the projection
    of the whole configuration.

    The space is a constant array per step, so the expression stays the same size however many
    nodes and parameters there are, and only the parameters of the chosen node are drawn.
    """

    def entries_of(step: str, chosen: Column) -> Column:
        head = F.array(F.struct(F.lit(f"{step}:__choice__").alias("key"), chosen["node"].alias("value")))
        live = F.filter(
            chosen["params"],
            lambda p: p["parent"].isNull()
            | F.array_contains(p["parent_values"], _at(p["parent_choices"], uniform_hash(F.lit(seed), id_col, p["parent"]))),
        )
        drawn = F.transform(live, lambda p: F.struct(p["key"].alias("key"), draw_value(p, uniform_hash(F.lit(seed), id_col, p["key"])).alias("value")))
        return F.concat(head, drawn)

    parts = []
    for step in STEP_NAMES if steps is None else [s for s in STEP_NAMES if s in steps]:
        literals = _node_literals(step, nodes_of(step, preprocessors, classifiers))
        one = F.array(_at(literals, uniform_hash(F.lit(seed), id_col, F.lit(step))))
        # going through a one-element array evaluates the choice once
        parts.append(F.flatten(F.transform(one, partial(entries_of, step))))
    return F.map_from_entries(F.concat(*parts)) if parts else F.create_map().cast("map<string,string>")


def _once(rows: DataFrame, config: Column) -> DataFrame:
    """Add the drawn configuration behind a generator.

    Filters and projections on a plain column are merged into its expression, which would draw the
    configuration once per use; nothing is pushed through an outer generator.
    """
    return rows.select("*", F.explode_outer(F.array(config)).alias("config"))


def draw_candidates(ids: DataFrame, id_col: str, seed: int = 1, preprocessors=None, classifiers=None, steps=None) -> DataFrame:
    """(id, config, config_id) for every id of a table; forbidden configurations are still included."""
    out = _once(ids.select(id_col), draw_config(seed, F.col(id_col), preprocessors, classifiers, steps))
    return out.withColumn("config_id", config_key("config"))


def draw_choices(ids: DataFrame, id_col: str, seed: int = 1, preprocessors=None, classifiers=None) -> DataFrame:
    """The ids with one column per step: the node that ``draw_candidates`` chooses, without its parameters."""
    node = lambda s: F.array(*[F.lit(n) for n in nodes_of(s, preprocessors, classifiers)])
    return ids.withColumns({s: _at(node(s), uniform_hash(F.lit(seed), F.col(id_col), F.lit(s))) for s in STEP_NAMES})


def sample_candidates(spark, n: int, seed: int = 1, preprocessors=None, classifiers=None) -> DataFrame:
    """n drawn configurations without the forbidden ones (their ids are simply missing)."""
    return allowed(draw_candidates(spark.range(n), "id", seed, preprocessors, classifiers))


def draw_batches(
    ids: DataFrame, id_col: str, batch: int, seed: int = 1, random_size: bool = False,
    constant: list[str] | None = None, variable: list[str] | None = None,
) -> DataFrame:
    """(id, batch_id, position, config): the ids are cut into batches of ``batch``.

    The first configuration of a batch is drawn freely; the others keep its constant steps and
    draw the variable ones.  With ``random_size`` a batch holds 1 to ``batch - 1`` configurations.
    The start configuration is redrawn from its id, so no join is needed.
    """
    start = F.col("batch_id") * batch
    rows = ids.select(id_col, F.floor(F.col(id_col) / batch).cast("bigint").alias("batch_id"), (F.col(id_col) % batch).cast("int").alias("position"))
    if random_size:
        size = F.floor(uniform_hash(F.lit(seed), F.col("batch_id"), F.lit("size")) * (batch - 1)).cast("int") + 1
        rows = rows.filter(F.col("position") < size)
    fixed = draw_config(seed, start, steps=constant or CONSTANT_STEPS)
    own = draw_config(seed, F.col(id_col), steps=variable or VARIABLE_STEPS)
    return _once(rows, F.map_concat(fixed, own)).withColumn("config_id", config_key("config"))


def recombine(starts: DataFrame, others: DataFrame, batch_id: str, constant: list[str] | None = None, variable: list[str] | None = None) -> DataFrame:
    """Constant part of each start configuration with the variable part of the others of its batch."""
    s = starts.select(batch_id, project_step("config", constant or CONSTANT_STEPS).alias("_start"))
    o = others.withColumn("_own", project_step("config", variable or VARIABLE_STEPS))
    joined = o.join(s, batch_id).withColumn("config", overlay("_start", "_own")).drop("_start", "_own")
    return joined.withColumn("config_id", config_key("config"))


def union_batches(first: DataFrame, *more: DataFrame) -> DataFrame:
    out = first
    for m in more:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- forbidden combinations

def allowed(candidates: DataFrame, config: str = "config") -> DataFrame:
    """Drop candidates with a forbidden (preprocessor, classifier) pair or forbidden parameter values."""
    pairs = forbidden_table(candidates.sparkSession)  # 21 fixed rows
    keyed = candidates.withColumn("_pre", chosen_node(config, "feature_preprocessor")).withColumn("_clf", chosen_node(config, "classifier"))
    kept = keyed.join(F.broadcast(pairs), (F.col("_pre") == pairs["preprocessor"]) & (F.col("_clf") == pairs["classifier"]), "left_anti")
    cfg = F.col(config)
    clash = F.lit(False)
    for clause in FORBIDDEN_VALUES:
        every = F.lit(True)
        for key, values in clause.items():
            every = every & F.coalesce(F.element_at(cfg, F.lit(key)).isin(*values), F.lit(False))
        clash = clash | every
    return kept.filter(~clash).drop("_pre", "_clf")


# ---------------------------------------------------------------- legality

def is_legal(choices: dict[str, Column], sparse: Column, signed: Column) -> Column:
    """Walk the steps from left to right with the (sparse, signed) state of the data."""
    legal = F.lit(True)
    for step in STEP_NAMES:
        node = choices[step]
        having = lambda flag, side: [n for s, n, i, o in NODES if s == step and flag in (i if side == "in" else o)]  # noqa: B023, E731
        legal = legal & F.when(sparse, node.isin(having("SPARSE", "in"))).otherwise(node.isin(having("DENSE", "in")))
        legal = legal & (signed | node.isin(having("UNSIGNED", "in")))
        to_dense, to_sparse = having("DENSE", "out"), having("SPARSE", "out")
        to_signed, to_unsigned = having("SIGNED", "out"), having("UNSIGNED", "out")
        sparse = F.when(node.isin(to_dense), False).when(node.isin(to_sparse), True).otherwise(sparse) if to_dense or to_sparse else sparse
        signed = F.when(node.isin(to_signed), True).when(node.isin(to_unsigned), False).otherwise(signed) if to_signed or to_unsigned else signed
    return legal


def with_choices(candidates: DataFrame, config: str = "config") -> DataFrame:
    """One column per step with the chosen node."""
    return candidates.withColumns({step: chosen_node(config, step) for step in STEP_NAMES})


def legal_table(spark, preprocessors: list[str] | None = None, classifiers: list[str] | None = None) -> DataFrame:
    """(sparse, signed, one column per step, legal): all combinations for the four kinds of data.

    The combinations are fixed by the node list (780 per kind for the full space).
    """
    out = spark.createDataFrame([(a, b) for a in (False, True) for b in (False, True)], "sparse boolean, signed boolean")
    for step in STEP_NAMES:
        out = out.withColumn(step, F.explode(F.array(*[F.lit(n) for n in nodes_of(step, preprocessors, classifiers)])))
    return out.withColumn("legal", is_legal({s: F.col(s) for s in STEP_NAMES}, F.col("sparse"), F.col("signed")))


def active_choices(candidates: DataFrame, steps: list[str], legal: str = "legal") -> DataFrame:
    """(step, node) pairs that occur in at least one legal candidate."""
    cells = candidates.filter(F.col(legal)).select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("node")) for s in steps])).alias("e")
    )
    return cells.select("e.step", "e.node").distinct()


def only_active(choices: DataFrame, active: DataFrame) -> DataFrame:
    return choices.join(active, ["step", "node"], "left_semi")


def never_legal_chains(rows: DataFrame, chain: list[str], legal: str = "legal") -> DataFrame:
    """Shortest contiguous sub-chains of choices that are never legal, as (start, length, chain).

    Only choices that are legal somewhere take part, and a chain that contains a shorter
    forbidden chain is left out.  The rows are first reduced to one row per combination.
    """
    combos = rows.groupBy(*chain).agg(F.max(F.col(legal).cast("int")).alias("_ok"))
    for step in chain:
        live = combos.filter("_ok = 1").select(step).distinct()
        combos = combos.join(live, step, "left_semi")
    found: DataFrame | None = None
    for length in range(2, len(chain) + 1):
        new = []
        for start in range(len(chain) - length + 1):
            part = chain[start : start + length]
            dead = combos.groupBy(*part).agg(F.max("_ok").alias("_ok")).filter("_ok = 0")
            as_chain = dead.select(F.lit(start).alias("start"), F.lit(length).alias("length"), F.array(*[F.col(c).cast("string") for c in part]).alias("chain"))
            if found is not None:
                f = found.select(F.col("start").alias("_s"), F.col("length").alias("_n"), F.col("chain").alias("_c"))
                for offset in range(length):
                    for n in range(2, length - offset + 1):
                        if n == length:
                            continue
                        sub = f.filter((F.col("_s") == start + offset) & (F.col("_n") == n)).select("_c")
                        as_chain = as_chain.join(sub, F.slice("chain", offset + 1, n) == F.col("_c"), "left_anti")
            new.append(as_chain)
        for n in new:
            found = n if found is None else found.unionByName(n)
    return found
