"""Scalar and array expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwright.functions.constants import METRIC_CODES, PROPERTY_CODES, TASK_CODES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- arrays of numbers

def doubles(features: Column | str) -> Column:
    return _col(features).cast("array<double>")


def to_float32(features: Column | str) -> Column:
    """Narrow an array before it is stored."""
    return _col(features).cast("array<float>")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def argmax_index(scores: Column | str) -> Column:
    """Zero-based position of the largest score; the first one wins a tie."""
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def argmax_one_hot(scores: Column | str) -> Column:
    s = _col(scores)
    best = argmax_index(s)
    return F.transform(s, lambda _, i: (i == best).cast("int"))


def one_hot(label: Column | str, k: int) -> Column:
    """Indicator array of length k; a label outside 0..k-1 is an error."""
    lab = _col(label).cast("int")
    outside = (lab < 0) | (lab >= k)
    checked = F.when(outside, F.raise_error(F.concat(F.lit("label outside the class range: "), lab.cast("string"))).cast("int")).otherwise(lab)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: (c == checked).cast("int"))


def class_index(indicators: Column | str) -> Column:
    """Dot product of an indicator row with 0..k-1."""
    a = _col(indicators).cast("array<double>")
    return F.aggregate(F.transform(a, lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x).cast("int")


def binarize(p: Column | str) -> Column:
    return (_col(p) >= 0.5).cast("int")


def clip_nonnegative(features: Column | str) -> Column:
    return F.transform(_col(features), lambda x: F.greatest(x, F.lit(0).cast("double")))


def l1_normalize(features: Column | str) -> Column:
    a = doubles(features)
    norm = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return F.transform(a, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def l2_normalize(features: Column | str) -> Column:
    a = doubles(features)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(a, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def sigmoid_pair(score: Column | str) -> Column:
    """[1-p, p] for one decision value, clamped to +-20 and snapped near 0 and 1."""
    s = F.greatest(F.least(_col(score), F.lit(20.0)), F.lit(-20.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-s))
    p = F.when(p > 0.999999, 1.0).when(p < 0.0000001, 0.0).otherwise(p)
    return F.array(F.lit(1.0) - p, p)


def softmax(scores: Column | str) -> Column:
    s = doubles(scores)
    top = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - top))
    total = array_sum(e)
    return F.transform(e, lambda x: x / total)


def positive_probs(per_label: Column | str) -> Column:
    """Per-label [p0, p1] arrays to an array of P(1); a label never seen positive gives 0."""
    return F.transform(
        _col(per_label),
        lambda p: F.when(F.size(p) > 2, F.raise_error(F.lit("more than two classes for one label")).cast("double"))
        .when(F.size(p) == 2, F.get(p, F.lit(1)))
        .otherwise(F.lit(0.0)),
    )


def transform_selected(features: Column | str, selected: list[int], fn) -> Column:
    """Apply ``fn`` to the sub-array of the selected columns; the others go to the right."""
    a = _col(features)
    if not selected:
        return a
    picked = F.filter(a, lambda _, i: i.isin(*selected))
    rest = F.filter(a, lambda _, i: ~i.isin(*selected))
    return F.concat(fn(picked), rest)


# ---------------------------------------------------------------- strings and codes

def parse_number(value: Column | str) -> Column:
    """Integer where the text is all digits, otherwise NULL."""
    v = _col(value)
    return F.when(v.rlike("^[0-9]+$"), v.cast("bigint"))


def true_string(value: Column | str) -> Column:
    return F.lower(F.trim(_col(value))) == "true"


def _code(value: Column | str, codes: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.element_at(table, _col(value))


def task_code(name: Column | str) -> Column:
    return _code(name, TASK_CODES)


def metric_code(name: Column | str) -> Column:
    return _code(name, METRIC_CODES)


def property_code(name: Column | str) -> Column:
    return _code(name, PROPERTY_CODES)


# ---------------------------------------------------------------- configurations (MAP<STRING,STRING>)

def step_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def project_step(config: Column | str, steps: list[str]) -> Column:
    """Entries whose step prefix is in the list."""
    return F.map_filter(_col(config), lambda k, _: step_of(k).isin(*steps))


def chosen_node(config: Column | str, step: str) -> Column:
    return F.element_at(_col(config), F.lit(f"{step}:__choice__"))


def node_params(config: Column | str, step: str) -> Column:
    """Hyperparameters of the chosen node, with ``step:node:`` stripped."""
    cfg = _col(config)
    prefix = F.concat(F.lit(f"{step}:"), chosen_node(cfg, step), F.lit(":"))
    mine = F.map_filter(cfg, lambda k, _: F.startswith(k, prefix))
    return F.transform_keys(mine, lambda k, _: F.substring(k, F.length(prefix) + 1, F.length(k)))


def fill_defaults(config: Column | str, defaults: Column | str) -> Column:
    """Missing or NULL entries take the default."""
    given = F.map_filter(_col(config), lambda _, v: v.isNotNull())
    unset = F.map_filter(_col(defaults), lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(given, unset)


def overlay(base: Column | str, top: Column | str) -> Column:
    """Union of two maps where ``top`` wins."""
    b, t = _col(base), _col(top)
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(t, k)), t)


def prefix_of(config: Column | str, steps: list[str], step: str) -> Column:
    """Entries of all earlier steps plus this step's choice and its chosen node's parameters."""
    cfg = _col(config)
    earlier = steps[: steps.index(step)]
    own = F.concat(F.lit(f"{step}:"), chosen_node(cfg, step), F.lit(":"))
    in_earlier = (lambda k: step_of(k).isin(*earlier)) if earlier else (lambda k: F.lit(False))
    return F.map_filter(
        cfg,
        lambda k, v: v.isNotNull() & (in_earlier(k) | (k == f"{step}:__choice__") | F.startswith(k, own)),
    )


def config_key(config: Column | str) -> Column:
    """Order-free key of a configuration map."""
    pairs = F.transform(F.map_entries(_col(config)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.md5(F.array_join(F.array_sort(pairs), ";"))


# ---------------------------------------------------------------- hashing to uniform numbers

def uniform_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5 over the joined parts."""
    text = F.concat_ws(":", *[(_col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
