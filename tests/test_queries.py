"""Every registered query against its SQL, and quality floors for those without one."""

import pytest
from oracle import compare

import __spark_entry__ as entry_module

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()

# held-out balanced accuracy; guessing gives 1/3 (1/2 for the two-class queries)
FLOORS = {
    "lda_bac": 0.6, "lda_shrunk_bac": 0.6, "qda_bac": 0.4, "decision_tree_bac": 0.5, "random_forest_bac": 0.5, "extra_trees_bac": 0.5,
    "adaboost_bac": 0.5, "adaboost_samme_bac": 0.5, "linear_svm_bac": 0.6, "kernel_svm_bac": 0.4, "sgd_bac": 0.6, "sgd_hinge_bac": 0.6,
    "passive_aggressive_bac": 0.5, "gradient_boosting_bac": 0.7, "multilabel_one_vs_rest": 0.45,
}


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLE[name], sf_dir)
    assert ok, note


@pytest.mark.parametrize("name", sorted(FLOORS))
def test_learns_something(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).first()["bac"] > FLOORS[name]


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 5 and all(0 < r["cost"] < 1 for r in rows)
