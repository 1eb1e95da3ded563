"""Registered model queries run the functions with their full defaults."""

import inspect

import pytest

from panelforge.catalog import model_queries as mq
from panelforge.functions import codebook as cb
from panelforge.operators import encode as en

COLUMNS = [f"c{k}" for k in range(25)]


class Stopped(Exception):
    pass


def recorded(monkeypatch, module, name, stop=True):
    """The arguments that a call of module.name gets, its defaults included."""
    seen, signature = {}, inspect.signature(getattr(module, name))

    def record(*args, **named):
        call = signature.bind(*args, **named)
        call.apply_defaults()
        seen.update(call.arguments)
        if stop:
            raise Stopped
        return []

    monkeypatch.setattr(module, name, record)
    return seen


@pytest.fixture(autouse=True)
def columns(spark, monkeypatch):
    monkeypatch.setattr(mq, "design", lambda *_: (spark.createDataFrame([(1, False)], "id long, is_test boolean"), COLUMNS))


@pytest.mark.parametrize(
    "query, module, name, want",
    [
        ("multi_metric_folds", mq.md, "prepared_folds", {"folds": cb.FOLDS}),
        ("chosen_penalty", mq.tr, "choose_c", {"folds": cb.FOLDS, "c_values": tuple(cb.CHOSEN_C_VALUES)}),
        ("logistic_search", mq.tr, "search_logistic", {"folds": cb.FOLDS, "grid": cb.LOGISTIC_GRID}),
        ("forest_search", mq.tr, "search_forest", {"folds": cb.FOLDS, "grid": cb.FOREST_GRID}),
        ("feature_elimination_folds", mq.ex, "eliminate_with_folds", {"folds": cb.FOLDS}),
    ],
)
def test_full_defaults(spark, monkeypatch, query, module, name, want):
    seen = recorded(monkeypatch, module, name)
    with pytest.raises(Stopped):
        getattr(mq, query)(spark, "unused")
    assert {k: seen[k] for k in want} == want and list(seen["columns"]) == COLUMNS


def test_full_defaults_of_the_comparison(spark, monkeypatch):
    folds = recorded(monkeypatch, mq.md, "prepared_folds", stop=False)
    models = recorded(monkeypatch, mq.tr, "model_set")
    with pytest.raises(Stopped):
        mq.model_comparison(spark, "unused")
    assert folds["folds"] == cb.FOLDS and folds["columns"] == COLUMNS and models == {"boost_rounds": 100, "trees_each": 100}


def test_one_hot_of_many_levels(spark):
    rows = spark.range(1200).selectExpr("format_string('v%04d', id) as kind")
    found = en.require_levels(rows, ["kind"])["kind"]
    assert found == [f"v{k:04d}" for k in range(1200)] and len(en.one_hot("kind", found)) == 1199
