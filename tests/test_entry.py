"""The driver contract with and without the training-data subpackage."""

import importlib.util

import __spark_entry__
from penprint.plans.registry import load_all


def test_works_without_the_training_data_subpackage(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec",
                        lambda name, *a: None if name.startswith("penprint.llm") else found(name, *a))
    assert set(__spark_entry__.queries()) == set(load_all())
    assert set(__spark_entry__.oracle_sql()) == {n for n, (_, sql) in load_all().items() if sql}


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
