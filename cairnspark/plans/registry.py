"""Registered catalog queries: every operator over the projected catalog, and the same shape for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.operators import by_change, by_name, by_plan, by_rest, by_source, by_transfer, by_tree, ingest, maintenance, scalars, search, storage, transfer, tree
from cairnspark.plans.dialect import Duck, Spark
from cairnspark.sources.fixtures import statement

#: One shape for both engines.
MODULES = (scalars, tree, storage, ingest, maintenance, search, transfer)
#: Functions of DataFrames, and statements written apart from them.
APART = (by_name, by_tree, by_change, by_transfer, by_plan, by_source, by_rest)


def operators() -> dict:
    out: dict = {}
    for m in MODULES:
        assert not out.keys() & m.OPERATORS.keys()
        out |= m.OPERATORS
    return out


def _query(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Spark(sf_dir)
        return spark.sql(statement(d, make(d)))

    return run


def apart() -> dict:
    out: dict = {}
    for m in APART:
        assert not out.keys() & m.QUERIES.keys()
        out |= m.QUERIES
    assert not out.keys() & operators().keys()
    return out


def queries() -> dict:
    return {name: _query(make) for name, make in operators().items()} | {name: run for name, (run, _) in apart().items()}


def oracle_sql() -> dict[str, str]:
    d = Duck()
    return {name: statement(d, make(d)) for name, make in operators().items()} | {name: sql for name, (_, sql) in apart().items() if sql}
