"""Registered queries: each has a Spark form and, where SQL can say it, an oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from camtrail import ship
from camtrail.scale import shared_folder
from checks.views import Data, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def stored(d: Data, make, base: DataFrame):
    """``base`` as a keyed table in the folder that all executors share."""
    table = make(d.spark, f"{shared_folder(d.spark).rstrip('/')}/index-{uuid.uuid4().hex}", base.schema)
    table.upsert(base, "base")
    return table


def query(name: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame`` under ``name``; ``sql`` may use the views by name."""

    def add(fn: Callable[[Data], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark, "checks")
            return fn(Data(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add
