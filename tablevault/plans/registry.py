"""Where checked plans and their DuckDB oracles are registered, and what they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablevault.session import ensure_checkpoint_dir

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    def deco(fn):
        PLANS[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of one run in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
