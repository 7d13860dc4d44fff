"""All registered queries of the library, but those of sparkloom.llm."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import ALL, register
from .frame_queries import BUILDERS
from .sql_queries import PAIRS, SAME


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    named = [t for t in ALL if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, named)
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _sql(v) for k, v in SAME.items()} | {k: _sql(v[0]) for k, v in PAIRS.items()} | {k: f for k, (f, _) in BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SAME) | {k: v[1] for k, v in PAIRS.items()} | {k: sql for k, (_, sql) in BUILDERS.items() if sql}
