"""The library's own settings, as session settings named sparkloom.*, checked when read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Setting:
    name: str
    default: object
    doc: str

    def read(self, spark: SparkSession):
        raw = spark.conf.get(f"sparkloom.{self.name}", None)
        if raw is None:
            return self.default
        if isinstance(self.default, bool):
            if raw.lower() not in ("true", "false"):
                raise ValueError(f"sparkloom.{self.name} must be true or false, not {raw!r}")
            return raw.lower() == "true"
        try:
            return type(self.default)(raw)
        except ValueError as e:
            raise ValueError(f"sparkloom.{self.name} must be {type(self.default).__name__}, not {raw!r}") from e


SETTINGS = {
    s.name: s
    for s in (
        Setting("join.mode", "auto", "off, hash, merge or auto: what decide_join() may choose"),
        Setting("join.spillBytes", 256 * 1024 * 1024, "largest build side of a task that is hashed in memory"),
        Setting("join.capFactor", 32, "build sides beyond capFactor * spillBytes a task are merged"),
        Setting("broadcast.maxBytes", 64 * 1024 * 1024, "largest side that broadcast_if_small() broadcasts"),
        Setting("rollup.chain", True, "compute nested grouping sets one from the other"),
        Setting("merge.checkCardinality", True, "raise when a target row matches several source rows"),
    )
}


def get(spark: SparkSession, name: str):
    return SETTINGS[name].read(spark)
