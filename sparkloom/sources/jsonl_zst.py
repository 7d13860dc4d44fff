"""A data source of Zstandard-compressed JSON lines, one partition a file: spark.read.format("jsonl_zst").schema(...).load(folder).

Spark reads such files itself only with a native codec; this one needs the zstandard package on the workers. Files are read
as streams of Arrow batches of bounded size, and only the columns of the schema are kept. Missing fields are null; a line that
isn't a JSON object raises. Paths are those that every executor can open."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Lines of a batch.
BATCH = 8192


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class JsonLinesZst(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_zst"

    def schema(self) -> StructType:
        raise ValueError("jsonl_zst needs a schema: no pass is spent on guessing one")

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonLinesZstReader(schema, self.options)


class JsonLinesZstReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]

    def partitions(self) -> list[File]:
        found = sorted(glob.glob(f"{self.path}/*.jsonl.zst")) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(f"no *.jsonl.zst file at {self.path}")
        return [File(x) for x in found]

    def read(self, partition: File):
        import io

        import pyarrow as pa
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        with open(partition.path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as flat:
            rows = []
            for line in io.TextIOWrapper(flat, encoding="utf-8"):
                if line.strip():
                    row = json.loads(line)
                    if not isinstance(row, dict):
                        raise ValueError(f"{partition.path}: a line is no JSON object")
                    rows.append({k: row.get(k) for k in schema.names})
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLinesZst)
