"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: rows and bytes of one Arrow batch handed to a Python worker
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: Column | str) -> Column:
    """The text as a string; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else.  ``lower`` does just that on a text
    whose characters are all one byte; other texts go through ``translate``."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def frozen(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder all executors share, and read
    back: the work is done once and a lost executor costs a read."""
    spark = df.sparkSession
    path = scratch_path(spark, "retentio-llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for a worker, whatever the texts' length.  The session keeps the setting: it is
    read when a query runs, which is after its operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def worker_state(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker process, so tables
    and caches built for one task serve the next one too; that of another
    operator is dropped, so a worker holds one operator's at a time."""
    module = sys.modules.get("_retentio_worker_state")
    if module is None:
        module = sys.modules["_retentio_worker_state"] = types.ModuleType("_retentio_worker_state")
    if getattr(module, "owner", None) != owner:
        module.owner, module.state = owner, {}
    return module.state


#: characters of the longest key that a cache remembers; texts without spaces are one chunk each
LONGEST_KEY = 64


class BoundedCache(dict):
    """Values computed on first use, in two generations of ``limit`` entries:
    a full one retires, within a text, too, and what is used again comes back
    from there.  Keys of over ``LONGEST_KEY`` characters are computed each time,
    so an entry has a bounded size, too (values here are at most as many numbers
    as the key has bytes).  Memory is bounded and results never depend on it."""

    def __init__(self, compute, limit: int = 600_000):
        super().__init__()
        self.compute = compute
        self.limit = limit
        self.old: dict = {}

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.trim()
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


_ARROW = {"bigint": "int64", "int": "int32", "double": "float64", "boolean": "bool_", "string": "string", "binary": "binary"}


def per_document(docs: DataFrame, make_work, fields: list[tuple[str, str]], column: str = "text") -> DataFrame:
    """doc_id and ``fields`` for every row, computed in Arrow batches.

    ``make_work()`` is called once per task in the worker; what it returns maps
    the batch's values of ``column`` to one list per field.  A null value reaches it as
    None, any other as it is.
    """
    bounded_batches(docs.sparkSession)
    types_ = [(name, _ARROW[kind]) for name, kind in fields]

    def run(batches):
        import pyarrow as pa

        work = make_work()
        for batch in batches:
            columns = work(batch.column(1).to_pylist())
            arrays = [pa.array(c, getattr(pa, kind)()) for c, (_, kind) in zip(columns, types_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *[n for n, _ in types_]])

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {key}", *[f"{n} {kind}" for n, kind in fields]])
    return docs.select("doc_id", column).mapInArrow(run, schema)
