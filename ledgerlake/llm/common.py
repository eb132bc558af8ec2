"""What several operators share: the shared folder, written intermediate tables, Arrow helpers, the words of a text."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every ASCII blank of the contracts' word patterns: \x20 and \x09-\x0D. It is what bytes.split() splits at.
BLANKS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints/ledgerlake"
    return found.rstrip("/")


#: Paths made inside each open scratch(), innermost last.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


class scratch:  # noqa: N801
    """with scratch(spark) as made: on leaving, all that new_path() and save() made inside is deleted, but for what made.keep() hands on."""

    def __init__(self, spark: SparkSession):
        self.spark, self.mine = spark, []

    def __enter__(self) -> scratch:
        _scopes.append(self.mine)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that save() wrote inside: it belongs to the surrounding scratch(), or to the caller, from now on."""
        self.mine.remove(df.saved_at)
        if len(_scopes) > 1:
            _scopes[-2].append(df.saved_at)
        return df

    def __exit__(self, *failure) -> None:
        _scopes.remove(self.mine)
        for path in self.mine:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def save(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.saved_at = path
    return written


#: Written tables of short rows (some tens of bytes) are broadcast up to so many rows; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of short rows, broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= most else df


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that save() wrote and that nothing needs any more."""
    for df in frames:
        delete(spark, df.saved_at)


#: Rows of a batch between Spark and Python: texts are long, and a worker holds a batch of them several times over.
BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> DataFrame:
    """Let the session hand texts to Python in batches of BATCH_ROWS, unless it has smaller ones; returns df."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) <= 0 or int(conf.get(name)) > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def utf8(name: str = "text") -> Column:
    """A text column as its UTF-8 bytes, which Python workers get without decoding; null stays null."""
    return F.col(name).cast("string").cast("binary")


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow over `df`. start() runs once a task and returns what turns a batch into columns (name -> values)."""
    spark = bound_batches(df).sparkSession
    fields = spark.createDataFrame([], schema).schema
    names = fields.fieldNames()
    types = [_arrow(f.dataType.simpleString()) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            cols = step(batch)
            arrays = [c if isinstance(c := cols[n], pa.Array | pa.ChunkedArray) else pa.array(c, t) for n, t in zip(names, types, strict=True)]
            yield from pa.table(dict(zip(names, arrays, strict=True))).to_batches()
        del step
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """At a task's end: a Python worker lives as long as its executor, and what it has freed goes back to the machine."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _arrow(kind: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
    if kind in plain:
        return plain[kind]
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(p.split(":", 1)[0], _arrow(p.split(":", 1)[1])) for p in _parts(kind[7:-1])])
    raise TypeError(kind)


def _parts(inner: str) -> list[str]:
    out, depth, begin = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(inner[begin:i])
            begin = i + 1
    return [*out, inner[begin:]]


class Bounded(dict):
    """A memo of `make(key)`. Beyond `most` new keys the older half goes, and longer keys than `longest` are not kept: it bounds
    memory and changes no result."""

    def __init__(self, make: Callable, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def temp_name(path: str) -> str:
    """Where an attempt writes before it renames: attempts of one task don't meet."""
    return f"{path}.{os.getpid()}-{uuid.uuid4().hex[:8]}.tmp"
