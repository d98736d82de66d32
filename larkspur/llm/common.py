"""Shared folder, staged tables and Arrow helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"

#: Keys with more than this share of the rows, which are at most as many as its inverse, are joined by broadcast.
HOT_SHARE = 1 / 1000

#: (application, path, weak reference) of the tables that `release` may delete.
_held: list[tuple] = []

_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staged tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local master gets a folder of its own where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))
        _delete_at_exit(spark, sc.getCheckpointDir())
    return named or sc.getCheckpointDir()


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete path when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors.

    The table lasts until the `staging` around it ends or else until the application does, or until
    `release` finds that nothing is left that was made of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/larkspur-{label}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    plan = out._jdf.queryExecution().analyzed()
    if scope is None and plan.getClass().getSimpleName() == "LogicalRelation":  # every DataFrame made of the table leads to this object
        _held.append((spark.sparkContext.applicationId, path, spark._jvm.java.lang.ref.WeakReference(plan.relation().location())))
    return out


def release(spark: SparkSession) -> None:
    """Delete the staged tables, outside of `staging`, that no DataFrame of this application leads to any more."""
    mine = [x for x in _held if x[0] == spark.sparkContext.applicationId]
    if mine:
        gc.collect()
        spark._jvm.System.gc()
    gone = [x for x in mine if x[2].get() is None]
    for _, path, _ in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _held[:] = [x for x in mine if x not in gone]


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: what is made of them must be written by then."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, mine):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(big: DataFrame, small: DataFrame, key: str, rows: str, *, total: int | None = None, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """big with the columns of small, which has one row for each key; small's column `rows` counts the rows of big with that key.

    Keys that hold more than `share` of the rows would each fill one task. They are at most
    1 / share, so their rows of small are broadcast; the other keys are shuffled. Null keys match
    nothing and, with how="left", stay where they are. Pass staged or checkpointed tables: both are read
    more than once. The column `rows` is dropped.
    """
    if total is None:
        total = small.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(small.where(F.col(rows) > total * share).drop(rows))
    rest = big.where(F.col(f"`{key}`").isNotNull()).join(hot.select(key), key, "left_anti").join(small.where(F.col(rows) <= total * share).drop(rows), key, how)
    out = big.join(hot, key).unionByName(rest)
    if how == "left":
        out = out.unionByName(big.where(F.col(f"`{key}`").isNull()), allowMissingColumns=True)
    return out


def fresh(names: list[str], wanted: str) -> str:
    """A column name that does not clash, without regard to case, with names."""
    taken = {n.lower() for n in names}
    return next(n for n in itertools.chain([wanted], (f"{wanted}_{i}" for i in itertools.count(1))) if n.lower() not in taken)


def with_added(df: DataFrame, fields: list[T.StructField], text_col: str, fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df plus fields that fn computes from the text column, Arrow batch by Arrow batch.

    Columns of df that have a field's name are replaced. Rows that share a batch do not
    influence each other's values; fn gets the whole texts.
    """
    new = {f.name.lower() for f in fields}
    keep = [n for n in df.columns if n.lower() not in new]
    columns = [*keep, *([] if text_col in keep else [text_col])]
    schema = T.StructType([*(df.schema[n] for n in keep), *fields])
    at, width = columns.index(text_col), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [*b.columns[:width], *fn(b.column(at))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if not pa.types.is_null(column.type) else [None] * len(column)


def slices(texts: list, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes of text together; a longer text is a run of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, mod 5 (null: of the empty text)."""
    return F.expr(f"crc32(cast(coalesce(cast(`{doc_id}` as string), '') as binary)) % 5")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def array_of(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)
