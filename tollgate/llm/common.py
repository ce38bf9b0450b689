"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table_path


def by_value(module_name: str) -> None:
    """Ship the functions of a module with the job, so that executors need
    no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)

HIDDEN = "__tollgate_locator"
LOCATOR = "struct<file: string, row: long>"


def worker_store(name: str) -> dict:
    """A dict that lives in the Python worker process until another store is
    asked for, so tables built by one task serve the next tasks of the same
    worker, and a worker holds the tables of one operator at a time."""
    m = sys.modules.setdefault("_tollgate_worker_store", types.ModuleType("_tollgate_worker_store"))
    if getattr(m, "held", None) != name:
        m.held, m.store = name, {}
    return m.store


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder that
    ``spark.checkpoint.dir`` names and read it back, so a lost executor costs
    one task and not everything before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(parts)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def thinned(df: DataFrame, rows: int, seed: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df``, each drawn by itself: the size holds
    whatever keys repeat, and no task sends more than its share."""
    total = df.count() if total is None else total
    return df.filter(F.rand(seed) < F.lit(min(1.0, rows / max(1, total))))


def thinned_keys(keys: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of a table of distinct keys, drawn by the hash of
    the key: the same ones however a shuffle orders the rows."""
    share, cells = min(1.0, rows / max(1, keys.count())), 1 << 30
    return keys.filter(F.pmod(F.xxhash64(*keys.columns, F.lit(seed)), F.lit(cells)) < F.lit(int(share * cells)))


#: Bytes of an Arrow batch of text. A batch is held by the executor and by its
#: Python worker at once, and again as Python strings.
BATCH_BYTES = 8 << 20


def map_text(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema,
             rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so few texts are
    Python strings at a time. The session's Arrow batches are made as small,
    in rows and, for long texts, in bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(2 * rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it reads a stored table, else written to one."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return written(docs, "stored-rows")
    return docs


def locator(docs: DataFrame) -> Column:
    """File and row number: the same at every read, however it is split."""
    meta = docs.metadataColumn("_metadata")
    return F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def keep_rows(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose place is in the ``locator`` column of
    ``stays``, all columns. Places are unique, so the join spreads evenly."""
    places = stays.select(F.col("locator").alias(HIDDEN))
    return docs.withColumn(HIDDEN, locator(docs)).join(places, HIDDEN, "left_semi").select(*[docs[c] for c in docs.columns])


#: Keys with more than one in HOT_SHARE of all rows are joined by themselves.
HOT_SHARE = 1000


def keyed_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` (a stored table) joined to ``table``, which has one row a key
    and in ``count`` its number of ``rows``. Keys that hold over one in
    ``HOT_SHARE`` of all rows are fewer than ``HOT_SHARE`` at any input size:
    they are broadcast, so a hot key stays spread over the tasks that read it;
    the other keys are too small to fill a task."""
    total = table.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * F.lit(HOT_SHARE) > F.lit(total)
    hot, rest = table.filter(is_hot).drop(count), table.filter(~is_hot).drop(count)
    spread = rows.join(F.broadcast(hot), key)
    dealt = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return spread.unionByName(dealt)
