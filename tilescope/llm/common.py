"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
#: Rows of an Arrow batch; Spark bounds its bytes as well, so that a batch of long texts stays small.
BATCH_ROWS = 1000
#: Rows of one key that a task takes; more are dealt over several.
DEAL = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset and Spark runs in one process (tests), a temporary folder
    is made and set; on a cluster an unset folder is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tilescope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The scratch folders that are open, the innermost last.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted in the end; what is said to be ``last`` with the scratch around this one, if any."""
    root = f"{shared_dir(spark)}/tilescope/scratch-{uuid.uuid4().hex}"
    token = _scratch.set((*_scratch.get(), root))
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, last: bool = False, texts: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage,
    so that a lost executor costs one stage and not the whole history.

    texts: whether whole texts are in it, which are worth a slower codec.
    """
    roots = _scratch.get()[:-1] if last else _scratch.get()
    root = roots[-1] if roots else f"{shared_dir(df.sparkSession)}/tilescope"
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if texts else None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of a batch that goes to Python (texts may be long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def join_dealt(many: DataFrame, one: DataFrame, key: str, rows: str, spread: list[str]) -> DataFrame:
    """``many`` joined with ``one``, which has one row a key and tells in ``rows`` how many of ``many`` have it.

    Keys with over ``DEAL`` rows are dealt over several tasks, by a hash of ``spread``, and meet a copy of
    their row in each.  ``one`` is read twice: hand in a materialised table.  There is one such key for
    every ``DEAL`` rows of ``many`` at most; whether their list is broadcast is left to Spark's size check.
    """
    hot = one.where(F.col(rows) > DEAL)
    if not hot.limit(1).count():
        return many.join(one, key)
    parts = F.ceil(F.col(rows) / DEAL)
    hot = materialize(hot.select(F.col(key).alias("_ts_hot"), parts.cast("int").alias("_ts_parts")), "hot-keys")
    dealt = many.join(hot, F.col(key) == F.col("_ts_hot"), "left")
    dealt = dealt.withColumn("_ts_part", F.pmod(F.xxhash64(*spread), F.coalesce("_ts_parts", F.lit(1))).cast("int")).drop("_ts_hot", "_ts_parts")
    copies = one.withColumn("_ts_part", F.explode(F.sequence(F.lit(0), F.greatest(parts.cast("int"), F.lit(1)) - 1)))
    return dealt.join(copies, [key, "_ts_part"]).drop("_ts_part")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` over slices of a few rows; ``make`` builds a worker's state once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, rows):
            out = work(part)
            if out.num_rows:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from a partition that is sorted by ``keys``; no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(table.num_rows, dtype=bool)
        for c in keys:
            column = table.column(c).to_numpy()
            same &= column == column[-1]
        whole = table.num_rows - int(same.sum())
        if whole:
            yield table.slice(0, whole)
        held = table.slice(whole).to_batches()
    if held:
        yield pa.Table.from_batches(held)
