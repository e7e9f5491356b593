"""Helpers that the operators share: tables, scratch tables on shared storage, folds, fixed-width hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies on the driver; on a cluster without a shared home use --py-files.

    Batches for them hold whole texts, so they get fewer rows than Spark's default, unless the session says otherwise.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1024")
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if top not in known:
        env["PYTHONPATH"] = os.pathsep.join([top, *filter(None, known)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may do without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    path = tempfile.mkdtemp(prefix="tw-", dir="/tmp/checkpoints")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_writers: Counter = Counter()
_before: dict[SparkSession, str] = {}
_writers_lock = threading.Lock()
_local = threading.local()


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEAN_UP holds until the last of the threads that write in this session is done; then what it was before."""
    with _writers_lock:
        if not _writers[spark]:
            _before[spark] = spark.conf.get(CLEAN_UP, "false")
            spark.conf.set(CLEAN_UP, "true")
        _writers[spark] += 1
    try:
        yield
    finally:
        with _writers_lock:
            _writers[spark] -= 1
            if not _writers[spark]:
                spark.conf.set(CLEAN_UP, _before.pop(spark))
                del _writers[spark]


def scratch(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: lineage is cut and no lost executor makes it run again.

    What was shuffled for it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _cleaning(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if getattr(_local, "tables", None) is not None:
        _local.tables.append(out)
    return out


@contextlib.contextmanager
def cleared() -> Iterator[Callable[[DataFrame], None]]:
    """Tables that `scratch` writes inside go at the end, but for those that are handed to what this gives."""
    outer, kept = getattr(_local, "tables", None), []
    _local.tables = own = []
    try:
        yield kept.append
    finally:
        _local.tables = outer
        for t in own:
            if all(t is not k for k in kept):
                drop(t)
            elif outer is not None:
                outer.append(t)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that `scratch` gave, once nothing that is still to run reads it."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def text_key(text: Column) -> Column:
    """256-bit identity of a text; a null text is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def components(edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node that each endpoint of ``edges`` reaches. Isolated nodes don't appear.

    Alternates hooking each root to the smallest neighbouring root with pointer jumping, so rounds grow with the
    logarithm of the longest path; edges inside a finished component are dropped each round, and every round is a
    written table. Only a count comes back to the driver.
    """
    live = scratch(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), f"{name}-edges")
    labels = scratch(live.select("u").union(live.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("root")), f"{name}-nodes")
    while not live.isEmpty():
        both = live.union(live.select("v", "u"))
        hook = scratch(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("to")), f"{name}-hook")
        # jump until every root points at a root
        moved = True
        while moved:
            nxt = hook.alias("x").join(hook.select(F.col("u").alias("to"), F.col("to").alias("to2")), "to").select("u", F.col("to2").alias("to"), (F.col("to2") != F.col("to")).alias("moved"))
            nxt, old = scratch(nxt, f"{name}-jump"), hook
            moved = not nxt.where("moved").isEmpty()
            hook = nxt.drop("moved")
            hook.scratch_path = nxt.scratch_path
            drop(old)
        old = labels
        labels = scratch(labels.join(hook.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-nodes")
        drop(old)
        old = live
        live = live.join(hook.select(F.col("u"), F.col("to").alias("tu")), "u").join(hook.select(F.col("u").alias("v"), F.col("to").alias("tv")), "v")
        live = scratch(live.where("tu <> tv").select(F.col("tu").alias("u"), F.col("tv").alias("v")).distinct(), f"{name}-edges")
        drop(old)
        drop(hook)
    drop(live)
    return labels
