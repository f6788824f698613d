"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "plantpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings are left to the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that change results: instants are UTC, and a repeated JSON key means the last one."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; only a local session without one gets its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        named = os.path.join(tempfile.mkdtemp(prefix="plantpulse-"), "checkpoints")
    sc.setCheckpointDir(named)
    return named


def pin(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared checkpoint folder and continue from the written table.

    Used where a plan reads the very same rows more than once (partition ids, loop rounds, decoded records): the
    files survive the loss of an executor, later readers take only the columns they need, and the sizes known from
    the files let Spark choose its joins.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Tables pinned inside are removed at the end, unless the given function is told of a result that reads them.

    For steps that end with a written result: nothing that leaves may still have to read another table.
    """
    made: list[str] = []
    kept: set[str] = set()
    token = _scopes.set((*_scopes.get(), made))

    def keep(df: DataFrame) -> DataFrame:
        kept.update(path for path in made if any(os.path.basename(path) in f for f in df.inputFiles()))
        return df

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in made:
            if path not in kept:
                remove_folder(spark, path)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.delete(where, True)


def written_numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders `name=n` under a path whose write has ended, in rising order."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return []
    names = [entry.getPath() for entry in fs.listStatus(where)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    ended = [p.getName() for p in names if p.getName().startswith(f"{name}=") and fs.exists(done(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in ended)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Spark moves a filter below the projections it refers to and copies their expressions into it; for a JSON
    decode or a long CASE that repeats the work. A generated row is not looked through.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
