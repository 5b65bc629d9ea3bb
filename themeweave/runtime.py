"""Where intermediate tables live, and when a join side may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A join side is broadcast only when it is known to be no larger than this.
BROADCAST_ROWS = 1_000_000
BROADCAST_TEXT_BYTES = 64 * 1024 * 1024

#: How many ways a key is split when a side is too large to broadcast.
JOIN_SALTS = 32

_shipped_to: set[str] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, taken from ``spark.checkpoint.dir``.

    A throw-away folder is made only for a local session that names none. On a
    cluster executors cannot see each other's disks, so there it is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="themeweave-"))
    return context.getCheckpointDir()


def new_run_folder(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint root, for the tables of one fit."""
    return f"{checkpoint_root(spark).rstrip('/')}/themeweave-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and hand back the written table, cutting its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that a run has written and needs no more, wherever it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder, keeping partitions."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Use every core on an input that arrives in fewer pieces than there are cores.

    A large input already has many splits and is left alone, so this costs a
    shuffle only where the data is small. Asking for the number of pieces runs no
    job on a stored table; a computed input is best stored first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores, key)


def has_few_rows(table: DataFrame) -> bool:
    """True when a table of numbers is small enough to broadcast. Counting stops one row beyond the limit."""
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def fits_broadcast(table: DataFrame, key: str) -> bool:
    """True when both the rows of ``table`` and the bytes of its text key are few.

    Counting stops one row beyond the limit.
    """
    sizes = table.select(F.octet_length(key).alias("_bytes")).limit(BROADCAST_ROWS + 1)
    found = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("size")).first()
    return found.n <= BROADCAST_ROWS and found.size <= BROADCAST_TEXT_BYTES


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: Column,
    how: str = "inner",
) -> DataFrame:
    """Join a token-sized side to a per-term table.

    The table is broadcast when a count shows it fits. Otherwise both sides are
    shuffled on the term plus a salt taken from ``spread_by``, so that one very
    common term is shared by many tasks.
    """
    if fits_broadcast(table, key):
        return big.join(F.broadcast(table), key, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(JOIN_SALTS)))
    copies = table.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(JOIN_SALTS - 1).cast("long")))
    )
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def without_keys(big: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose key is not in the stored table ``keys``; ``big`` is not shuffled.

    The keys are broadcast, in pages of about ``BROADCAST_ROWS``, so no broadcast grows with the input.
    """
    pages = -(-keys.count() // BROADCAST_ROWS)
    page = F.pmod(F.xxhash64(key), F.lit(pages))
    for number in range(pages):
        big = big.join(F.broadcast(keys.where(page == number).select(key)), key, "left_anti")
    return big


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers of a session that was started without it.

    Spark's file server hands the archive to every executor. Not needed where the
    package is installed on the cluster or passed with ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="themeweave-package-")) / "themeweave.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped_to.add(context.applicationId)
