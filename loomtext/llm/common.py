"""Shared folders, tables written between jobs, and the training split by crc32."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them, for JVM expressions.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a temporary folder is made, in local mode only: on a cluster a
    machine-local folder would lose rows, so the setting is demanded there.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(spark, "_loomtext_scratch", None) or tempfile.mkdtemp(prefix="loomtext-")
        spark._loomtext_scratch = at
    return at.rstrip("/")


class Scratch:
    """Tables written once into the shared folder; reading them back has no lineage but the files.

    A lost executor costs a reread, not a recomputation. ``drop`` removes tables that no later step
    reads; what is left goes when the driver's JVM ends, as results may still be read from it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/loomtext-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        path, system = self._open(self.at)
        system.deleteOnExit(path)

    def _open(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, name: str, df: DataFrame, large: bool = False) -> DataFrame:
        """``large``: whole texts were shuffled for it, and the next step should not begin beside them."""
        path = f"{self.at}/{name}"
        df.write.parquet(path)
        self.paths[name] = path
        schema = df.schema
        del df
        # Spark removes a plan's shuffle files once the plan is collected as garbage, some time after. Between
        # jobs that follow at once nothing is, and all their files are on disk together; hence the wait.
        for _ in range(2 if large else 1):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.8 if large else 0)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, system = self._open(self.paths.pop(name))
            system.delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: how finely the cluster's owner wants data dealt."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def need(df: DataFrame, **types: str) -> DataFrame:
    """Just these columns, cast; a column that is missing is null. Others stay out of the way."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(c) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def least_hashed(ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` distinct doc_ids of least hash. A bound on the hash, from the count of rows, leaves about
    twice as many before they are put in order; where it leaves too few, all are."""
    rows = ids.count()
    if rows > 4 * most:
        near = ids.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= int(2.0**63 * 2 * most / rows))
        if near.count() >= most:
            ids = near
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
