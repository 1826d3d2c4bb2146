"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: A side with at most this many narrow rows (ids or hashes) is broadcast; a
#: larger one is joined through a shuffle.  The count is taken before.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors, gives the optimizer real sizes."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table made by ``staged`` that no live frame reads any more."""
    path = getattr(df, "_staged_path", None)
    if path is None:
        return
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """Broadcast hint only below the bounds; the caller counted ``rows`` and,
    where they hold more than a few numbers, their ``size`` in bytes."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def prepare(spark: SparkSession) -> None:
    """Make the package importable on the workers, set the shared folder, and
    bound the bytes (not only the rows) that Python gets at a time."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    ensure_checkpoint_dir(spark)


def held_out(modulus: int, rest: int, col: str = "doc_id"):
    """Whether crc32 of the id as text leaves ``rest``; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus == rest, F.lit(False))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows if there are at most ``bound``, else the rows whose key hashes
    below bound / count: the same rows however the input is partitioned."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


_OWNER: list[str] = []
_CACHES: dict[str, list] = {}


def claim(owner: str, *caches) -> None:
    """Called in a task before an operator fills module-level caches: those of
    other operators that ran in the same Python worker are emptied first."""
    if _OWNER != [owner]:
        for name, held in _CACHES.items():
            if name != owner:
                for c in held:
                    c.clear()
        _OWNER[:] = [owner]
        import gc
        gc.collect()
    _CACHES[owner] = list(caches)
