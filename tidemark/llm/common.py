"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship

#: ASCII white space, the only word separator of the word operators.
ASCII_SPACE = r"[\x20\x09-\x0D]"


#: Bytes of a batch that goes to a Python worker, where the session keeps Spark's default of 64 MB.
BATCH, DEFAULT_BATCH = "16m", 1 << 26


def prepare(spark: SparkSession) -> None:
    """Ships the package and keeps batches small, as a batch of whole texts is held several times over."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(DEFAULT_BATCH):
        spark.conf.set(key, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset."""
    prepare(spark)
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most rows of ids and hashes that are broadcast (about 100 MB in an executor); longer lists are joined by a shuffle.
FEW = 4_000_000


def counted(ids: DataFrame) -> DataFrame:
    """``ids`` materialised, with a broadcast hint if their count allows it."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def beside(rows: DataFrame, key: str, stats: dict, wanted: str) -> DataFrame:
    """``rows`` whose key's aggregates ``stats`` meet ``wanted``, with these.

    The aggregates are summed before their shuffle and written, so both sides of the join are plain
    exchanges: a key of any size is split by adaptive execution, and none meets in one task.  ``rows``
    is read twice and should stand on a written table.
    """
    folder = run_folder(rows.sparkSession, "stats")
    made = rows.groupBy(key).agg(*[v.alias(k) for k, v in stats.items()]).where(wanted)
    made.write.parquet(folder)
    return rows.join(rows.sparkSession.read.schema(made.schema).parquet(folder), key)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and hash of the text are not in ``gone`` (doc_id, text_key)."""
    doc, key = unused(docs.columns, "gone_id", "gone_key")
    listed = counted(gone.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct())
    return docs.join(listed, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def run_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def release() -> None:
    """At the end of a task gives what it has freed back to the system, as the worker lives on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
