"""What the training-data operators share: the shared folder, written intermediate tables, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: [\x20\x09-\x0D]; ``bytes.split()`` and ``bytes.strip()`` use the same set.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary one (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliolake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliolake_path = path
    return out


def slices(batches, rows: int = 1000):
    """Record batches of at most ``rows`` rows: what a worker makes of texts stays small whatever Spark's batches hold."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def forget(df: DataFrame) -> None:
    """Deletes the files behind a ``written`` table that nothing reads any more."""
    path = getattr(df, "_foliolake_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def rested(spark: SparkSession) -> None:
    """Lets executors collect their garbage and give the heap that this frees back to the system: a JVM keeps what the greatest stage took, and the Python workers
    of the next one need room beside it. Twice as many short tasks as there are cores, so that each executor gets some."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def held_out(id_col: str, modulus: int, rest: int):
    """crc32 of the id written as text, modulo ``modulus``, equals ``rest``."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus) == rest


def label_of(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One 0/1 label for each id: the mean of its non-null labels, at least 0.5; ids without one are left out."""
    known = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull())
    return known.groupBy(id_col).agg((F.avg(column) >= 0.5).cast("int").alias("y"))


#: In a Python worker: how to empty what each operator remembers, and which one ran last.
_memories: dict = {}
_last: list = [None]


def remembers(name: str, clear) -> None:
    _memories[name] = clear


def entered(name: str) -> None:
    """Workers outlive stages: empties what other operators remember when one starts."""
    if _last[0] != name:
        for other, clear in _memories.items():
            if other != name:
                clear()
        _last[0] = name
        _release()


def _release() -> None:
    """Gives what a worker has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
