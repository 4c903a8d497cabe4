"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.scratch import drop_table, free_name, shared_dir, write_table

__all__ = ["drawn", "drop_table", "free_name", "give_back", "shared_dir", "short_batches", "size_of", "split_join", "table", "texts_of", "tidy", "write_table"]

#: Rows of an Arrow batch of whole texts, where the session leaves Spark's default.
BATCH_ROWS = 2000
#: Bytes of such a batch, likewise.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of whole texts; a session's own setting stays."""
    for name, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, str(value))


def size_of(rows: DataFrame) -> int:
    """Bytes of a table by Spark's own estimate from its files, 0 where it has none; nothing is run."""
    found = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 50 else 0


def give_back() -> None:
    """Gives memory that a worker no longer uses back to the system: workers serve later tasks of other kinds, too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such function in this system's library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and :func:`give_back` at its end."""

    def tidied(found: Iterator) -> Iterator:
        yield from run(found)
        give_back()

    return tidied


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


#: A hub is a key with more than HUB rows and more than one in HUBS of all: there are fewer than HUBS of them.
HUB, HUBS = 64, 1000


def split_join(many: DataFrame, few: DataFrame, key: str, by: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``many`` joined with the one row of ``few`` for each ``key`` (long); ``n`` of ``few`` is how many of the ``total`` rows of ``many`` have it.

    The rows of a hub are dealt out over salts by ``by``, and its row of ``few`` is sent to each.
    """
    salt, salts = free_name("_salt", many, few), free_name("_salts", many, few)
    most = max(HUB, total // HUBS)
    found = few.where(F.col(n) > most).select(key, n).collect() if total > most else []  # fewer than HUBS rows
    if not found:
        return many.join(few, key, how)
    hubs = F.broadcast(many.sparkSession.createDataFrame([(r[0], -(-r[1] // most)) for r in found], f"{key} long, {salts} int"))
    count = F.coalesce(salts, F.lit(1))
    dealt = many.join(hubs, key, "left").withColumn(salt, F.pmod(F.xxhash64(by), count).cast("int")).drop(salts)
    everywhere = few.join(hubs, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), count - 1))).drop(salts)
    return dealt.join(everywhere, [key, salt], how).drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """A bounded sample for a fit: the ``n`` rows with the least hash of ``by``.

    Repeated rows count once.  A count of the distinct hashes comes first, and only rows
    below the hash that some 2 * n of them fall under are sorted, so what the partitions send
    to the driver does not grow with their number, and a table of mostly equal rows still
    gives ``n`` different ones where it has them.
    """
    place = F.shiftrightunsigned(F.xxhash64(*by), 11)
    total = rows.agg(F.approx_count_distinct(place, 0.02)).first()[0]
    near = 2 * n + 100
    if total > near:
        rows = rows.where(place < float(1 << 53) * near / total)
    return rows.dropDuplicates(list(by)).orderBy(place, *by).limit(n)
