"""Approximate nearest neighbours by a permutation index.

Pivots are drawn from a bounded sample.  A vector is represented by its permutation,
the pivots in order of their cosine with it, and is posted in the inverted files of its
nearest pivots.  A query reads the files of its own nearest pivots (more than a vector is
posted in), ranks what it finds there by the footrule distance of the permutations, and
the nearest share of every stretch of a file is ranked again by the exact cosine of the
original vectors, in double precision; rows at the same distance are ranked again
together or not at all, so no order of rows decides.  Of equal vectors only
the ``k + 1`` smallest vec_ids are posted, in one stretch: no others can be among the best.

Files are read in stretches: a pivot's file is dealt out over as many salts as its
length asks for, and its queries likewise over blocks; each block of queries meets each
stretch in a task of its own, so no task holds a whole file or all its queries, however
hot its pivot.  A pair that meets in several files is ranked only in the
first file that both have in common.  The best ``k`` of every stretch are reduced to
the best ``k`` of the query by a window whose limit works in each task first, so what
is shuffled for a query does not grow with the number of stretches.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part (nor do those whose length differs from the most frequent one); rows with
a null vec_id neither; rows repeated under one vec_id count once if equal, and the best
of them counts if not; ties go to the smaller vec_id; with fewer candidates than ``k``
all are returned; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import drawn, write_table


@dataclass(frozen=True)
class Params:
    """pivots and sample: bound of the fit; posted: files a vector is in; read: files a query reads; footrule: nearest pivots whose places count; again: share of a stretch that is ranked again (at least ``least``); stretch: rows of a file in one task; asked: queries of a file in one task; block: queries ranked at a time."""

    pivots: int = 128
    sample: int = 4096
    posted: int = 8
    read: int = 16
    footrule: int = 128
    again: float = 0.1
    least: int = 24
    stretch: int = 20_000
    asked: int = 20_000
    block: int = 64


DEFAULT = Params()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, embedding array<double>) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("embedding", lambda x: x != 0))
    return rows.distinct()


def smallest(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors those with the ``k + 1`` smallest vec_ids (one may be the query itself)."""
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).drop("_nth")


def fit(rows: DataFrame, params: Params = DEFAULT) -> np.ndarray:
    """Pivots: unit vectors far apart, taken greedily from a sample drawn by a hash of vec_id."""
    found = drawn(rows, params.sample, "vec_id", "embedding").collect()
    if not found:
        return np.empty((0, 0))
    sizes = [len(r[1]) for r in found]
    width = max(set(sizes), key=lambda n: (sizes.count(n), n))
    x = _unit(np.array([r[1] for r in found if len(r[1]) == width]))
    x = np.unique(x.round(12), axis=0)
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(params.pivots, len(x)):
        nxt = int(near.argmin())
        picked.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    return x[picked]


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # no square runs out of range
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def permutation(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivot numbers from near to far, for each row of unit vectors."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")


def places(perm: np.ndarray, most: int) -> np.ndarray:
    """Where each pivot stands; ``most`` for those further down."""
    out = np.full(perm.shape, most, dtype=np.int16)
    np.put_along_axis(out, perm[:, :most], np.arange(min(most, perm.shape[1]), dtype=np.int16)[None, :].repeat(len(perm), 0), 1)
    return out


def _post(pivots: np.ndarray, files: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings (file, vec_id, embedding) of vectors or queries in the files of their nearest pivots."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("embedding").to_pylist()
            keep = np.array([len(v) == pivots.shape[1] for v in lists], dtype=bool)
            where = np.flatnonzero(keep)
            if not len(where):
                continue
            x = np.array([lists[i] for i in where])
            perm = permutation(_unit(x), pivots)[:, :files]
            row = np.repeat(np.arange(len(where)), perm.shape[1])
            file = perm.ravel().astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(ids[where[row]]), batch.column("embedding").take(pa.array(where[row]))], names=["file", "vec_id", "embedding"])

    return run


_FOUND = "query_id long, vec_id long, score double"


def _rank(pivots: np.ndarray, k: int, params: Params) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, queries: pd.DataFrame, stretch: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(stretch):
            return pd.DataFrame({"query_id": np.empty(0, dtype=np.int64), "vec_id": np.empty(0, dtype=np.int64), "score": np.empty(0)})
        file = int(key[0])
        v_raw, v_id = np.array(stretch["embedding"].tolist()), stretch["vec_id"].to_numpy()
        v = _unit(v_raw)
        v_perm = permutation(v, pivots)
        v_place, v_posted = places(v_perm, params.footrule), np.zeros((len(v), len(pivots)), dtype=bool)
        np.put_along_axis(v_posted, v_perm[:, : params.posted], True, 1)
        out: list[tuple[int, int, float]] = []
        for at in range(0, len(queries), params.block):
            part = queries.iloc[at : at + params.block]
            q_raw, q_id = np.array(part["embedding"].tolist()), part["vec_id"].to_numpy()
            q = _unit(q_raw)
            q_perm = permutation(q, pivots)
            q_place = places(q_perm, params.footrule)
            for i in range(len(part)):
                # met before: in a file with a smaller number that one is posted in and the other reads
                earlier = q_perm[i, : params.read]
                earlier = earlier[earlier < file]
                own = ~v_posted[:, earlier].any(1) & (v_id != q_id[i])
                c = np.flatnonzero(own)
                if not len(c):
                    continue
                most = max(params.least, int(np.ceil(params.again * len(c))))
                if len(c) > most:
                    foot = np.abs(v_place[c] - q_place[i]).sum(1, dtype=np.int32)
                    c = c[foot <= np.partition(foot, most - 1)[most - 1]]
                near = _cosine(q_raw[i], v_raw[c])
                order = np.lexsort((v_id[c], -near))
                most = 4 * k
                while True:  # the best row of each vec_id, of as many rows as hold k of them
                    best = order[:most]
                    first = np.sort(np.unique(v_id[c[best]], return_index=True)[1])[:k]
                    if len(first) == k or most >= len(order):
                        break
                    most *= 4
                out += [(int(q_id[i]), int(v_id[c[b]]), float(near[b])) for b in best[first]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (v * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, params: Params = DEFAULT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query but itself."""
    spark = vectors.sparkSession
    # read for the pivots, for the lengths of files and for the postings
    rows, _ = write_table(smallest(usable(vectors), k), "vectors")
    pivots = fit(rows, params)
    out = "query_id long, rank int, vec_id long, score double"
    if not pivots.size:
        return spark.createDataFrame([], out)
    schema = "file int, vec_id long, embedding array<double>"
    posted, asked = rows.mapInArrow(_post(pivots, params.posted), schema), usable(queries).mapInArrow(_post(pivots, params.read), schema)

    def dealt(postings: DataFrame, most: int) -> Column:
        """Parts of each file; one count for each pivot reaches the driver."""
        counts = {int(r[0]): int(r[1]) for r in postings.groupBy("file").count().collect()}
        parts = F.create_map(*(F.lit(x) for f in range(len(pivots)) for x in (f, max(1, -(-counts.get(f, 0) // most)))))
        return parts[F.col("file")]

    salts, blocks = dealt(posted, params.stretch), dealt(asked, params.asked)
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    posted = posted.withColumn("salt", F.pmod(F.xxhash64("embedding"), salts).cast("int")).withColumn("asked", everywhere(blocks))
    asked = asked.withColumn("asked", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("salt", everywhere(salts))
    key = ("file", "salt", "asked")
    found = asked.groupBy(*key).cogroup(posted.groupBy(*key)).applyInPandas(_rank(pivots, k, params), _FOUND)
    # the best score of a vec_id first, then the best k: in each task, then of the query
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
