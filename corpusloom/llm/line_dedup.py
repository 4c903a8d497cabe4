"""Line deduplication by pairwise alignment.

1.  A text becomes the hashes and word counts of its lines that are not blank.  Equal
    texts are one from here on: the first document keeps it, later ones lose all of it
    (if it has ``min_words`` words).
2.  Overlapping documents are found through shared rare lines.  Of every shortest run of
    lines with ``min_words`` words the line with the least hash is posted, so two texts
    with a common block of so many words post a line in common.  A line posted by at most
    :data:`RARE` texts pairs them all.  Frequent lines pair no one by themselves, as their
    pairs would grow with the square of their texts; the runs they were posted for do
    instead, each later text with the first one that has the run.  Nothing is left out.
3.  Each pair is aligned by patience diff, :func:`aligned`: common heads and tails,
    lines that are unique on both sides, their longest increasing chain, and so on
    between its links.
4.  Common blocks of the alignment that have ``min_words`` words are deleted from the
    later document.  What crosses the alignment stays (unless another document's alignment
    holds it), as does a second occurrence that the earlier document has only once.

Order is that of (doc_id, hash of the text), so of equal blocks the earliest stays.
A block goes with the blank lines within it.  Edge cases: null texts stay null and empty
texts empty; rows with a null doc_id are neither changed nor compared; exact copies of a
row share all its decisions; very long texts are cut nowhere, though alignment goes
:data:`DEPTH` levels deep only; an empty table gives no rows; all other columns pass
unchanged, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drop_table, free_name, short_batches, split_join, tidy, write_table

MIN_WORDS = 50
#: A line in more texts than this is frequent.
RARE = 8
#: Levels of an alignment: ranges between the links of a chain are aligned again, so often.
DEPTH = 16


# One text ------------------------------------------------------------------------------


def signature(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word counts of the lines that are not blank; equal lines have equal hashes after trimming."""
    import xxhash

    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    hashes = np.array([xxhash.xxh64_intdigest(x.encode()) for x in lines], dtype=np.uint64)
    return hashes, np.array([len(x.split()) for x in lines], dtype=np.uint32)


def runs(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest runs with at least min_words words that start or end at each line."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if total[-1] < min_words:
        return []
    n = len(words)
    start = np.arange(n)
    end = np.searchsorted(total, total[:-1] + min_words, side="left")
    forward = zip(start[end <= n].tolist(), end[end <= n].tolist(), strict=True)
    begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    backward = zip(begin[begin >= 0].tolist(), (start[begin >= 0] + 1).tolist(), strict=True)
    return sorted({*forward, *backward})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def posted(hashes: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, bool]]:
    """(line, run, whether first with this line) of the runs of a text: the least line hash of a run, and the run's own hash."""
    import xxhash

    listed, raw, seen, out = hashes.tolist(), hashes.tobytes(), set(), {}
    for a, b in runs(words, min_words):
        out.setdefault((min(listed[a:b]), xxhash.xxh64_intdigest(raw[8 * a : 8 * b])))
    rows = []
    for line, run in out:
        rows.append((_signed(line), _signed(run), line not in seen))
        seen.add(line)
    return rows


# Two texts -----------------------------------------------------------------------------


def _chain(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of anchors, given in order of their first side, that increases on the second (patience sorting)."""
    tails, piles, back = [], [], []
    for k, (_, j) in enumerate(anchors):
        at = bisect_left(tails, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            piles.append(k)
        else:
            tails[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(anchors[k])
        k = back[k]
    return out[::-1]


def _once(lines: list[int], lo: int, hi: int) -> dict[int, int]:
    """Lines that occur once in a range, with their place."""
    at: dict[int, int] = {}
    for i in range(lo, hi):
        at[lines[i]] = -1 if lines[i] in at else i
    return {x: i for x, i in at.items() if i >= 0}


def _numbered(lines: list[int], lo: int, hi: int) -> dict[tuple[int, int], int]:
    """Lines of a range told apart by how often they occurred before, with their place."""
    count: dict[int, int] = {}
    out = {}
    for i in range(lo, hi):
        k = count[lines[i]] = count.get(lines[i], -1) + 1
        out[lines[i], k] = i
    return out


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (first in a, first in b, lines) of the patience diff of two lists of lines, in order.

    Where no line is unique on both sides, equal lines are taken in turn.
    """
    matches, left = [], [(0, len(a), 0, len(b), 0)]
    while left:
        i, m, j, n, depth = left.pop()
        while i < m and j < n and a[i] == b[j]:
            matches.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            matches.append((m, n))
        if i == m or j == n or depth == DEPTH:
            continue
        mine, other = _once(a, i, m), _once(b, j, n)
        anchors = [(x, other[line]) for line, x in mine.items() if line in other]
        if not anchors:
            mine, other = _numbered(a, i, m), _numbered(b, j, n)
            anchors = [(x, other[key]) for key, x in mine.items() if key in other]
        if not anchors:
            continue
        chain = _chain(sorted(anchors))
        matches += chain
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)], strict=True):
            if x + 1 < x2 and y + 1 < y2:
                left.append((x + 1, x2, y + 1, y2, depth + 1))
    blocks: list[list[int]] = []
    for i, j in sorted(matches):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [(i, j, n) for i, j, n in blocks]


def kept(text: str, cut: list[tuple[int, int]]) -> str:
    """A text without stretches (first, lines) of its lines that are not blank; lines = -1 takes all."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    gone = bytearray(len(lines))
    for first, n in cut:
        if n < 0:
            return ""
        lo, hi = full[first], full[first + n - 1] + 1
        gone[lo:hi] = b"\x01" * (hi - lo)
    rest = [x for x, g in zip(lines, gone, strict=True) if not g]
    return "\n".join(rest) if any(x.strip() for x in rest) else ""


# Tables --------------------------------------------------------------------------------

_NODE = "doc_id long, t0 long, t1 long"


def _signatures(min_words: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keep, hashes, words = [], [], []
            for i, text in enumerate(batch.column("text")):
                h, w = signature(text.as_py())
                if w.sum(dtype=np.int64) >= min_words:
                    keep.append(i)
                    hashes.append(h.tobytes())
                    words.append(w.tobytes())
            at = pa.array(keep, type=pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "t0", "t1")), pa.array(hashes, type=pa.binary()), pa.array(words, type=pa.binary())], names=["doc_id", "t0", "t1", "lines", "words"])

    return run


def _posted(min_words: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            at, rows = [], []
            for i, (h, w) in enumerate(zip(batch.column("lines").to_pylist(), batch.column("words").to_pylist(), strict=True)):
                own = posted(np.frombuffer(h, dtype=np.uint64), np.frombuffer(w, dtype=np.uint32), min_words)
                rows += own
                at += [i] * len(own)
            where = pa.array(at, type=pa.int32())
            columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("doc_id").take(where), batch.column("t0").take(where)], names=["line", "run", "first", "doc_id", "t0"])

    return run


def _aligned(min_words: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            at, first, lines, other = [], [], [], []
            for i, (a, w, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lines", "words", "other_lines")), strict=True)):
                words = np.frombuffer(w, dtype=np.uint32)
                for x, y, n in aligned(np.frombuffer(a, dtype=np.uint64).tolist(), np.frombuffer(b, dtype=np.uint64).tolist()):
                    if words[x : x + n].sum(dtype=np.int64) >= min_words:
                        at.append(i)
                        first.append(x)
                        lines.append(n)
                        other.append(y)
            where = pa.array(at, type=pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in ("doc_id", "t0", "other_id")), *(pa.array(x, type=pa.int32()) for x in (first, lines, other))], names=["doc_id", "t0", "other_id", "first", "lines", "other_first"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, text."""
    named = docs.where("doc_id is not null and text is not null")
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), "text").alias("t1"), "text")


def pairs(nodes: DataFrame, min_words: int, rare: int = RARE) -> tuple[DataFrame, list[str]]:
    """Overlapping texts of ``nodes``: (doc_id, t0) of the later one, (other_id, other_t0) of the earlier; and the tables below them."""
    # read by the count and by the join: written, so that texts are posted once
    rows, rows_at = write_table(nodes.mapInArrow(tidy(_posted(min_words)), "line long, run long, first boolean, doc_id long, t0 long"), "posted-lines")
    often, often_at = write_table(rows.groupBy("line").agg(F.count_if("first").alias("n"), F.count("*").alias("rows")).where("n > 1"), "often")
    shared, shared_at = write_table(split_join(rows, often, "line", "doc_id", "rows", rows.count()).drop("rows"), "shared-lines")
    # at most `rare` texts of a line are gathered
    few = shared.where((F.col("n") <= rare) & F.col("first")).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("doc_id", "t0"))).alias("own"))
    few = few.select("own", F.posexplode("own").alias("at", "one")).where("at > 0").select("one", F.explode(F.slice("own", F.lit(1), F.col("at"))).alias("other"))
    many = shared.where(F.col("n") > rare).select("run", F.struct("doc_id", "t0").alias("one"))
    owners = many.groupBy("run").agg(F.min("one").alias("other"), F.max("one").alias("last"), F.count("*").alias("rows")).where("other < last").select("run", "other", "rows")
    owners, owners_at = write_table(owners, "owners")
    many = split_join(many, owners, "run", "one", "rows", shared.count()).where("one > other").select("one", "other")
    found = few.unionAll(many).select("one.doc_id", "one.t0", F.col("other.doc_id").alias("other_id"), F.col("other.t0").alias("other_t0"))
    return found.distinct(), [rows_at, often_at, shared_at, owners_at]


def blocks(nodes: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> tuple[DataFrame, list[str]]:
    """Aligned common blocks of distinct texts: doc_id, t0, other_id, first, lines, other_first (in lines that are not blank); and the tables below them."""
    mine = nodes.select("doc_id", "t0", "lines", "words")
    other = nodes.select(F.col("doc_id").alias("other_id"), F.col("t0").alias("other_t0"), F.col("lines").alias("other_lines"))
    near, paths = pairs(nodes, min_words, rare)
    found = near.join(other, ["other_id", "other_t0"]).join(mine, ["doc_id", "t0"])
    found = found.select("doc_id", "t0", "other_id", "lines", "words", "other_lines").mapInArrow(tidy(_aligned(min_words)), "doc_id long, t0 long, other_id long, first int, lines int, other_first int")
    return found, paths


def cuts(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(doc_id, t0, cut): stretches of lines to delete, by document and hash of its text; a written table."""
    short_batches(docs.sparkSession)
    signed, signed_at = write_table(_texts(docs).mapInArrow(tidy(_signatures(min_words)), f"{_NODE}, lines binary, words binary"), "line-signatures")
    firsts = signed.groupBy("t0", "t1").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.any_value("lines").alias("lines"), F.any_value("words").alias("words"))
    nodes, nodes_at = write_table(firsts, "distinct-texts")
    common, paths = blocks(nodes, min_words, rare)
    own = common.groupBy("doc_id", "t0").agg(F.collect_set(F.struct("first", "lines")).alias("cut"))
    copied = nodes.where("last > doc_id").select("t0", "t1", F.col("doc_id").alias("_of"))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("lines")))
    copies = signed.select("doc_id", "t0", "t1").join(copied, ["t0", "t1"]).where("doc_id > _of").select("doc_id", "t0").distinct().withColumn("cut", whole)
    out, _ = write_table(own.unionAll(copies), "cuts")
    for path in (signed_at, nodes_at, *paths):
        drop_table(docs.sparkSession, path)
    return out


def _delete(text: pd.Series, first: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else kept(t, list(zip(a, n, strict=True))) for t, a, n in zip(text, first, lines, strict=True)], dtype=object)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, whole: str | None = None, rare: int = RARE) -> DataFrame:
    """The columns of ``docs``, with texts cut; then, if named, ``whole``: the text before."""
    of, t0, cut = (free_name(x, docs) for x in ("_of", "_t0", "_cut"))
    found = cuts(docs.select("doc_id", "text"), min_words, rare).select(F.col("doc_id").alias(of), F.col("t0").alias(t0), F.array_sort("cut").alias(cut))
    # never sent whole to all tasks, as it grows with the table: a hash table of each partition's cuts, and texts need no sort
    joined = docs.join(found.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(of)) & (F.xxhash64("text") == F.col(t0)), "left")
    # only texts with cuts go to Python
    touched = F.pandas_udf(_delete, "string")(F.when(F.col(cut).isNotNull(), F.col("text")), F.col(cut)["first"], F.col(cut)["lines"])
    rest = F.when(F.col(cut).isNull(), F.col("text")).otherwise(touched)
    columns = [rest.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([F.col("text").alias(whole)] if whole else []))
