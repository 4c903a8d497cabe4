"""Tokens to windows, padded rows, batches and shards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import lines, words
from corpusloom.scratch import free_name, write_table

PAD, IGNORE = 1, -100


def codepoints(text: Column) -> Column:
    """Character numbers, the stand-in ids of a corpus without tokenizer."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def line_tokens(docs: DataFrame, tokens=words) -> DataFrame:
    """(doc_id, line_no, tokens) of the lines that are not blank."""
    return lines(docs).select("doc_id", "line_no", tokens(F.col("line")).alias("tokens"))


def _ranged(rows: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, str]:
    """Rows in ranges of ``order``, written with the number of their range; and the name of that column."""
    part = free_name("_range", rows)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    return write_table(ranged, "ranges")[0], part


def _placed(ranged: DataFrame, part: str, order: tuple[str, ...], size: str) -> DataFrame:
    before, total = free_name("_before", ranged), free_name("_total", ranged)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(F.sum(size).alias(total))
    totals = totals.select(part, F.coalesce(F.sum(total).over(upto(Window.orderBy(part))), F.lit(0)).alias(before))
    within = F.coalesce(F.sum(size).over(upto(Window.partitionBy(part).orderBy(*order))), F.lit(0))
    placed = ranged.withColumn("offset", within).join(F.broadcast(totals), part)  # one row for each range
    return placed.withColumn("offset", F.col("offset") + F.col(before)).drop(part, before)


def offsets(rows: DataFrame, order: tuple[str, ...] = ("doc_id", "line_no"), size: str = "n") -> DataFrame:
    """Adds ``offset``: the sum of ``size`` over all rows before, in ``order`` (nulls first).

    Two-level prefix sum: rows are dealt out in ranges of ``order``, whatever its values;
    sums run within a range and over the ranges' totals (one row for each).  No task holds
    more than its range.
    """
    return _placed(*_ranged(rows, order), order, size)


def window_count(n: Column, length: int) -> Column:
    """Windows of ``length`` with stride ``length // 2`` over n tokens; the padded tail always exists."""
    stride = length // 2
    return F.when(n >= length, F.floor((n - length) / stride) + 2).when(n > 0, F.lit(1)).otherwise(F.lit(0))


def pack_windows(rows: DataFrame, length: int, pad: Column, tokens: str = "tokens") -> DataFrame:
    """(window, n, ids): overlapping windows over the tokens of (doc_id, line_no, tokens) laid end to end.

    Each line sends each window the stretch of tokens that falls into it, so windows
    gather a few stretches instead of single tokens.
    """
    stride = length // 2
    order = ("doc_id", "line_no")
    ranged, part = _ranged(rows.withColumn("n", F.size(tokens)), order)  # tokens are made once
    placed = _placed(ranged, part, order, "n")
    total = ranged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    placed = placed.where("n > 0").crossJoin(F.broadcast(total))  # one row
    last = window_count(F.col("total"), length) - 1
    lowest = F.greatest(F.lit(0), F.floor((F.col("offset") - length) / stride) + 1)
    highest = F.least(last, F.floor((F.col("offset") + F.col("n") - 1) / stride))
    cut = placed.withColumn("window", F.explode(F.sequence(lowest, F.greatest(lowest, highest)))).where(F.col("window") <= highest)
    start = F.greatest(F.lit(0), F.col("window") * stride - F.col("offset"))
    end = F.least(F.col("n").cast("long"), F.col("window") * stride + length - F.col("offset"))
    parts = cut.select("window", F.col("offset"), F.slice(tokens, (start + 1).cast("int"), (end - start).cast("int")).alias("part"))
    whole = parts.groupBy("window").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids"))
    return whole.select("window", F.size("ids").alias("n"), F.concat("ids", F.array_repeat(pad, F.lit(length) - F.size("ids"))).alias("ids"))


def padded(ids: Column, length: Column, pad: Column) -> Column:
    """Cut and filled to ``length``."""
    cut = F.slice(ids, F.lit(1), length)
    return F.concat(cut, F.array_repeat(pad, length - F.size(cut)))


def pad_lines(rows: DataFrame, length: int, pad: Column, tokens: str = "tokens") -> DataFrame:
    n = F.least(F.size(tokens), F.lit(length))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return rows.withColumn("ids", padded(F.col(tokens), F.lit(length), pad)).withColumn("mask", mask)


def collate(rows: DataFrame, batch: str, ids: str = "ids", labels: str | None = None, max_length: int | None = None, pad: int = PAD) -> DataFrame:
    """Rows of a batch padded to its longest (at most ``max_length``); labels are padded with -100, or copied from ids where none are given (causal)."""
    # a window, so that rows are made once; a batch is small
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    out = rows.withColumn("width", F.least(longest, F.lit(max_length)) if max_length else longest)
    n = F.least(F.size(ids), F.col("width"))
    out = out.withColumn("mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("width") - n)))
    out = out.withColumn("out_labels", padded(F.col(labels or ids), F.col("width"), F.lit(IGNORE)))
    return out.withColumn("out_ids", padded(F.col(ids), F.col("width"), F.lit(pad)))


def _greedy(counts: list[tuple[int, int]], max_tokens: int, max_batch: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """For (length, rows) in order of length: (length, batch that is open, rows that still go there, rows of each batch after it); and the last batch."""
    out, batch, held = [], 0, 0
    for length, n in counts:
        most = max(1, min(max_batch, max_tokens // length if length > 0 else max_batch))
        room = min(n, max(0, most - held) if held else most)
        out.append((length, batch, room, most))
        rest = n - room
        if rest:
            full, last = divmod(rest - 1, most)
            batch, held = batch + full + 1, last + 1
        else:
            held += room
    return out, batch


def dynamic_batches(rows: DataFrame, max_tokens: int, max_batch: int, drop_last: bool = False) -> DataFrame:
    """(idx, length, batch): greedy batches over all rows in order of (length, idx).

    A batch closes when its longest row times its size would pass ``max_tokens``, or when
    it has ``max_batch`` rows; ``drop_last`` leaves out the last one.  How batches close
    depends on the number of rows of each length only: that table (as many rows as there
    are lengths) is folded on the driver, and a row's batch follows from its place among
    the rows of its length.
    """
    kept = rows.select(F.col("idx").cast("long").alias("idx"), F.col("length").cast("long").alias("length"))
    placed = offsets(kept.withColumn("one", F.lit(1)), ("length", "idx"), "one").drop("one")
    counts = [(int(r[0]), int(r[1])) for r in kept.groupBy("length").count().orderBy("length").collect()]
    plan, last = _greedy(counts, max_tokens, max_batch)
    first, starts = 0, []
    for (length, batch, room, most), (_, n) in zip(plan, counts, strict=True):
        starts.append((length, batch, room, most, first))
        first += n
    steps = rows.sparkSession.createDataFrame(starts, "length long, open long, room long, most long, first long")
    nth = F.col("offset") - F.col("first")
    batch = F.when(nth < F.col("room"), F.col("open")).otherwise(F.col("open") + 1 + F.floor((nth - F.col("room")) / F.col("most")))
    out = placed.join(F.broadcast(steps), "length").select("idx", "length", batch.cast("long").alias("batch"))  # one row for each length
    return out.where(F.col("batch") < last) if drop_last else out


def shards(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Adds ``shard`` and ``row``: consecutive rows in order, ``size`` to a shard."""
    numbered = offsets(rows.withColumn("_one", F.lit(1)), (order,), "_one").drop("_one")
    return numbered.withColumn("shard", F.floor(F.col("offset") / size)).withColumn("row", F.col("offset") % size).drop("offset")


def greedy_chunks(rows: DataFrame, limit: int, separator: int, group: str, order: str, size: str) -> DataFrame:
    """Adds ``chunk``: rows in order, a chunk closes before a row that would pass ``limit``; ``separator`` counts after each row."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        chunk, held, numbers = 0, 0, []
        for n in part[size]:
            if held and held + n > limit:
                chunk, held = chunk + 1, 0
            held += n + separator
            numbers.append(chunk)
        return part.assign(chunk=numbers)[[group, order, size, "chunk"]]

    kept = rows.select(F.col(group).cast("long").alias(group), F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))
    return kept.groupBy(group).applyInPandas(fold, f"{group} long, {order} long, {size} long, chunk long")


def split_paragraphs(docs: DataFrame, max_chars: int, overlap: int) -> DataFrame:
    """(doc_id, part, content): paragraphs gathered up to ``max_chars``; each part but the first starts with the last ``overlap`` characters of the two paragraphs before it."""

    def cut(text: str) -> list[str]:
        parts, held, size = [], [], 0
        for p in text.split("\n\n"):
            if held and size + len(p) > max_chars:
                parts.append("\n\n".join(held))
                held = ["\n\n".join(held[-2:])[-overlap:]] if overlap else []
                size = sum(map(len, held))
            held.append(p)
            size += len(p) + 2
        return [*parts, "\n\n".join(held)]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or ""))

    return docs.select("doc_id", F.posexplode(F.pandas_udf(run, "array<string>")("text")).alias("part", "content"))
