"""The flagship: documents to cleaned documents with their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import pii, quality, text
from corpusloom.operators import dedup


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, pii, score) of the lines that cleaning leaves; personal data are counted, then replaced."""
    rows = text.bound(text.lines(docs), line=text.standard(F.col("line"))).where("line != ''")
    rows = text.bound(rows.withColumn("pii", pii.total(F.col("line"))), line=pii.redact(F.col("line")))
    return text.bound(rows, score=quality.score(F.col("line"))).select("doc_id", "line_no", "line", "pii", "score")


def clean_corpus(docs: DataFrame, min_score: float = 0.5, line_threshold: int = 3, unique: bool = True) -> DataFrame:
    """One row for each document that has lines left, in the order and form of the store's records.

    Exact copies go first (one partial aggregation).  Lines are exploded and cleaned in
    place, once; the one shuffle of lines, by doc_id, serves the window that counts equal
    lines and the one aggregation that gathers lines and totals alike.  Rows with a null
    doc_id are left out: nothing tells one such document from another.
    """
    docs = docs.where("doc_id is not null")
    if unique:
        docs = docs.join(dedup.exact(docs).select("doc_id"), "doc_id", "left_semi")
    rows = clean_lines(docs).repartition("doc_id").withColumn("good", F.col("score") >= min_score)
    # equal good lines of a document: how often, and the first of them
    alike = Window.partitionBy("doc_id", "line", "good")
    rows = rows.withColumn("n", F.count("*").over(alike)).withColumn("first", F.min("line_no").over(alike))
    kept = F.col("good") & ((F.col("n") < line_threshold) | (F.col("line_no") == F.col("first")))
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("line_no", "line", "score")))).alias("l"), F.sum("pii").alias("pii_count"), F.count_if(~F.col("good")).alias("quality_filtered"), F.count_if("good").alias("good")).where(F.size("l") > 0)
    joined = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    mean = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["score"]) / F.size("l")
    out = text.bound(out, cleaned=joined)
    return out.select("doc_id", "cleaned", F.md5("cleaned").alias("cleaned_md5"), F.octet_length("cleaned").cast("long").alias("cleaned_size"), F.size("l").cast("long").alias("line_count"), F.round(mean, 9).alias("quality_score"), "pii_count", "quality_filtered", (F.col("good") - F.size("l")).alias("dedup_filtered"))


def corpus_stats(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Totals of a run: documents and lines in and out, what was filtered, and the share of lines kept."""
    lines_in = docs.agg(F.count("*").alias("total_docs"), F.sum(F.size(F.filter(text.iterated_lines(F.col("text")), lambda x: text.strip(x) != ""))).alias("total_lines"))
    out = cleaned.agg(F.count("*").alias("kept_docs"), F.sum("line_count").alias("output_lines"), F.sum("pii_count").alias("pii_detected"), F.sum("quality_filtered").alias("quality_filtered"), F.sum("dedup_filtered").alias("dedup_filtered"))
    return lines_in.crossJoin(out).withColumn("retention", F.round(F.col("output_lines") / F.when(F.col("total_lines") > 0, F.col("total_lines")), 9))  # one row each


def clean_files(files: DataFrame, urls: bool = False, emails: bool = False, numbers: bool = True) -> DataFrame:
    """(path, name, content, error) of text files (path, name, content), cleaned as wholes, in the order of their paths; a file without content has an error instead."""
    rows = files.select("path", "name", text.clean_file(F.col("content"), urls, emails, numbers).alias("content"))
    return rows.withColumn("error", F.when(F.col("content").isNull(), F.lit("no text"))).orderBy("path")


def batch_summary(results: DataFrame) -> DataFrame:
    """(succeeded, failed) of rows with an error or none."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
