"""Tables to files: texts, merged texts, shards, day files and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import tokens

#: Fixed value: what stands between merged texts.
RULE = "\n\n" + "=" * 50 + "\n\n"


def reassembled(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line", separator: str = "\n", end: str = "\n") -> DataFrame:
    """(key, content): the lines of a key in order."""
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("l"))
    return rows.select(key, F.concat(F.array_join(F.transform("l", lambda x: x[line]), separator), F.lit(end)).alias("content"))


def merged(docs: DataFrame, group: Column, order: str, text: str = "text", separator: str = RULE) -> DataFrame:
    """(grp, content): the texts of a group in order with a ruled line between them."""
    rows = docs.groupBy(group.alias("grp")).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("l"))
    return rows.select("grp", F.array_join(F.transform("l", lambda x: x[text]), separator).alias("content"))


def export_names(docs: DataFrame, path: str = "original_file_path", order: str = "id") -> DataFrame:
    """Adds ``name``: the base name, with _1, _2, ... from the second of a name on, or doc_{id}.txt."""
    base = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    base = F.when(base == "", F.concat(F.lit("doc_"), F.col(order).cast("string"), F.lit(".txt"))).otherwise(base)
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(order)) - 1
    stem, ending = F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_base", r"(\.[^.]*)?$", 1)
    return docs.withColumn("_base", base).withColumn("_nth", nth).withColumn("name", F.when(F.col("_nth") == 0, F.col("_base")).otherwise(F.concat(stem, F.lit("_"), F.col("_nth").cast("string"), ending))).drop("_base", "_nth")


def write_texts(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One text value for each row, in a folder for each name; whole contents in one file each."""
    rows.select(F.col(name).alias("name"), F.col(content).alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(folder)


def write_shards(rows: DataFrame, folder: str, settings: dict[str, str]) -> None:
    """Rows with split and shard as a partitioned table, and the settings they were made with."""
    spark: SparkSession = rows.sparkSession
    rows.repartition("split", "shard").write.mode("overwrite").partitionBy("split", "shard").parquet(f"{folder}/data")
    spark.createDataFrame(sorted(settings.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/metadata")


def day_files(pages: DataFrame, text: str = "text", at: str = "crawled_at", order: str = "page_id", limit: int = 1 << 20) -> DataFrame:
    """Adds ``file``: YYYYMMDD-seq.txt; a file is full when ``limit`` bytes stand before a text."""
    size = F.octet_length(F.regexp_replace(F.col(text), "。", "。\n")).cast("long")
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_day").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pages.withColumn("_day", F.date_format(at, "yyyyMMdd")).withColumn("_size", size)
    return rows.withColumn("file", F.format_string("%s-%03d.txt", F.col("_day"), (F.floor(before / limit) + 1).cast("int"))).drop("_day", "_size")


def convert(documents: DataFrame, folder: str) -> DataFrame:
    """Writes the texts of (path, name, text, error) as name.txt and gives (path, output, error) in order of paths: what was written where, and what failed."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    rows = documents.select("path", F.concat(stem, F.lit(".txt")).alias("name"), "text", "error")
    good = rows.where("text is not null")
    write_texts(good.select("name", F.col("text").alias("content")), folder)
    output = F.when(F.col("text").isNotNull(), F.concat(F.lit(f"{folder.rstrip('/')}/name="), F.col("name")))
    return rows.select("path", output.alias("output"), "error").orderBy("path")


def site_dump(pages: DataFrame, site: str = "site", order: str = "page_id") -> DataFrame:
    """(site, content): a site's pages in order, each with its title (or URL) and URL above and a ruled line below."""
    head = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    page = F.concat(F.lit("# "), head, F.lit("\n\n# URL: "), F.col("url"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n" + "=" * 50 + "\n"))
    rows = pages.groupBy(site).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), page.alias("page")))).alias("l"))
    return rows.select(site, F.array_join(F.transform("l", lambda x: x["page"]), "\n").alias("content"))


def site_meta(pages: DataFrame, failed: DataFrame, site: str = "site") -> DataFrame:
    """(site, total_pages, failed_pages) of pages and failed URLs."""
    a = pages.groupBy(site).agg(F.count("*").alias("total_pages"))
    b = failed.groupBy(site).agg(F.count("*").alias("failed_pages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, site, "full_outer").select(site, zero("total_pages"), zero("failed_pages"))


def corpus_shards(docs: DataFrame, size: int = 10_000, order: str = "id", text: str = "text") -> DataFrame:
    """Adds shard, row and input_ids (code points, where no tokenizer has made ids)."""
    rows = tokens.shards(docs, size, order)
    return rows if "input_ids" in rows.columns else rows.withColumn("input_ids", tokens.codepoints(F.col(text)))


def manifest(sharded: DataFrame, text: str = "text", ids: str = "input_ids") -> DataFrame:
    """(index, file, document_count, tokens, bytes) of each shard, and a row with index -1 for the whole; one scan."""
    found = sharded.groupBy("shard").agg(F.count("*").alias("document_count"), F.sum(F.size(ids)).alias("tokens"), F.sum(F.octet_length(text)).alias("bytes"))
    each = found.select(F.col("shard").cast("long").alias("index"), F.format_string("train_%05d", F.col("shard").cast("long")).alias("file"), "document_count", "tokens", "bytes")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.unionByName(each.agg(F.lit(-1).cast("long").alias("index"), F.lit("").alias("file"), *map(zero, ("document_count", "tokens", "bytes"))))
