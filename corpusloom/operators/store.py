"""The metadata store: pages, daily counters, cleaned documents and runs, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The schemas of the store's tables and their unique keys.
SCHEMAS = {
    "crawler_pages": "id bigint, url string, content_hash string, file_path string, domain string, is_crawled int, crawled_at timestamp",
    "crawl_stats": "id bigint, date string, pages_crawled bigint, pages_failed bigint, pages_queued bigint, bytes_downloaded bigint, total_time double, updated_at timestamp",
    "cleaned_documents": "id bigint, original_file_path string, original_md5 string, cleaned_md5 string, cleaned_content string, original_size bigint, cleaned_size bigint, line_count bigint, quality_score double, pii_count bigint, quality_filtered bigint, dedup_filtered bigint, run_id string, source_url string, created_at timestamp",
    "cleaning_runs": "id bigint, run_id string, input_dir string, output_dir string, total_files bigint, success_count bigint, error_count bigint, total_input_lines bigint, total_output_lines bigint, total_pii_detected bigint, total_quality_filtered bigint, total_dedup_filtered bigint, started_at timestamp, finished_at timestamp",
}
KEYS = {"crawler_pages": "url", "crawl_stats": "date", "cleaned_documents": "original_file_path", "cleaning_runs": "run_id"}


#: Versions of a table that are kept: the last one and those that a reader may still hold.
VERSIONS = 3


class Store:
    """The four tables under one folder; writes replace a table with its next version.

    A version's folder is claimed before it is written, by a marker that only one writer
    can create; a second writer at the same time fails instead of losing rows.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v={versions[-1]}")

    def write(self, name: str, rows: DataFrame) -> None:
        """The next version; readers of the last ones are not disturbed, and an unfinished one is never read."""
        version = (self._versions(name) or [0])[-1] + 1
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        claim = Path(f"{self.folder}/{name}/_claim-{version}")
        fs = claim.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.createNewFile(claim):
            raise RuntimeError(f"another writer is at version {version} of {name}")
        try:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={version}")
        finally:
            fs.delete(claim, False)
        for old in self._versions(name)[:-VERSIONS]:
            fs.delete(Path(f"{self.folder}/{name}/v={old}"), True)

    def init(self) -> None:
        """Empty tables where there are none."""
        for name, schema in SCHEMAS.items():
            if not self.exists(name):
                self.write(name, self.spark.createDataFrame([], schema))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def drop_all(self) -> None:
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in SCHEMAS:
            path = Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def info(self, name: str) -> list[tuple[str, str]]:
        """Columns and types of a table."""
        return self.read(name).dtypes

    def backup(self, folder: str) -> list[str]:
        """The present version of each table that there is, as tables under another folder; their names."""
        names = [n for n in SCHEMAS if self.exists(n)]
        for name in names:
            self.read(name).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}/v=1")
        return names

    def create(self, name: str, rows: DataFrame) -> int:
        """Adds the rows whose key is neither in the table nor twice among them; how many were added."""
        table = self.read(name)
        new = rows.dropDuplicates([KEYS[name]]).join(table.select(KEYS[name]), KEYS[name], "left_anti")
        before = table.count()
        self.write(name, upsert(table, new, KEYS[name]))
        return self.count(name) - before

    def update(self, name: str, condition: Column, **values: Column) -> int:
        """Sets columns of the rows that fit; how many they are."""
        table, hit = self.read(name), F.coalesce(condition, F.lit(False))
        n = table.where(hit).count()
        if n:
            changed = [F.when(hit, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in table.dtypes]
            self.write(name, table.select(*changed))
        return n

    def list(self, name: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return page(self.read(name), limit, offset)

    def count(self, name: str) -> int:
        return self.read(name).count()

    def start_run(self, run_id: str, input_dir: str, output_dir: str | None, at: Column) -> None:
        row = self.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(input_dir).alias("input_dir"), F.lit(output_dir).cast("string").alias("output_dir"), at.cast("timestamp").alias("started_at"))
        self.create("cleaning_runs", row)

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.write(name, upsert(self.read(name), rows, KEYS[name]))

    def delete(self, name: str, condition: Column) -> None:
        self.write(name, self.read(name).where(~F.coalesce(condition, F.lit(False))))

    def delete_run(self, run_id: str, with_documents: bool = True) -> bool:
        """The run and, unless told otherwise, its documents; whether there was such a run."""
        documents, runs = without_run(self.read("cleaned_documents"), run_id), without_run(self.read("cleaning_runs"), run_id)
        found = not self.read("cleaning_runs").where(F.col("run_id") == run_id).isEmpty()
        if with_documents:
            self.write("cleaned_documents", documents)
        if found:
            self.write("cleaning_runs", runs)
        return found

    def finish_run(self, run_id: str, at: Column) -> None:
        """Sets the end of a run and, if it has documents, its totals."""
        self.write("cleaning_runs", finish(self.read("cleaning_runs"), self.read("cleaned_documents"), run_id, at))


def without_run(rows: DataFrame, run_id: str) -> DataFrame:
    """Rows of other runs, or of none."""
    return rows.where(~F.coalesce(F.col("run_id") == run_id, F.lit(False)))


def find(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have these values, in order of id: by url, content_hash, original_md5, cleaned_md5, original_file_path, run_id, date or id."""
    return reduce(lambda r, c: r.where(F.col(c[0]) == F.lit(c[1])), equal.items(), rows).orderBy("id")


def find_by_domain(pages: DataFrame, domain: str, limit: int = 100) -> DataFrame:
    """The first crawled pages of a domain."""
    return find(pages, domain=domain, is_crawled=1).limit(limit)


def exists(rows: DataFrame, **equal) -> bool:
    return not find(rows, **equal).isEmpty()


def is_crawled(pages: DataFrame, url: str) -> bool:
    return exists(pages, url=url, is_crawled=1)


def is_processed(documents: DataFrame, md5: str) -> bool:
    return exists(documents, original_md5=md5)


def lookup(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among the values of ``wanted``: many lookups as one semi join."""
    return rows.join(wanted.select(column).distinct(), column, "left_semi")


def page_counts(pages: DataFrame) -> DataFrame:
    """(total, crawled, domains) of the pages table; one scan."""
    return pages.agg(F.count("*").alias("total"), F.count_if(F.col("is_crawled") == 1).alias("crawled"), F.count_distinct("domain").alias("domains"))


def processed_hashes(documents: DataFrame) -> DataFrame:
    return documents.where("coalesce(original_md5, '') != ''").select("original_md5").distinct()


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those with the same key and keep their id; new ones get the next free ids, in no order that means anything."""
    have = [c for c in table.columns if c != "id"]
    new = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in have)).dropDuplicates([key])
    kept = table.join(new.select(key), key, "left_anti").select(*table.columns)
    merged = new.join(table.select(F.col("id"), F.col(key)), key, "left")
    known = merged.where("id is not null")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = _numbered(merged.where("id is null").drop("id"), key).crossJoin(top).withColumn("id", F.col("_nth") + F.col("_top"))  # one row on the right
    return kept.unionByName(known.select(*table.columns)).unionByName(fresh.select(*table.columns))


def _numbered(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """``_nth`` from 1, by hash class and key, without gathering the rows: numbers within hash classes, and the classes' totals."""
    classed = rows.withColumn("_class", F.pmod(F.xxhash64(key), F.lit(parts)))
    before = classed.groupBy("_class").count().withColumn("_before", F.sum("count").over(Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)))
    within = classed.withColumn("_in", F.row_number().over(Window.partitionBy("_class").orderBy(key)))
    return within.join(F.broadcast(before.select("_class", F.coalesce("_before", F.lit(0)).alias("_before"))), "_class").withColumn("_nth", F.col("_in") + F.col("_before")).drop("_class", "_in", "_before")  # at most `parts` rows


def unprocessed(files: DataFrame, documents: DataFrame, md5: str = "md5") -> DataFrame:
    """Files whose hash no stored document has; empty hashes do not count."""
    done = documents.where("coalesce(original_md5, '') != ''").select(F.col("original_md5").alias(md5)).distinct()
    return files.join(done, md5, "left_anti")


def rollup(documents: DataFrame) -> DataFrame:
    """Totals of each run."""
    return documents.groupBy("run_id").agg(F.count("*").alias("success_count"), F.sum("line_count").alias("total_output_lines"), F.sum("pii_count").alias("total_pii_detected"), F.sum("quality_filtered").alias("total_quality_filtered"), F.sum("dedup_filtered").alias("total_dedup_filtered"))


def finish(runs: DataFrame, documents: DataFrame, run_id: str, at: Column) -> DataFrame:
    totals = rollup(documents.where(F.col("run_id") == run_id))
    names = [c for c in totals.columns if c != "run_id"]
    own = F.col("run_id") == run_id
    joined = runs.join(totals.select("run_id", *(F.col(c).alias(f"_{c}") for c in names)), "run_id", "left")
    out = reduce(lambda d, c: d.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}"), names, joined)
    return out.withColumn("finished_at", F.when(own, at).otherwise(F.col("finished_at"))).select(*runs.columns)


def stats(documents: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return documents.agg(F.count("*").alias("total_documents"), zero("original_size").alias("total_original_size"), zero("cleaned_size").alias("total_cleaned_size"), zero("line_count").alias("total_lines"), zero("pii_count").alias("total_pii"))


def search(documents: DataFrame, keyword: str, column: str = "cleaned_content", limit: int = 100, order: str = "id") -> DataFrame:
    """The first ``limit`` rows whose text holds the keyword, case ignored; % and _ are wildcards."""
    return documents.where(F.col(column).ilike(f"%{keyword}%")).orderBy(order).limit(limit)


def page(rows: DataFrame, limit: int, offset: int = 0, order: str = "id") -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(limit)


def add_daily(stats_table: DataFrame, added: DataFrame) -> DataFrame:
    """Counters of a day grow by those of ``added`` (date and any counters); days without a row get one."""
    counters = ["pages_crawled", "pages_failed", "pages_queued", "bytes_downloaded", "total_time"]
    rows = added.select("date", *(F.col(c) if c in added.columns else F.lit(0).alias(c) for c in counters))
    both = stats_table.select("date", *counters).unionByName(rows)
    return both.groupBy("date").agg(*(F.sum(c).alias(c) for c in counters))


def latest_days(stats_table: DataFrame, n: int) -> DataFrame:
    return stats_table.orderBy(F.desc("date")).limit(n)


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.where("finished_at is null").orderBy(F.desc("started_at"))


def completed_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    return runs.where("finished_at is not null").orderBy(F.desc("started_at")).limit(limit)
