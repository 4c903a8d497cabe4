"""The registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import html, metrics, pii, quality, schedules, text, urls
from corpusloom.operators import cleaning, crawl, dedup, incremental, pools, sft, store, tokens, training
from corpusloom.sources import readers, writers
from corpusloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listed(values: Column) -> Column:
    """A digest of a whole list, order and all."""
    return F.md5(F.array_join(F.transform(values, lambda x: x.cast("string")), ","))


def _scalar(name: str, f: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("out"))

    run.__name__ = name
    query(run)


for _name, _f in {
    "fix_encoding": text.fix_encoding,
    "strip_special": text.strip_special,
    "wechat_tags": text.wechat_tags,
    "strip_urls": text.strip_urls,
    "strip_emails": text.strip_emails,
    "book_metadata": text.book_metadata,
    "format_markers": text.format_markers,
    "page_numbers": text.page_numbers,
    "clean_whitespace": text.clean_whitespace,
    "drop_empty_lines": text.drop_empty_lines,
    "normalize_punct": text.normalize_punct,
    "page_clean": text.page_clean,
    "extracted_clean": text.extracted_clean,
    "clean_file_bundle": text.clean_file,
    "light_bundle": text.light,
    "standard_bundle": text.standard,
    "sentences": lambda c: F.array_join(text.sentences(c), "\n"),
    "word_ngrams": lambda c: F.md5(F.array_join(F.array_sort(text.ngrams(c)), "\n")),
    "pii_redact": pii.redact,
    "pii_flag": pii.has_pii,
    "quality_score": lambda c: F.round(quality.score(c), 9),
    "codepoints": lambda c: _listed(tokens.codepoints(c)),
}.items():
    _scalar(_name, _f)


@query
def text_lines(spark, sf_dir):
    return text.lines(read(spark, sf_dir, "documents"))


@query
def file_hashes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.substring(F.sha2("text", 256), 1, 16).alias("short_id"), F.octet_length("text").alias("size"))


@query
def pii_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(n) for n, c in pii.counts(F.col("text")).items()))


@query
def quality_filter(spark, sf_dir):
    return quality.filter_by_quality(read(spark, sf_dir, "documents"), min_score=0.65).select("doc_id", F.round("score", 9).alias("score"))


@query
def quality_stats(spark, sf_dir):
    found = quality.stats(read(spark, sf_dir, "documents"))
    return found.select("total", "passed", "filtered", *(F.round(c, 9).alias(c) for c in ("pass_rate", "avg_score", "min_score", "max_score")))


@query
def exact_dedup(spark, sf_dir):
    return dedup.exact(read(spark, sf_dir, "documents"))


@query
def near_dup_pairs(spark, sf_dir):
    return dedup.near_pairs(read(spark, sf_dir, "documents")).select("a_id", "b_id", F.round("jaccard", 9).alias("jaccard"))


@query
def near_dedup(spark, sf_dir):
    return dedup.near(read(spark, sf_dir, "documents"))


@query
def line_dedup(spark, sf_dir):
    return dedup.lines(read(spark, sf_dir, "documents"))


@query
def line_dedup_threshold(spark, sf_dir):
    rows = text.lines(read(spark, sf_dir, "documents")).withColumn("line", text.strip(F.col("line")))
    return dedup.lines_over_threshold(rows, 3)


@query
def line_out_numbers(spark, sf_dir):
    """Running number of the lines that dedup keeps."""
    return training.running_number(dedup.lines(read(spark, sf_dir, "documents")).select("doc_id", "line_no"), "doc_id", "line_no")


@query
def clean_corpus(spark, sf_dir):
    return cleaning.clean_corpus(read(spark, sf_dir, "documents")).drop("cleaned")


@query
def clean_corpus_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return cleaning.corpus_stats(docs, cleaning.clean_corpus(docs))


def _store_documents(spark, sf_dir) -> DataFrame:
    """Documents in the store's form; the run is the source."""
    rows = read(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("original_file_path"), F.md5("text").alias("original_md5"), F.octet_length("text").cast("long").alias("original_size"), F.length("text").cast("long").alias("cleaned_size"), F.size(text.split_lines(F.col("text"))).cast("long").alias("line_count"), (F.col("doc_id") % 3).alias("pii_count"), (F.col("doc_id") % 5).alias("quality_filtered"), (F.col("doc_id") % 7).alias("dedup_filtered"), F.col("source").alias("run_id"), F.col("text").alias("cleaned_content"))


@query
def cleaned_documents_upsert(spark, sf_dir):
    docs = _store_documents(spark, sf_dir).select("id", "original_file_path", "line_count", "run_id")
    # every document comes again: those with even ids under their own path, the others as new files
    path = F.when(F.col("id") % 2 == 0, F.col("original_file_path")).otherwise(F.concat(F.lit("new/"), F.col("id").cast("string")))
    rows = docs.withColumn("original_file_path", path).drop("id").withColumn("line_count", F.col("line_count") + 1000)
    return store.upsert(docs, rows, "original_file_path").select("original_file_path", "line_count", "run_id", F.col("id").isNotNull().alias("has_id"))


@query
def incremental_skip(spark, sf_dir):
    docs = _store_documents(spark, sf_dir)
    return store.unprocessed(docs.select("id", F.col("original_md5").alias("md5")), docs.select(F.when(F.col("id") % 4 == 0, F.col("original_md5")).otherwise("other").alias("original_md5")))


@query
def run_rollup(spark, sf_dir):
    return store.rollup(_store_documents(spark, sf_dir))


@query
def run_delete(spark, sf_dir):
    """What is left after the cascade of one run."""
    return store.without_run(_store_documents(spark, sf_dir), "src0").groupBy("run_id").agg(F.count("*").alias("n"))


@query
def store_stats(spark, sf_dir):
    return store.stats(_store_documents(spark, sf_dir))


@query
def content_search(spark, sf_dir):
    return store.search(_store_documents(spark, sf_dir), "Rights Reserved", limit=20).select("id")


@query
def lookup_by_hash(spark, sf_dir):
    docs = _store_documents(spark, sf_dir)
    return store.lookup(docs, docs.where("id = 11").select("original_md5"), "original_md5").select("id", "original_md5")


@query
def find_by_run(spark, sf_dir):
    return store.find(_store_documents(spark, sf_dir), run_id="src1").select("id", "run_id")


@query
def find_by_path(spark, sf_dir):
    return store.find(_store_documents(spark, sf_dir), original_file_path="in/7.txt").select("id", "original_md5")


@query
def processed_hashes(spark, sf_dir):
    return store.processed_hashes(_store_documents(spark, sf_dir))


def _store_pages(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", urls.domain(F.col("url")).alias("domain"), F.when(F.col("page_id") % 3 != 0, 1).otherwise(0).alias("is_crawled"))


@query
def find_by_domain(spark, sf_dir):
    pages = _store_pages(spark, sf_dir)
    first = pages.where("is_crawled = 1").agg(F.min("domain")).first()[0]
    return store.find_by_domain(pages, first).select("id", "url")


@query
def page_counts(spark, sf_dir):
    return store.page_counts(_store_pages(spark, sf_dir))


@query
def run_finish(spark, sf_dir):
    """Two runs, one with documents and one without, the first of them finished."""
    runs = spark.createDataFrame([(1, "src1"), (2, "none")], "id long, run_id string")
    counters = ["success_count", "total_output_lines", "total_pii_detected", "total_quality_filtered", "total_dedup_filtered"]
    runs = runs.select("id", "run_id", *(F.lit(0).cast("long").alias(c) for c in counters), F.lit(None).cast("timestamp").alias("finished_at"))
    done = store.finish(runs, _store_documents(spark, sf_dir), "src1", F.lit("2024-01-01").cast("timestamp"))
    return done.select("run_id", *counters, F.col("finished_at").isNotNull().alias("finished"))


@query
def list_page(spark, sf_dir):
    return store.page(_store_documents(spark, sf_dir), 25, 50).select("id", "original_md5")


@query
def domain_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query
def csv_text(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    names = [c for c, t in rows.dtypes if t in ("string", "bigint", "int")]
    return rows.select("c_custkey", readers.labelled_fields(names, label_single=True).alias("out"))


@query
def row_text(spark, sf_dir):
    rows = read(spark, sf_dir, "nation")
    return rows.select("n_nationkey", readers.labelled_fields(rows.columns).alias("out"))


@query
def row_chunks(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.hash("source").alias("x"), F.col("source"), F.octet_length("text").alias("size"))
    grouped = rows.select(F.expr("cast(substring(source, 4) as bigint)").alias("grp"), "doc_id", "size")
    return tokens.greedy_chunks(grouped, 20_000, 1, "grp", "doc_id", "size")


@query
def split_paragraphs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return tokens.split_paragraphs(docs, 2000, 0).select("doc_id", "part", F.length("content").alias("size"), F.md5("content").alias("md5"))


@query
def split_paragraphs_overlap(spark, sf_dir):
    """The last 200 characters of a part stand at the start of the next."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return tokens.split_paragraphs(docs, 2000, 200).select("doc_id", "part", F.length("content").alias("size"), F.md5("content").alias("md5"))


@query
def merge_text(spark, sf_dir):
    merged = writers.merged(read(spark, sf_dir, "benchmark"), F.col("item_id") % 4, "item_id")
    return merged.select("grp", F.length("content").alias("size"), F.md5("content").alias("md5"))


@query
def reassembled_text(spark, sf_dir):
    out = writers.reassembled(dedup.lines(read(spark, sf_dir, "documents")))
    return out.select("doc_id", F.md5("content").alias("md5"))


@query
def export_names(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("a/"), F.col("source"), F.lit(".txt")).alias("original_file_path"))
    return writers.export_names(docs).select("id", "name")


@query
def day_files(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "ts", "props")
    return writers.day_files(events, "props", "ts", "event_id", limit=1000).select("event_id", "file")


def _qa(spark, sf_dir) -> DataFrame:
    """A user turn and the assistant turn after it, as title and answer; the system turn is the description."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("title"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    told = turns.where("role = 'system'").groupBy("conv_id").agg(F.min("text").alias("desc"))
    return asked.join(answered, ["conv_id", "turn"], "left").join(told, "conv_id", "left")


@query
def qa_to_sft(spark, sf_dir):
    return sft.qa_to_sft(_qa(spark, sf_dir))


@query
def sft_prompt(spark, sf_dir):
    rows = sft.qa_to_sft(_qa(spark, sf_dir))
    out = [rows.select("conv_id", "turn", F.lit(t).alias("template"), *(c.alias(n) for n, c in zip(("prompt", "full"), sft.prompt(t), strict=True))) for t in ("alpaca", "chat", "simple")]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query
def chat_render(spark, sf_dir):
    return sft.render_chat(read(spark, sf_dir, "conversations"))


@query
def sft_labels(spark, sf_dir):
    asked, full = sft.prompt("simple")
    rows = sft.qa_to_sft(_qa(spark, sf_dir)).select("conv_id", "turn", text.words(asked).alias("p"), text.words(full).alias("f"))
    ids, masked = sft.labels(F.transform("f", lambda w: F.length(w)), F.col("p"), 64)
    return rows.select("conv_id", "turn", _listed(ids).alias("ids"), _listed(masked).alias("labels"))


def _length_ids(docs: DataFrame) -> DataFrame:
    """Lines with their words' lengths as ids."""
    return tokens.line_tokens(docs, lambda c: F.transform(text.words(c), lambda w: F.length(w)))


@query
def pack_windows(spark, sf_dir):
    packed = tokens.pack_windows(_length_ids(read(spark, sf_dir, "documents")), 512, F.lit(tokens.PAD))
    return packed.select("window", "n", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % 1_000_003).alias("digest"))


@query
def pack_codepoints(spark, sf_dir):
    packed = tokens.pack_windows(tokens.line_tokens(read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), tokens.codepoints), 256, F.lit(tokens.PAD))
    return packed.select("window", "n", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % 1_000_003).alias("digest"))


@query
def pad_lines(spark, sf_dir):
    out = tokens.pad_lines(_length_ids(read(spark, sf_dir, "documents")), 32, F.lit(tokens.PAD))
    return out.select("doc_id", "line_no", _listed(F.col("ids")).alias("ids"), _listed(F.col("mask")).alias("mask"))


def _batched(spark, sf_dir) -> DataFrame:
    rows = _length_ids(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_no", F.floor(F.col("doc_id") / 8).alias("batch"), F.col("tokens").alias("ids"), F.transform("tokens", lambda x, i: F.when(i < 3, -100).otherwise(x)).alias("labels"))


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "line_no", "width", _listed(F.col("out_ids")).alias("ids"), _listed(F.col("out_labels")).alias("labels"), _listed(F.col("mask")).alias("mask"))


@query
def collate_causal(spark, sf_dir):
    return _digest(tokens.collate(_batched(spark, sf_dir), "batch"))


@query
def collate_sft(spark, sf_dir):
    return _digest(tokens.collate(_batched(spark, sf_dir), "batch", labels="labels", max_length=48))


@query
def dynamic_batches(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.size(text.words(F.col("text"))).cast("long").alias("length"))
    return tokens.dynamic_batches(rows, 4096, 8)


@query
def dynamic_batches_drop_last(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.size(text.words(F.col("text"))).cast("long").alias("length"))
    return tokens.dynamic_batches(rows, 2048, 32, drop_last=True)


@query
def shard_assign(spark, sf_dir):
    return tokens.shards(read(spark, sf_dir, "documents").select("doc_id"), 64, "doc_id")


@query
def file_changes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    named = lambda of, k: F.concat(F.when(F.col("doc_id") % k == 0, of).otherwise(""), F.col("doc_id").cast("string")).alias("name")
    now = docs.select(named("new-", 5), F.md5("text").alias("hash"))
    then = docs.select(named("old-", 3), F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.md5("text")).alias("hash"))
    return incremental.file_changes(now, then)


@query
def oov_chars(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    vocabulary = docs.where("lang = 'en'").select(F.explode(F.split("text", "")).alias("char")).distinct()
    return incremental.oov(docs, vocabulary)


@query
def page_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.title(F.col("html")).alias("title"))


@query
def page_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), urls.content_hash(F.col("html"), 32).alias("key"))


@query
def url_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


@query
def url_valid(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.is_valid(F.col("url")).alias("valid"), urls.is_valid(F.col("url"), pattern="/en/").alias("valid_en"))


def _page_text(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "pages").select("page_id", html.page_text_column(F.col("html"), kind).alias("out"))

    run.__name__ = f"page_text_{kind}"
    return query(run)


for _kind in ("auto", "news", "novel", "wiki"):
    _page_text(_kind)


@query
def page_plain_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.plain_text_column(F.col("html")).alias("out"))


@query
def page_links(spark, sf_dir):
    return crawl.links(read(spark, sf_dir, "pages"))


@query
def crawl_corpus(spark, sf_dir):
    return crawl.corpus(read(spark, sf_dir, "pages"))


@query
def daily_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("pages_crawled"), F.count_if(F.col("event_type") == "error").alias("pages_failed"), F.round(F.sum("value"), 6).alias("total_time"))
    empty = spark.createDataFrame([], store.SCHEMAS["crawl_stats"])
    return store.add_daily(empty, rows).select("date", "pages_crawled", "pages_failed", F.round("total_time", 4).alias("total_time"))


@query
def recent_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))
    return store.latest_days(rows, 7)


@query
def rate_limit(spark, sf_dir):
    return jobs.rate_limit(read(spark, sf_dir, "events"), 3600.0, 2)


@query
def seen_marks(spark, sf_dir):
    """Users as keys that are marked by their events; each mark renews them for an hour."""
    return jobs.marks(read(spark, sf_dir, "events"), 3600.0, "user_id", "ts", "event_id").select("user_id", "event_id", "fresh")


@query
def stage_timing(spark, sf_dir):
    out = training.stage_timing(read(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("t", 4).alias("t"), F.round("mean", 6).alias("mean"), "least", "most", F.round("share", 6).alias("share"))


@query
def weighted_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("w", F.pmod("event_id", F.lit(4)) + 1)
    return training.weighted_means(rows, "event_type", "value", "w", "event_id").select("event_type", F.round("mean", 6).alias("mean"), F.round("last", 9).alias("last"))


@query
def perplexity(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("w", F.pmod("event_id", F.lit(4)) + 1)
    return rows.groupBy("event_type").agg(F.round(metrics.perplexity(F.col("value") / 100, F.col("w")), 6).alias("perplexity"))


def _steps(spark, sf_dir) -> DataFrame:
    """Losses of runs: a user's event values in order."""
    return read(spark, sf_dir, "events").select("user_id", "event_id", "value")


@query
def rolling_loss(spark, sf_dir):
    return training.progress(_steps(spark, sf_dir), "user_id", "event_id", "value", 10).select("user_id", "event_id", F.round("rolling", 6).alias("rolling"))


@query
def progress(spark, sf_dir):
    rows = _steps(spark, sf_dir)
    rows = rows.withColumn("seconds", 2.0 * F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    out = training.progress(rows, "user_id", "event_id", "value", 10, 500, "seconds")
    return out.select("user_id", "event_id", "step", "logged", F.round("percent", 6).alias("percent"), F.round("eta", 6).alias("eta"))


@query
def early_stop(spark, sf_dir):
    """Evaluations since the last strict improvement, and whether patience of 5 is out."""
    return training.early_stop(_steps(spark, sf_dir), "user_id", "event_id", "value", 5).select("user_id", "event_id", "waited", "stop")


@query
def checkpoint_keep(spark, sf_dir):
    return training.newest(_steps(spark, sf_dir), "user_id", "event_id", 3).select("user_id", "event_id")


@query
def bleu(spark, sf_dir):
    rows = _qa(spark, sf_dir).where("answer is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("title").alias("candidate"), F.col("answer").alias("reference"))
    return metrics.bleu(rows).select("n", F.round("score", 9).alias("score"))


@query
def f1_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    found = metrics.f1(rows, F.when(F.col("n_chars") > 1000, 1).otherwise(0), F.col("quality"))
    return found.select("average", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _logits(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


@query
def topk_accuracy(spark, sf_dir):
    found = metrics.accuracy(_logits(spark, sf_dir), F.col("x"), F.col("label"))
    return found.select(F.round("accuracy", 9).alias("accuracy"), F.round("topk_accuracy", 9).alias("topk_accuracy"))


@query
def router_topk(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.array_join(metrics.top_indexes(F.col("x"), 2), ",").alias("experts"))


@query
def nucleus(spark, sf_dir):
    rows = _logits(spark, sf_dir).select("vec_id", F.transform("x", lambda v: v * 8).alias("x"))
    return rows.select("vec_id", F.array_join(metrics.nucleus(metrics.softmax(F.col("x")), 0.9), ",").alias("kept"))


@query
def moe_balance(spark, sf_dir):
    found = metrics.balance_loss(_logits(spark, sf_dir), F.col("x"), 2)
    return found.select(F.round("balance_loss", 9).alias("balance_loss"), F.round("z_loss", 9).alias("z_loss"))


@query
def cross_entropy(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(metrics.cross_entropy(F.col("x"), F.col("label")), 9).alias("loss"))


@query
def learning_rates(spark, sf_dir):
    s = F.col("id")
    forms = {"cosine": schedules.cosine(s, 100, 1000, floor=0.1), "linear": schedules.linear(s, 100, 1000), "constant": schedules.constant(s, 100), "polynomial": schedules.polynomial(s, 100, 1000, 1e-3, power=2.0), "restarts": schedules.restarts(s, 100, 2, 0.0, 1.0), "one_cycle": schedules.one_cycle(s, 1e-2, 1000)}
    return spark.range(0, 1001).select(s.alias("step"), *(F.round(c, 9).alias(n) for n, c in forms.items()))


@query
def kv_cache(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lit(12).alias("layers"), (F.col("p_size") % 4 + 1).alias("batch"), F.lit(16).alias("heads"), F.pow(F.lit(2), F.col("p_size") % 5).cast("int").alias("kv"), (F.col("p_size") * 64).alias("length"), F.lit(64).alias("dim"))
    size = lambda h: schedules.cache_mb(*(F.col(c) for c in ("layers", "batch", h, "length", "dim")))
    return rows.select("p_partkey", F.round(size("kv"), 9).alias("mb"), F.round(size("heads") - size("kv"), 9).alias("saved_mb"), F.round(schedules.share_saved(F.col("heads"), F.col("kv")), 9).alias("reduction"), schedules.flash_speedup(F.col("length")).alias("speedup"))


@query
def ring_slots(spark, sf_dir):
    return spark.range(0, 20_000).select(F.col("id").alias("position"), schedules.ring_slot(F.col("id"), 4, 4096).alias("slot"))


@query
def crawl_counts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(text.page_clean(html.page_text_column(F.col("html"))).alias("text"))
    return crawl.corpus_counts(pages)


@query
def url_resolve(spark, sf_dir):
    """An absolute path, another site, a fragment and a relative path against each page."""
    links = [(0, "/a/b"), (1, "http://other.example/x?y#z"), (2, "#top"), (3, "c?d")]
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(u).alias("u")) for k, u in links))).alias("x"))
    return rows.select("page_id", "x.k", urls.resolve(F.col("x.u"), F.col("url")).alias("out"))


def _files(spark, sf_dir) -> DataFrame:
    """Documents as text files."""
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("text").alias("content"))


@query
def file_dedup(spark, sf_dir):
    return dedup.files(_files(spark, sf_dir)).select("path")


@query
def file_dedup_raw(spark, sf_dir):
    return dedup.files(_files(spark, sf_dir), raw=True).select("path")


@query
def file_dedup_stats(spark, sf_dir):
    files = _files(spark, sf_dir)
    return dedup.file_stats(files, dedup.files(files))


@query
def clean_files(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.lit("").alias("name"), F.col("text").alias("content"))
    return cleaning.clean_files(files).select("path", F.md5("content").alias("md5"), "error")


@query
def batch_summary(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("").alias("name"), F.col("text").alias("content"))
    return cleaning.batch_summary(cleaning.clean_files(files))


@query
def site_dump(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", urls.domain(F.col("url")).alias("site"), urls.title(F.col("html")).alias("title"), F.substring("html", 1, 100).alias("text"))
    return writers.site_dump(pages).select("site", F.md5("content").alias("md5"))


@query
def site_meta(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("site"))
    return writers.site_meta(pages.where("page_id % 4 != 0"), pages.where("page_id % 4 = 0"))


def _sharded(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query
def corpus_manifest(spark, sf_dir):
    return writers.manifest(writers.corpus_shards(_sharded(spark, sf_dir), 100, "doc_id"))


@query
def corpus_index(spark, sf_dir):
    return readers.batches(readers.indexed(_sharded(spark, sf_dir).select("doc_id"), "doc_id", 100), 8).select("doc_id", "index", "shard", "batch")


@query
def indexed_lines(spark, sf_dir):
    return readers.indexed_lines(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@query
def file_order(spark, sf_dir):
    return readers.paths(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path")))


@query
def record_counts(spark, sf_dir):
    return readers.record_counts(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("path"), F.col("c_name").alias("text")))


@query
def line_stream_dedup(spark, sf_dir):
    """The streaming chain's form: lines neither stripped nor left out."""
    return dedup.lines_over_threshold(text.lines(read(spark, sf_dir, "documents"), keep_blank=True), 3)


@query
def sample_bytes(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("line_no"), F.concat("source", F.col("doc_id").cast("string")).alias("line"))
    return incremental.sample_bytes(lines, 3000).groupBy("file").agg(F.count("*").alias("n"))


@query
def estimated_examples(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.octet_length("text").alias("size"))
    return incremental.estimated_examples(files, 5000)


def _change_case(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One example a document: examples of the last run, changes, and examples made anew."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.lit(0).alias("row"), F.md5("text").alias("payload"))
    kind = F.when(F.col("doc_id") % 11 == 0, "new").when(F.col("doc_id") % 7 == 0, "modified").when(F.col("doc_id") % 5 == 0, "deleted").otherwise("unchanged")
    docs = docs.withColumn("change", kind)
    old = docs.where("change != 'new'").select("name", "row", "payload", F.floor(F.col("doc_id") / 50).alias("shard"))
    return old, docs.select("name", "change"), docs.where("change != 'deleted'").select("name", "row", "payload")


@query
def next_examples(spark, sf_dir):
    old, changes, fresh = _change_case(spark, sf_dir)
    return incremental.next_examples(old, changes, fresh, 20).select("name", "shard")


@query
def dataset_summary(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    manifest = docs.select(F.when(F.col("doc_id") % 5 == 0, "orphaned").otherwise("active").alias("status"))
    return incremental.dataset_summary(docs.select(F.floor(F.col("doc_id") / 50).alias("shard")), manifest)


@query
def change_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.md5("text").alias("hash"), "doc_id")
    then = docs.select("name", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return incremental.change_counts(incremental.file_changes(docs, then))


def _agents(spark, sf_dir) -> DataFrame:
    """User agents of six kinds, with a customer's nation as version."""
    k, v = F.col("c_custkey") % 6, (F.col("c_nationkey") + 80).cast("string")
    kinds = ["Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/{0}.0 Safari/537.36 Edg/{0}.0", "Mozilla/5.0 (X11; Linux x86_64) Chrome/{0}.0 Safari/537.36", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Safari/605.1", "Mozilla/5.0 (Windows NT 6.3) Firefox/{0}.0", "Opera/9 (Windows CE) Opera/{0}", "Dalvik (Linux; Android 13)"]
    out = F.lit(None).cast("string")
    for i, form in enumerate(kinds):
        out = F.when(k == i, F.replace(F.lit(form), F.lit("{0}"), v)).otherwise(out)
    return read(spark, sf_dir, "customer").select("c_custkey", k.alias("k"), out.alias("agent"))


@query
def agents(spark, sf_dir):
    return pools.agents(_agents(spark, sf_dir)).drop("agent")


@query
def agent_counts(spark, sf_dir):
    return pools.agent_counts(pools.agents(_agents(spark, sf_dir)))


@query
def proxies(spark, sf_dir):
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    kind = F.when(k % 2 == 0, "http").otherwise("socks5")
    url = F.concat(kind, F.lit("://"), F.when(k % 5 == 0, F.concat(F.lit("u"), key, F.lit(":p:w@"))).otherwise(""), F.lit("H"), key, F.lit(".Example"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(":"), (k + 1000).cast("string"))))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", url.alias("url"))
    rows = rows.select("s_suppkey", *(c.alias(n) for n, c in pools.proxy_parts(F.col("url")).items()))
    return rows.withColumn("url", pools.proxy_url(*(F.col(c) for c in ("type", "host", "port", "user", "password"))))


def _health(spark, sf_dir) -> DataFrame:
    """Users as proxies, their errors as failures."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("proxy"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"))
    return pools.health(rows, 0.8)


@query
def proxy_health(spark, sf_dir):
    return _health(spark, sf_dir).select("proxy", "successes", "failures", F.round("success_rate", 9).alias("success_rate"), F.round("avg_time", 6).alias("avg_time"), "alive")


@query
def proxy_stats(spark, sf_dir):
    found = pools.pool_stats(_health(spark, sf_dir))
    return found.select("total", "alive", "dead", F.round("avg_success_rate", 9).alias("avg_success_rate"), F.round("avg_time", 6).alias("avg_time"))


@query
def proxy_pick(spark, sf_dir):
    found = _health(spark, sf_dir)
    each = [pools.pick(found, s, 3).select(F.lit(s).alias("strategy"), "proxy") for s in ("least_used", "fastest")]
    return each[0].unionAll(each[1])


@query
def round_robin(spark, sf_dir):
    return pools.round_robin(read(spark, sf_dir, "events").select("event_id"), ["a", "b", "c"], "event_id")


@query
def stream_use(spark, sf_dir):
    p = F.col("p_size")
    use = schedules.streaming_use(p * 200, F.lit(4100))
    ran = schedules.speculation(p % 5, p % 4, p % 3, (p % 7).cast("double"), (p % 11).cast("double"))
    exact = lambda c: F.round(c, 9)
    # only as many are accepted as were drafted: the ratio is taken as it is
    return read(spark, sf_dir, "part").select("p_partkey", exact(use["utilization"]).alias("utilization"), use["streaming"].alias("streaming"), use["window"].cast("int").alias("window"), *(exact(c).alias(n) for n, c in ran.items()))


@query
def attention_memory(spark, sf_dir):
    p = F.col("p_size")
    found = schedules.attention_memory(F.lit(2), F.lit(8), p * 16, F.lit(64), F.lit(12))
    return read(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 9).alias(n) for n, c in found.items()), schedules.expert_capacity(p, F.lit(8), 2, 1.0).cast("long").alias("capacity"), schedules.effective_batch(p, F.lit(4)).alias("effective_batch"))


@query
def formatted(spark, sf_dir):
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", schedules.format_bytes(e * e * 7919).alias("size"), schedules.format_seconds((e * 13) % 20000).alias("duration"))


@query
def trainer_perplexity(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("w", F.pmod("event_id", F.lit(4)) + 1)
    return rows.groupBy("event_type").agg(F.round(metrics.evaluation_perplexity(F.col("value"), F.col("w")), 6).alias("perplexity"))


@query
def label_classes(spark, sf_dir):
    return metrics.classes(read(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic") + 10)


def queries() -> dict[str, Query]:
    return dict(_FOUND)
