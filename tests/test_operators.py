"""Stores, files, folders, shards, pools, tokenizer files and streams on small inputs."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom import scratch
from corpusloom.functions import schedules, text, urls
from corpusloom.operators import cleaning, dedup, incremental, pools, store, tokenizer, tokens, training
from corpusloom.sources import readers, writers
from corpusloom.streaming import jobs


def test_offsets_of_any_keys(spark):
    rows = [(None, 0, 3), (10**15, 1, 2), (10**15, 0, 5), (-7, 0, 1), (4, 0, 0), (None, 1, 4)]
    got = tokens.offsets(spark.createDataFrame(rows, "doc_id long, line_no int, n int")).collect()
    want, at = {}, 0
    for d, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[d, i], at = at, at + n
    assert {(r.doc_id, r.line_no): r.offset for r in got} == want
    named = spark.createDataFrame([("b", 0, 1, 9), ("a", 0, 2, 8)], "doc_id string, line_no int, n int, _range int")
    assert sorted((r.doc_id, r.offset, r._range) for r in tokens.offsets(named).collect()) == [("a", 0, 8), ("b", 2, 9)]
    assert tokens.shards(spark.createDataFrame([(None,), (None,), (1,)], "doc_id long"), 2, "doc_id").count() == 3


def plain_batches(lengths, most_tokens, most_rows):
    """One walk over all rows."""
    batches, now, longest = [], [], 0
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if max(longest, lengths[i]) * (len(now) + 1) <= most_tokens and len(now) < most_rows:
            now.append(i)
            longest = max(longest, lengths[i])
        else:
            if now:
                batches.append(now)
            now, longest = [i], lengths[i]
    return [*batches, now] if now else batches


@pytest.mark.parametrize("most_tokens,most_rows", [(100, 32), (40, 3), (10, 5), (1000, 1)])
def test_batches_against_one_walk(spark, most_tokens, most_rows):
    lengths = [(i * 7919) % 23 for i in range(200)] + [50, 50, 3]
    rows = spark.createDataFrame(list(enumerate(lengths)), "idx long, length long").repartition(5)
    want = {i: k for k, b in enumerate(plain_batches(lengths, most_tokens, most_rows)) for i in b}
    assert {r.idx: r.batch for r in tokens.dynamic_batches(rows, most_tokens, most_rows).collect()} == want
    last = max(want.values())
    kept = {r.idx for r in tokens.dynamic_batches(rows, most_tokens, most_rows, drop_last=True).collect()}
    assert kept == {i for i, b in want.items() if b < last}


def test_store_rows(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.init()
    assert s.exists("crawler_pages") and s.count("crawler_pages") == 0 and ("url", "string") in s.info("crawler_pages")
    page = spark.createDataFrame([("u1", "h1", "d", 1), ("u2", "h1", "d", 0), ("u1", "h9", "d", 1)], "url string, content_hash string, domain string, is_crawled int")
    assert s.create("crawler_pages", page) == 2 and s.create("crawler_pages", page) == 0
    pages = s.read("crawler_pages")
    assert {r.url for r in store.find(pages, content_hash="h1").collect()} | {r.url for r in store.find(pages, content_hash="h9").collect()} == {"u1", "u2"}
    assert [r.id for r in store.find(pages).collect()] == [1, 2] and store.find(pages, url="u1", domain="e").isEmpty()
    assert store.is_crawled(pages, "u1") and not store.is_crawled(pages, "u2") and not store.is_crawled(pages, "none")
    assert [r.url for r in store.find_by_domain(pages, "d").collect()] == ["u1"]
    assert s.update("crawler_pages", F.col("url") == "u2", is_crawled=F.lit(1)) == 1 and s.update("crawler_pages", F.col("url") == "zz", is_crawled=F.lit(1)) == 0
    assert store.page_counts(s.read("crawler_pages")).first() == Row(total=2, crawled=2, domains=1)
    assert [r.id for r in s.list("crawler_pages", 1, 1).collect()] == [2] and s.count("crawler_pages") == 2
    s.start_run("r", "in", None, F.lit("2024-01-01"))
    docs = spark.createDataFrame([("a", "m", "r", 4), ("b", "n", None, 1)], "original_file_path string, original_md5 string, run_id string, line_count long")
    s.create("cleaned_documents", docs)
    s.finish_run("r", F.lit("2024-01-02").cast("timestamp"))
    assert (s.read("cleaning_runs").first().success_count, s.read("cleaning_runs").first().total_output_lines) == (1, 4)
    assert store.is_processed(s.read("cleaned_documents"), "m") and not store.is_processed(s.read("cleaned_documents"), "x")
    assert s.delete_run("r") and not s.delete_run("r")
    assert [r.original_file_path for r in s.read("cleaned_documents").collect()] == ["b"]
    assert set(s.backup(f"file://{tmp_path}/copy")) == set(store.SCHEMAS)
    assert store.Store(spark, f"file://{tmp_path}/copy").count("cleaned_documents") == 1
    assert len(list((tmp_path / "store/cleaned_documents").glob("v=*"))) <= store.VERSIONS
    (tmp_path / "store/crawl_stats/_claim-2").touch()
    with pytest.raises(RuntimeError):
        s.write("crawl_stats", s.read("crawl_stats"))
    s.drop_all()
    assert not s.exists("crawler_pages")


def test_text_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff\xfe end\n\nx\n")
    (tmp_path / "b.TXT").write_bytes("gut\n".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    files = readers.text_files(spark, f"file://{tmp_path}")
    assert {r.name: r.content for r in files.collect()} == {"a.txt": "café  end\n\nx\n", "b.TXT": "gut\n"}
    assert [r.place for r in readers.paths(files).orderBy("path").collect()] == [0, 1]
    lines = readers.decode_lines(spark, f"file://{tmp_path}", "a.txt").collect()
    assert [(r.line_no, r.line) for r in lines] == [(0, "café  end"), (2, "x")]
    one = spark.createDataFrame([("p", " a\n\nb")], "path string, content string")
    assert [r.line for r in readers.indexed_lines(one).orderBy("line_no").collect()] == ["a", "", "b"]
    assert [r.line for r in readers.indexed_lines(one, keep_unterminated=False).orderBy("line_no").collect()] == ["a", ""]
    done = cleaning.clean_files(files)
    assert [r.name for r in done.collect()] == ["a.txt", "b.TXT"] and cleaning.batch_summary(done).first() == Row(succeeded=2, failed=0)


def test_unknown_formats_and_conversion(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"k": "v"}')
    (src / "b.json").write_text("{bad")
    (src / "c.xyz").write_text("?")
    assert {r.name for r in readers.documents(spark, f"file://{src}").collect()} == {"a.json", "b.json"}
    found = {r.name: (r.text, r.error) for r in readers.documents(spark, f"file://{src}", unknown="error").collect()}
    assert found["a.json"] == ("k: v", None) and "JSONDecodeError" in found["b.json"][1] and "ValueError" in found["c.xyz"][1]
    with pytest.raises(ValueError):
        readers.extractor("x.docx")
    out = writers.convert(readers.documents(spark, f"file://{src}"), f"file://{tmp_path}/out").collect()
    assert [(r.path.rpartition("/")[2], r.output is None) for r in out] == [("a.json", False), ("b.json", True)]
    assert spark.read.text(f"file://{tmp_path}/out/name=a.txt").first()[0] == "k: v"
    assert readers.page_lines("a  b \n\n\n\n c") == "a b\n\nc"


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"crawler": {"depth": 2}, "log_level": "DEBUG"}))
    assert readers.settings(f"{tmp_path}/s.json", {"crawler": {"depth": 1, "delay": 3}, "log_dir": "x"}) == {"crawler": {"depth": 2, "delay": 3}, "log_dir": "x", "log_level": "DEBUG"}


def test_files_near_and_raw(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [("a", f"{words}\n"), ("b", f"\n  {words}  \n"), ("c", words.replace("w30", "zz") + " more"), ("d", " \n"), ("e", "else")]
    files = spark.createDataFrame(rows, "path string, content string")
    assert [r.path for r in dedup.files(files).collect()] == ["a", "c", "e"]
    assert [r.path for r in dedup.files(files, raw=True).collect()] == ["a", "b", "c", "d", "e"]
    assert [r.path for r in dedup.files(files, near_threshold=0.7).collect()] == ["a", "e"]
    assert dedup.file_stats(files, dedup.files(files)).first() == Row(total_files=5, unique_files=3, duplicates=1)


def test_shards_and_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:02d}", "añ" * i) for i in range(7)], "id string, text string")
    sharded = writers.corpus_shards(docs, 3)
    found = {r["index"]: (r.file, r.document_count, r.tokens, r.bytes) for r in writers.manifest(sharded).collect()}
    assert found == {0: ("train_00000", 3, 6, 9), 1: ("train_00001", 3, 24, 36), 2: ("train_00002", 1, 12, 18), -1: ("", 7, 42, 63)}
    writers.write_shards(sharded.withColumn("split", F.lit("train")), f"file://{tmp_path}/s", {"size": "3"})
    assert [(r.shard, r.num_examples) for r in readers.shard_sizes(spark, f"file://{tmp_path}/s").collect()] == [(0, 3), (1, 3), (2, 1)]
    assert readers.shards(spark, f"file://{tmp_path}/s", expect={"size": "3", "unheard": "x"}).count() == 7
    with pytest.raises(ValueError):
        readers.shards(spark, f"file://{tmp_path}/s", expect={"size": "4"})
    with pytest.raises(ValueError):
        readers.shard_sizes(spark, f"file://{tmp_path}/s", "val")


def test_next_examples(spark):
    old = spark.createDataFrame([("a", 0, "x", 0), ("a", 1, "x", 0), ("b", 0, "x", 1), ("c", 0, "x", 1)], "name string, row int, payload string, shard long")
    changes = spark.createDataFrame([("a", "modified"), ("b", "deleted"), ("c", "unchanged"), ("d", "new")], "name string, change string")
    fresh = spark.createDataFrame([("a", 0, "y"), ("d", 0, "y"), ("d", 1, "y"), ("c", 0, "never")], "name string, row int, payload string")
    got = {(r.name, r.row): (r.payload, r.shard) for r in incremental.next_examples(old, changes, fresh, 2).collect()}
    assert got == {("b", 0): ("x", 1), ("c", 0): ("x", 1), ("a", 0): ("y", 2), ("d", 0): ("y", 2), ("d", 1): ("y", 3)}
    assert {r.shard for r in incremental.rebuilt(fresh, 2).collect()} == {0, 1}
    new = incremental.migrated({"file_hashes": {"/x/a.txt": "h1", "b.txt": "h2"}, "files": {"train": ["t0", "t1"]}, "train_metadata": {"num_examples": 9}, "shard_size": 5})
    assert new["files"]["a.txt"] == {"hash": "h1", "status": "legacy", "shards": ["t0", "t1"], "num_examples": 4}
    assert new["config"]["shard_size"] == 5 and new["config"]["vocab_size"] == 32000 and new["summary"] == {"total_files": 2, "total_shards": 2, "next_shard_index": 2}


def test_pools(spark):
    agents = ["Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537 Edg/121.0", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Safari/604.1", "curl/8", "Mozilla/5.0 (Linux; Android 13) Firefox/99.0"]
    rows = pools.agents(spark.createDataFrame([(i, a) for i, a in enumerate(agents)], "i int, agent string")).orderBy("i").collect()
    assert [(r.browser, r.os, r.version) for r in rows] == [("edge", "windows_10", "120"), ("safari", "macos", "604"), ("unknown", "unknown", "0"), ("firefox", "android", "99")]
    one = spark.range(1)
    parts = lambda u: tuple(one.select(*(c.alias(n) for n, c in pools.proxy_parts(F.lit(u)).items())).first())
    assert parts("socks5://u:p:q@H.x:99/z") == ("socks5", "h.x", 99, "u", "p:q")
    assert parts("http://h") == ("http", "h", 8080, None, None) and parts("nothing") == ("http", "", 8080, None, None)
    health = pools.health(spark.createDataFrame([("a", True, 1.0), ("a", False, 9.0), ("b", True, 2.0), ("c", False, 1.0)], "proxy string, ok boolean, seconds double"))
    assert {r.proxy: (r.success_rate, r.avg_time, r.alive) for r in health.collect()} == {"a": (0.5, 1.0, True), "b": (1.0, 2.0, True), "c": (0.0, float("inf"), False)}
    assert pools.pick(health, "fastest").first().proxy == "a" and pools.pick(health, "least_used").first().proxy == "b"
    with pytest.raises(ValueError):
        pools.round_robin(one, [])
    used = spark.createDataFrame([("x", 1, None), ("y", 1, "2024-01-01"), ("z", 0, "2024-01-02")], "agent string, use_count int, last_used string")
    assert [r.agent for r in pools.least_used(used, 3).orderBy("place").collect()] == ["z", "x", "y"]


def test_training_logs(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, 2.0, 1.95, 1.9, 1.0])], "run int, step_id int, loss double")
    waited = [r.waited for r in training.early_stop(rows, "run", "step_id", "loss", 2, least=0.2).orderBy("step_id").collect()]
    assert waited == [0, 0, 1, 2, 0]
    assert training.weighted_means(spark.createDataFrame([("m", 2.0, 1, 0), ("m", 4.0, 3, 1)], "name string, v double, n int, i int"), "name", "v", "n", "i").first() == Row(name="m", mean=3.5, last=3.0)
    assert training.stage_timing(spark.createDataFrame([("a", 0.0)], "s string, t double"), "s", "t").first().share == 0.0


def test_formats(spark):
    sizes = [0, 1023, 1024, 1536, 1029, 1034, 1024**2, 1024**3 * 5 + 1]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s long").orderBy("i").select(schedules.format_bytes(F.col("s"))).collect()]
    plain = lambda n: f"{n} B" if n < 1024 else f"{n / 1024:.2f} KB" if n < 1024**2 else f"{n / 1024**2:.2f} MB" if n < 1024**3 else f"{n / 1024**3:.2f} GB"
    assert got == [plain(n) for n in sizes]


def test_sizes_of_any_long(spark):
    # the largest of the events 60 times over, the ends of doubles and longs, ties, and two that the nearest double moves over a half
    sizes = [5999999**2 * 7919, 92233720368547758, 92233720368547759, 2**53 + 1, 2**62 + 255, 2**63 - 1, 2**27 * 9, 2**27 * 11, 107374182405368710, 107374182437580964]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(sizes)), "i int, s long").orderBy("i").select(schedules.format_bytes(F.col("s"))).collect()]
    assert got == [f"{n / 1024**3:.2f} GB" for n in sizes]


def test_resolve(spark):
    pairs = [("/a", "http://h/x/y"), ("../z", "http://h/x/y/q"), ("?q=1#f", "http://h/x"), ("mailto:a@b", "http://h"), (None, "http://h"), ("//o/p", "https://h"), ("http://[bad", "http://h")]
    got = [r[0] for r in spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(pairs)], "i int, u string, b string").orderBy("i").select(urls.resolve(F.col("u"), F.col("b"))).collect()]
    assert got == ["http://h/a", "http://h/x/z", "http://h/x?q=1", "mailto:a@b", None, "https://o/p", None]


def test_tokenizer_files(spark, tmp_path):
    own = pytest.importorskip("public_tokenizers")
    path = own.path("byte_bpe_50k.json")
    tokenizer.save(path, f"{tmp_path}/t")
    texts = spark.createDataFrame([(0, "hello big world"), (1, "hello"), (2, None), (3, "")], "i int, text string")
    rows = tokenizer.encode(texts, f"{tmp_path}/t").withColumn("g", F.lit(0))
    want = tokenizer.load(path)
    got = {r.i: list(r.ids) for r in rows.collect()}
    assert got == {0: want.encode("hello big world").ids, 1: want.encode("hello").ids, 2: [], 3: []}
    assert {r.i: r.back for r in tokenizer.decode(rows, path, to="back").collect()} == {0: "hello big world", 1: "hello", 2: "", 3: ""}
    called = {r.i: (list(r.input_ids), list(r.attention_mask)) for r in tokenizer.called(rows, pad=1, width=F.lit(5), max_length=2, truncation=True).collect()}
    assert called[0] == (got[0][:2], [1, 1]) and called[1] == ([*got[1], 1], [1, 0]) and called[3] == ([1, 1], [0, 0])
    assert json.loads((tmp_path / "t/tokenizer_config.json").read_text())["eos_token_id"] >= 0 and (tmp_path / "t/merges.txt").stat().st_size > 0


def test_patterns_by_width(spark):
    """Texts with and without wide characters go through the same chain."""
    texts = ["ISBN 978-1 and [12] x[3] end", "定价：12 元 ISBN 9", "=== rule --- （）() www.x.y", "by A Copyright 2020 B\nnext", "「quoted」 text", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.standard(F.col("t"))).collect()]
    assert got == ["and  x end".replace("  ", " "), "", "rule", "next", "text", ""]


def test_scratch_needs_a_shared_folder(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: "")

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch.shared_dir(Cluster)


def _feed(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_threshold_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    lines = [["a", "b", "a"], ["a", "c", "b"], ["b", "b", "c", "a"], ["d"]]
    schema, n = "doc_id long, line_no int, line string", 0
    for k, part in enumerate(lines):
        spark.createDataFrame([(1, n + i, x) for i, x in enumerate(part)], schema).coalesce(1).write.parquet(f"file://{src}/p{k}")
        n += len(part)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{src}/p*")
    folder = f"file://{tmp_path}/out"
    q = stream.writeStream.foreachBatch(jobs.threshold_batches(folder, 3)).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    whole = spark.read.schema(schema).parquet(f"file://{src}/p*")
    want = {(r.line_no, r.line) for r in dedup.lines_over_threshold(whole, 3).collect()}
    got = {(r.line_no, r.line) for r in jobs.threshold_kept(spark, folder).collect()}
    assert {x for _, x in got} == {"a", "b", "c", "d"} and len(got) == len(want)
    assert {x for x in got if x[1] in "cd"} == {x for x in want if x[1] in "cd"}


def test_marks_and_days_as_streams(spark, tmp_path):
    rows = [(1, 0, "2024-01-01 00:00:00", 1.0), (1, 1, "2024-01-01 00:50:00", 1.0), (1, 2, "2024-01-01 02:00:00", 1.0), (2, 3, "2024-01-02 00:00:00", 2.0), (2, 4, "2024-01-02 00:59:59", 4.0)]
    events = spark.createDataFrame(rows, "url long, id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    want = {0: True, 1: False, 2: True, 3: True, 4: False}
    assert {r.id: r.fresh for r in jobs.marks(events, 3600.0).collect()} == want
    events.write.parquet(path := f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(path)
    assert {r.id: r.fresh for r in _feed(spark, jobs.marks_stream(stream, 3600.0), "marked")} == want
    days = _feed(spark, jobs.daily(stream), "days", "complete")
    assert sorted((r.day.day, r.events, r.value) for r in days) == [(1, 3, 3.0), (2, 2, 6.0)]
    assert len(_feed(spark, jobs.unseen(stream), "fresh_urls")) == 2
