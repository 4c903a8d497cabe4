"""Cleaning, quality, personal data, HTML and files on rows that the tables lack."""

import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html, metrics, pii, quality, text, urls
from corpusloom.operators import cleaning, crawl, dedup, incremental, sft, store, tokens
from corpusloom.sources import readers, writers
from corpusloom.streaming import jobs


def apply(spark, f, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


SPACES = "".join(map(chr, [*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def test_white_space_is_pythons(spark):
    t = f"{SPACES}a{SPACES}b{SPACES}"
    assert apply(spark, text.words, t, "", " ") == [[x for x in t.split()], [], []]
    assert apply(spark, text.strip, t, "　x ", "  ") == [t.strip(), "x", ""]


def test_cleaners(spark):
    assert apply(spark, text.fix_encoding, "a�b​c﻿d e f　g") == ["abcd e f　g"]
    assert apply(spark, text.strip_special, "a\x00b\tc\nd\x7f\x9f") == ["ab\tc\nd"]
    assert apply(spark, lambda c: text.strip_special(c, "a-z"), "aB1c") == ["ac"]
    assert apply(spark, text.wechat_tags, "甲（<WECHAT> Hirst）乙 (The <WECHAT>) <WECHAT>x  y （ ）") == ["甲乙 x y "]
    assert apply(spark, text.strip_urls, "see https://a.b/c?d and www.x.y end") == ["see  and  end"]
    assert apply(spark, text.strip_emails, "to me@x.org now") == ["to  now"]
    assert apply(spark, text.format_markers, "===== a --- b 「注」『x』 c[12] [3 note] 第 3 章--") == ["a b  c  "]
    assert apply(spark, text.book_metadata, "ISBN 978-7-1\n作 者：某人\n正文") == ["\n\n正文"]
    assert apply(spark, text.page_numbers, "a\n 12 \nb") == [re.sub(r"^\s*\d+\s*$", "", "a\n 12 \nb", flags=re.M)]
    assert apply(spark, text.normalize_punct, "a.... b---c") == ["a... b——c"]
    assert apply(spark, text.clean_whitespace, " a  b \n\n\n\n c ") == ["a b\n\nc"]
    assert apply(spark, text.sentences, "短。这是一个足够长的句子吗？是的，当然如此！\"他说完了。 tail that is long enough") == [["这是一个足够长的句子吗？", "是的，当然如此！\"他说完了。", "tail that is long enough"]]


def test_iterated_lines(spark):
    assert apply(spark, text.iterated_lines, "a\r\nb\rc\n\nd", "x\n", "") == [["a", "b", "c", "", "d"], ["x"], []]


def test_pipeline_of_steps(spark):
    chain = text.Pipeline().add(text.strip).add(F.upper).add_python(lambda s: s + "!")
    assert apply(spark, chain, " ab ", None) == ["AB!", None]


def test_quality_rules(spark):
    cases = {"": 0.0, "这是一段很好的中文，句子完整。": 1.0, "aaaaaaaa.": 0.45, "TODO": 0.35}
    got = apply(spark, quality.score, *cases)
    assert [round(x, 6) for x in got][:2] == [0.0, 1.0]
    assert all(0 <= x <= 1 for x in got)
    assert apply(spark, quality.score, "好好好好好。")[0] == pytest.approx(0.95)


def test_pii_order_and_context(spark):
    got = apply(spark, pii.redact, "打13812345678", "QQ：123456 x", "电话 010-12345678", "护照:E12345678", "a 10.1.2.3 b", "地址：北京市海淀区某某路一百二十三号院内", "QQ 12345甲")
    assert got == ["打<PHONE>", "QQ：<QQ> x", "电话 <PHONE>", "护照:<PASSPORT>", "a <IP> b", "<ADDR>", "QQ 12345甲"]
    row = spark.createDataFrame([("张三 13812345678",)], "t string").select(*(c.alias(n) for n, c in pii.counts(F.col("t")).items())).first()
    assert (row.phone_cn, row.name_phone) == (1, 1)


def test_html_texts():
    page = "<html><head><title>T - site</title><meta charset=x></head><body><nav>menu</nav><article><h1>Head</h1><p>" + "long text " * 30 + "</p></article><div class='sidebar'>no</div><footer>f</footer></body>"
    assert html.page_text(page).startswith("Head\nlong text") and "menu" not in html.page_text(page)
    assert html.page_text(page, "news") == html.page_text(page)
    assert html.page_text("<div class='chapter-content'>story</div>", "novel") == "story"
    assert html.page_text("<div class='wiki'>a<sup>1</sup><table><tr><td>x</td></tr></table>b</div>", "wiki") == "a\nb"
    assert html.plain_text("<p>a</p><meta x><p>b &amp; c</p><script>no</script>") == "a\n\nb & c"
    assert html.plain_text("<meta x><p>b</p>", strict=True) == ""
    assert html.links("<a href='/x#f'>1</a><a href='http://o/y'>2</a><a href='/x'>3</a><a>4</a>", "http://h/a/") == ["http://h/x", "http://o/y"]
    for broken in ("", None, "<<<>>><p", "</div></div>", "<a href='http://[bad'>x</a>", "<p>" * 2000):
        html.page_text(broken), html.plain_text(broken), html.links(broken, "http://h/")


CUT = "<article><h1>a&amp;b &amp</h1><p>&quot;c&quot &am &copy; &copyx; &#38 &ampx; <a href='/p?a=1&copy=2'>d</a></p></article>"
KEPT = 'a&b &amp\n"c&quot &am © &copyx; & &ampx;\nd'


def test_references_without_semicolon(spark):
    rows = spark.createDataFrame([(1, "http://h/", CUT)], "page_id long, url string, html string")
    assert crawl.corpus(rows).first().text == " ".join(KEPT.split())
    assert html.links(CUT, "http://h/") == ["http://h/p?a=1&copy=2"]


def test_references_without_semicolon_auto():
    assert html.page_text(f"<div>{CUT}</div>", "auto") == KEPT


def test_references_without_semicolon_news():
    assert html.page_text(f"<div>no</div>{CUT}", "news") == KEPT


def test_references_without_semicolon_novel():
    assert html.page_text(f"no<div class='chapter-content'>{CUT}</div>", "novel") == KEPT


def test_references_without_semicolon_wiki():
    assert html.page_text(f"no<div class='wiki'>{CUT}</div>", "wiki") == KEPT


def test_references_without_semicolon_plain():
    assert html.plain_text(CUT).split("\n") == ["a&b &amp", "", '"c&quot &am © &copyx; & &ampx;d']
    assert html.plain_text("<p>a &amp</p>", strict=True) == "a &"


def test_urls(spark):
    assert apply(spark, urls.is_valid, "http://a/x", "ftp://a/x", "http://a/p.JPG", "http://a/stage/advantage", "http://a/login", "HTTPS://a/b", None) == [True, False, False, False, False, True, None]
    assert apply(spark, urls.title, "<title> A &amp; B - site | x</title>", "<meta property='og:title' content='O'><title>T</title>", "none") == ["A & B", "O", ""]
    assert apply(spark, urls.domain, "http://u@h:80/p?q", "x") == ["u@h:80", ""]


def test_dedup_families(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, ""), (4, None), (5, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_copies) for r in dedup.exact(docs).collect()} == {(0, 2), (1, 1), (3, 1), (4, 2)}
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(["a", "b", "a", "c", "a", "b"])], "doc_id int, line_no int, line string")
    keep = lambda k: [r.line_no for r in dedup.lines_over_threshold(rows, k).orderBy("line_no").collect()]
    assert keep(3) == [0, 1, 3, 5] and keep(2) == [0, 1, 3] and keep(1) == [0, 1, 3]


def test_greedy_near_dedup_keeps_the_ends_of_a_chain(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a_id long, b_id long")
    assert {r.doc_id for r in dedup.greedy_removed(pairs).collect()} == {1, 3, 6}
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(["x", *base[1:]]), " ".join(["x", *base[1:-1], "y"]), "a b", "a b", " ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    kept = []
    for i, s in enumerate(sets):
        if not any(s and sets[k] and len(s & sets[k]) / len(s | sets[k]) > 0.8 for k in kept):
            kept.append(i)
    assert sorted(r.doc_id for r in dedup.near(docs).collect()) == kept


def test_near_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    texts = []
    for _ in range(30):
        w = [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(6, 60))]
        texts.append(" ".join(w))
        for _ in range(2):
            w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    want = {(i, j) for i in first.values() for j in first.values() if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.8}
    assert {(r.a_id, r.b_id) for r in dedup.near_pairs(docs).collect()} == want and want


def test_clean_corpus_on_own_text(spark):
    good = "这是一个很好的句子，内容完整，我们都喜欢。"
    lines = [good, "", "  " + good + "  ", good, "https://a.example/x", "ISBN 978-7", "请联系 a@b.com 或者 13812345678，这是我们的地址。", "!!!!!!!!!!!!"]
    docs = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(lines)), (None, good), (2, "")], "doc_id long, text string")
    rows = cleaning.clean_corpus(docs).collect()
    assert [r.doc_id for r in rows] == [0]
    kept = rows[0].cleaned.split("\n")
    # the third of equal lines makes them repeats: the first place stays
    assert kept[0] == good and kept.count(good) == 1 and rows[0].dedup_filtered == 2
    assert "<EMAIL>" in kept[1] and "13812345678" not in rows[0].cleaned and rows[0].pii_count >= 2
    assert rows[0].line_count == len(kept) and not any("ISBN" in x or "http" in x for x in kept)


def test_store(spark, tmp_path):
    db = store.Store(spark, f"file://{tmp_path}/db")
    row = lambda path, n, run="r1": (path, "m" + path, n, run)
    frame = lambda *rows: spark.createDataFrame(rows, "original_file_path string, original_md5 string, line_count long, run_id string")
    db.upsert("cleaned_documents", frame(row("a", 5), row("b", 5), row("c", 5)))
    db.upsert("cleaned_documents", frame(row("b", 7), row("d", 1, "r2")))
    got = {r.original_file_path: (r.id, r.line_count) for r in db.read("cleaned_documents").collect()}
    assert {k: v[1] for k, v in got.items()} == {"a": 5, "b": 7, "c": 5, "d": 1} and sorted(v[0] for v in got.values()) == [1, 2, 3, 4]
    db.upsert("cleaning_runs", spark.createDataFrame([("r1",), ("r3",)], "run_id string"))
    db.finish_run("r1", F.timestamp_seconds(F.lit(0)))
    runs = {r.run_id: r for r in db.read("cleaning_runs").collect()}
    assert (runs["r1"].success_count, runs["r1"].total_output_lines, runs["r3"].success_count) == (3, 17, None) and runs["r1"].finished_at
    assert [r.run_id for r in store.active_runs(db.read("cleaning_runs")).collect()] == ["r3"]
    db.delete_run("r1")
    assert [r.original_file_path for r in db.read("cleaned_documents").collect()] == ["d"] and db.read("cleaning_runs").count() == 1
    assert store.stats(db.read("crawler_pages").selectExpr("1L original_size", "1L cleaned_size", "1L line_count", "1L pii_count")).first().total_lines == 0
    files = spark.createDataFrame([("x", "md"), ("y", "new"), ("z", "")], "name string, md5 string")
    assert {r.name for r in store.unprocessed(files, db.read("cleaned_documents")).collect()} == {"y", "z"}


@pytest.mark.parametrize("n,length", [(0, 8), (3, 8), (8, 8), (9, 8), (30, 8), (30, 7), (31, 2)])
def test_pack_windows(spark, n, length):
    ids = list(range(100, 100 + n))
    rows = spark.createDataFrame([(i // 5, i % 5, ids[4 * i : 4 * i + 4]) for i in range(-(-n // 4))], "doc_id long, line_no int, tokens array<int>")
    want, at = [], 0
    while n:
        want.append((ids[at : at + length] + [1] * length)[:length])
        if n - at < length:
            break
        at += length // 2
    got = [list(r.ids) for r in tokens.pack_windows(rows, length, F.lit(1)).orderBy("window").collect()]
    assert got == want
    assert spark.range(1).select(tokens.window_count(F.lit(n), length)).first()[0] == len(want)


def test_batches_and_chunks(spark):
    rows = spark.createDataFrame(list(enumerate([50, 10, 30, 20, 40])), "idx long, length long")
    got = {r.idx: r.batch for r in tokens.dynamic_batches(rows, 100, 32).collect()}
    assert got == {1: 0, 3: 0, 2: 0, 4: 1, 0: 1}
    assert {r.idx for r in tokens.dynamic_batches(rows, 100, 32, drop_last=True).collect()} == {1, 2, 3}
    sizes = spark.createDataFrame([(0, i, n) for i, n in enumerate([4, 4, 20, 1, 9])], "g long, i long, n long")
    assert [r.chunk for r in tokens.greedy_chunks(sizes, 10, 1, "g", "i", "n").orderBy("i").collect()] == [0, 0, 1, 2, 3]
    docs = spark.createDataFrame([(0, "aaaa\n\nbbbb\n\ncccc\n\ndd")], "doc_id long, text string")
    assert [r.content for r in tokens.split_paragraphs(docs, 10, 3).orderBy("part").collect()] == ["aaaa\n\nbbbb", "bbb\n\ncccc", "ccc\n\ndd"]


def test_collate(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3, 4, 5], [9] * 5), (0, [6, 7, 8], [9] * 3), (1, list(range(12)), [9] * 12)], "b int, ids array<int>, labels array<int>")
    got = tokens.collate(rows, "b", labels="labels", max_length=10).orderBy("b", F.desc(F.size("ids"))).collect()
    assert [len(r.out_ids) for r in got] == [5, 5, 10] and got[1].out_ids == [6, 7, 8, 1, 1] and got[1].out_labels == [9, 9, 9, -100, -100] and got[1].mask == [1, 1, 1, 0, 0]


def test_instruction_rows(spark):
    rows = spark.createDataFrame([("Do", "", "x"), ("Do", "in", "x"), ("Do", None, "")], "instruction string, input string, output string")
    asked, full = sft.prompt("alpaca")
    got = rows.select(asked, full).collect()
    assert got[0][0] == "### Instruction:\nDo\n\n### Response:\n" and got[1][1] == "### Instruction:\nDo\n\n### Input:\nin\n\n### Response:\nx"
    chat = rows.select(*sft.prompt("chat")).collect()
    assert chat[0][0] == "<|user|>\nDo\n<|assistant|>\n" and chat[2][0] == ""
    ids, labels = sft.labels(F.array(*map(F.lit, range(5))), F.array(F.lit("a"), F.lit("b")), 4)
    assert tuple(map(list, spark.range(1).select(ids, labels).first())) == ([0, 1, 2, 3], [-100, -100, 2, 3])


def test_incremental(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "name string, hash string")
    now, then = frame({"a": "1", "b": "2", "c": "3"}), frame({"b": "2", "c": "x", "d": "4"})
    changes = incremental.file_changes(now, then)
    assert dict(map(tuple, changes.collect())) == {"a": "new", "b": "unchanged", "c": "modified", "d": "deleted"}
    assert {r.name: (r.hash, r.status) for r in incremental.next_manifest(then, changes, now).collect()} == {"a": ("1", "active"), "b": ("2", "active"), "c": ("3", "active"), "d": ("4", "orphaned")}
    assert incremental.policy(101) == "retrain" and incremental.policy(101, "frozen") == "keep" and incremental.policy(0, "retrain") == "retrain"
    rows = spark.createDataFrame([("f", i, f"l{i}") for i in range(20)] + [("g", 0, "x")], "file string, line_no int, line string")
    assert incremental.sample_lines(rows, 5).count() == 6


def test_metrics(spark):
    rows = spark.createDataFrame([("the cat sat on", "the cat sat on")], "candidate string, reference string").withColumn("id", F.lit(1))
    assert [round(r.score, 6) for r in metrics.bleu(rows).orderBy("n").collect()] == [1.0] * 4
    x = F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0))
    got = spark.range(1).select(metrics.top_indexes(x, 2), metrics.nucleus(metrics.softmax(x), 0.5), metrics.cross_entropy(x, F.lit(-100))).first()
    assert (list(got[0]), list(got[1]), got[2]) == ([1, 2], [1], None)


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/b.txt").write_text("x\r\n\r\ny")
    (tmp_path / "t/A.TXT").write_text("z\n")
    folder = f"file://{tmp_path}/t"
    files = readers.text_files(spark, folder)
    assert sorted(r.name for r in files.collect()) == ["A.TXT", "b.txt"] and readers.text_files(spark, folder, any_case=False).count() == 1
    assert sorted((r.line_no, r.line) for r in readers.file_lines(files).collect()) == [(0, "x"), (0, "z"), (2, "y")]
    (tmp_path / "c.csv").write_text("﻿name,age\nAnn,3\n , \nBob,\n", encoding="utf-8")
    assert sorted(r.text for r in readers.csv_text(spark, f"file://{tmp_path}/c.csv").collect()) == ["name: Ann\nage: 3", "name: Bob"]
    spark.createDataFrame([("a", None), ("", "b")], "x string, y string").write.parquet(f"file://{tmp_path}/p")
    assert sorted(r.text for r in readers.parquet_text(spark, f"file://{tmp_path}/p").collect()) == ["x: a", "y: b"]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "j.json").write_text(json.dumps({"a": " x ", "b": {"c": True, "d": None, "e": [1, "s", {"f": 2}]}}))
    (docs / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (docs / "bad.json").write_text("{")
    (docs / "h.HTML").write_text("<p>hi</p>")
    with zipfile.ZipFile(docs / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", "<container xmlns='urn:c'><rootfiles><rootfile full-path='o/c.opf'/></rootfiles></container>")
        z.writestr("o/c.opf", "<package xmlns='urn:p' xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata><dc:title>Book</dc:title></metadata><manifest><item id='2' href='b.html' media-type='text/html'/><item id='1' href='a.html' media-type='text/html'/></manifest><spine><itemref idref='1'/><itemref idref='2'/></spine></package>")
        z.writestr("o/a.html", "<p>one</p>")
        z.writestr("o/b.html", "<p>two</p>")
    got = {r.name: (r.text, bool(r.error)) for r in readers.documents(spark, f"file://{docs}").collect()}
    assert got["j.json"][0] == "a: x\nb. c: True\nb. e: s\nb. e. f: 2" and got["l.json"][0] == "--- 记录 1 ---\na: 1\n\n--- 记录 2 ---\na: 2"
    assert got["bad.json"] == (None, True) and got["h.HTML"][0] == "hi" and got["b.epub"][0] == "Book\n\none\n\ntwo"
    (tmp_path / "q.jsonl").write_text('{"title": "t", "answer": "a"}\n{bad\n\n{"title": " ", "answer": "x"}\n')
    rows = sft.qa_to_sft(readers.questions(spark, f"file://{tmp_path}/q.jsonl")).collect()
    assert [(r.instruction, r.input, r.output) for r in rows] == [("t", "", "a")]
    with pytest.raises(ValueError):
        readers.instructions(spark, "x.csv")
    writers.write_shards(spark.createDataFrame([("train", i // 2, i) for i in range(4)], "split string, shard int, x int"), f"file://{tmp_path}/s", {"length": "8"})
    assert readers.shards(spark, f"file://{tmp_path}/s", expect={"length": "8"}).count() == 4
    with pytest.raises(ValueError):
        readers.shards(spark, f"file://{tmp_path}/s", expect={"length": "9"})
    names = writers.export_names(spark.createDataFrame([(1, "a/x.txt"), (2, "b/x.txt"), (3, None)], "id long, original_file_path string"))
    assert {r.id: r.name for r in names.collect()} == {1: "x.txt", 2: "x_1.txt", 3: "doc_3.txt"}


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert dict(map(tuple, crawl.frontier(edges, seeds, 2).collect())) == {"a": 0, "b": 1, "c": 2}
    pages = spark.createDataFrame([(2, "http://h/2", "<p>same text</p>"), (1, "http://h/1", "<title>T</title><p>same text</p>"), (3, "http://h/3", "")], "page_id long, url string, html string")
    rows = crawl.corpus(pages).collect()
    assert [(r.page_id, r.domain, len(r.id)) for r in rows if r.text == "same text"] == [(2, "h", 16)]


def test_streams_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("第一行，很好的句子。\n\n第一行，很好的句子。\nISBN 123\n")
    lines = jobs.read_lines(spark, f"file://{src}")
    q = jobs.first_lines(jobs.clean(lines).select("line")).writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.line for r in spark.table("cleaned").collect()] == ["第一行，很好的句子。"]
    events = spark.createDataFrame([(u, i, f"2024-01-01 00:00:{s:02d}") for i, (u, s) in enumerate([(1, 0), (1, 0), (1, 1), (1, 2), (2, 5), (1, 20)])], "user_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch = {r.event_id: r.allowed for r in jobs.rate_limit(events, 10.0, 2).collect()}
    assert batch == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True}
    events.write.parquet(path := f"file://{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = jobs.rate_limit_stream(stream, 10.0, 2).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == batch
