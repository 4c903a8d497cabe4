"""Each registered query of the training-data operators on the smallest tables: its columns, its contract, and SQL where there is some."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, bpe, chat, line_dedup, media_ts, packing, pii, queries, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
Q = queries.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name, *columns):
    found = Q[name](spark, SF)
    assert found.columns[: len(columns)] == list(columns)
    return found.collect()


def test_op1(spark, texts):
    found = rows(spark, "op1_toxicity", "doc_id", "held_out", "score", "predicted")
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(texts)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert all(texts[r.doc_id][s.start : s.end].strip() for s in r.spans)


def test_op2(spark):
    found = rows(spark, "op2_url_filter", "page_id", "host", "path", "rule", "verdict")
    assert len(found) == spark.read.parquet(f"{SF}/pages.parquet").count() and {r.verdict for r in found} <= {"allow", "block"}
    for r in found:
        if r.rule is None:
            assert r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_op3(spark, texts):
    found = rows(spark, "op3_simhash", "doc_id", "fingerprint", "component_id")
    prints = {r.doc_id: int(r.fingerprint, 16) for r in found}
    assert all(len(r.fingerprint) == 16 for r in found) and prints == {k: simhash.fingerprint(t)[0] for k, t in texts.items()}
    root = {k: k for k in prints}
    while True:
        new = {a: min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3) for a in prints}
        if new == root:
            break
        root = new
    assert {r.doc_id: r.component_id for r in found} == root


def test_op4(spark, texts):
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in rows(spark, "op4_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"):
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_op5(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    found = rows(spark, "op5_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    by = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0) and r.offset + r.length <= 4096
        by[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 for s, n in by.items() if s != max(by))
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in own)


def test_op7(spark, texts):
    found = rows(spark, "op7_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert len(found) == len(texts)
    for r in found:
        base = pii.base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]


def test_op9(spark, texts):
    for r in rows(spark, "op9_media", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"):
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.breaks == 0 and r.media_bytes % 188 == 0 and r.media_sha256 == hashlib.sha256(media_ts.mux(payload)).hexdigest()


def test_op10(spark):
    found = rows(spark, "op10_ann", "query_id", "rank", "vec_id", "score")
    x = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    hits = total = 0
    for q in (k for k in x if k % 50 == 0):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        cosine = {k: float(v @ x[q] / (np.linalg.norm(v) * np.linalg.norm(x[q]))) for k, v in x.items() if k != q}
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - cosine[r.vec_id]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(sorted(cosine, key=lambda k: (-cosine[k], k))[:5]))
        total += 5
    assert hits >= 0.9 * total


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = Q[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    listed = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert listed(a) == listed(b)


def test_pipeline_query(spark, texts):
    found = Q["pipeline"](spark, SF)
    assert found.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 0 < found.select("doc_id").distinct().count() < len(texts)


CLASH = ["_cut", "_cut_id", "_cut_hash", "_whole", "_text_hash", "_toxicity", "_kept", "_of", "_t0", "_rule", "_t", "_salt", "_salts", "node", "salt", "root", "group", "part", "first", "line", "run", "rows", "n", "key", "u", "v", "low", "f0", "whole", "anchor", "member", "block", "bucket", "deal", "score", "wanted", "file", "asked", "rank", "component_id", "Kind"]


def test_clashing_names(spark):
    """Columns named like the operators' own change nothing and pass where columns pass."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    odd = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))
    listed = lambda f: sorted(map(str, f.collect()))
    model = toxicity.train(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    vocabulary = __import__("public_tokenizers")
    for run in (
        lambda d: simhash.near_duplicates(d),
        lambda d: simhash.similar_documents(d),
        lambda d: bpe.encode_decode(d, vocabulary.path("byte_bpe_multi_50k.tiktoken"), vocabulary.PATTERN),
        lambda d: pii.digest(d, pii.fit([])),
        lambda d: media_ts.media_column(d),
        lambda d: line_dedup.dedup(d).select("doc_id", "text"),
        lambda d: toxicity.score(d, model, to="own").select("doc_id", "own.score"),
    ):
        assert listed(run(odd)) == listed(run(docs))
    assert packing.pack(odd, vocabulary.path("word_bpe_49k.json")).agg(F.sum("length")).first() == packing.pack(docs, vocabulary.path("word_bpe_49k.json")).agg(F.sum("length")).first()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        extra = out.select(*CLASH).distinct().collect()
        assert [tuple(r) for r in extra] == [tuple(range(len(CLASH)))], name
        plain = stage(spark, docs, SF)
        assert listed(out.select("doc_id", "text")) == listed(plain), name
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    own = [c for c in CLASH if c.lower() not in url_filter.ADDED]
    judged = url_filter.judge(pages.select("*", *(F.lit(1).alias(c) for c in own)), url_filter.fit([]))
    assert listed(judged.select("page_id", "verdict")) == listed(url_filter.judge(pages, url_filter.fit([])).select("page_id", "verdict"))
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    with_more = vectors.select("*", *(F.lit(1).alias(c) for c in CLASH))
    assert listed(ann.search(with_more, with_more.where("vec_id < 3"))) == listed(ann.search(vectors, vectors.where("vec_id < 3")))
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = turns.select("*", *(F.lit(1).alias(c) for c in CLASH))
    assert listed(chat.digest(chat.format_conversations(more))) == listed(chat.digest(chat.format_conversations(turns)))


def test_results_do_not_depend_on_partitions(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    listed = lambda f: sorted(map(str, f.collect()))
    assert listed(ann.search(vectors.repartition(7), vectors.where("vec_id % 50 = 0"))) == listed(ann.search(vectors.coalesce(1), vectors.where("vec_id % 50 = 0")))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert listed(line_dedup.dedup(docs.repartition(7))) == listed(line_dedup.dedup(docs.coalesce(1)))
    assert listed(simhash.similar_documents(docs.repartition(7))) == listed(simhash.similar_documents(docs.coalesce(1)))
