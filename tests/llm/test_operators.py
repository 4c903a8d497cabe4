"""The training-data operators against brute force, round trips and held-out labels; edge cases of their tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, bpe, chat, line_dedup, media_ts, packing, pii, simhash, toxicity, url_filter
from corpusloom.llm.common import drawn
from corpusloom.llm.components import spanning_forest

public_tokenizers = pytest.importorskip("public_tokenizers")

WORDS = "the of and stone river light carry under bright field was north idiot over house green paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(30)]
    near = [" ".join(w if i != 7 else "changed" for i, w in enumerate(b.split())) for b in base[:8]]
    return [*base, *near, *base[:5], "", None, "x", "a b", "a b", "é漢字😀 \x1c\x85 end", "word " * 30_000, "z" * 20_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 1.0, "en") for i, t in enumerate(texts)]
    rows += [(None, "no id here", 2.0, None), (3, texts[3], 1.0, "en")]
    # extra columns with names that the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, score double, component_id string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# SimHash -------------------------------------------------------------------------------


def plain_fingerprint(text, words=3, seed=42):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints, most):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= most:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprint_matches_definition(texts):
    for t in texts[:45]:
        assert simhash.fingerprint(t, 3, 1) == [plain_fingerprint(t)]
        assert simhash.fingerprint(t, 5, 2) == [plain_fingerprint(t, 5, 42), plain_fingerprint(t, 5, 43)]


@pytest.mark.parametrize("layout", [simhash.NARROW, simhash.WIDE, simhash.wide(1 << 25)])
def test_anchors_are_all_code_words_in_reach(layout):
    block = np.random.default_rng(1).integers(0, 1 << layout.width, 20)
    index, anchor = simhash.anchors_of(block, layout)
    for k, b in enumerate(block.tolist()):
        want = set()
        for r in range(layout.reach + 2):
            for flips in itertools.combinations(range(layout.width), r):
                x = b
                for f in flips:
                    x ^= 1 << f
                if not simhash._syndrome(np.array([x & (1 << layout.code) - 1]), layout.code)[0]:
                    want.add(x)
        assert sorted(anchor[index == k].tolist()) == sorted(want)


def _prints(spark, values):
    return spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) * 2 for x in values], "node long, f0 long")


@pytest.mark.parametrize("hot", [False, True])
def test_links_are_exact(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(simhash, "HOT_HOMES", 3)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:20]:
        for _ in range(12):
            x = v
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    centre = rng.getrandbits(64)
    values |= {centre ^ 1 << k for k in range(30)}
    want = plain_components(sorted(values), 3)
    found = simhash.components(simhash.links(_prints(spark, sorted(values)), simhash.NARROW)).collect()
    got = {x: x for x in values}
    for node, root in found:
        got[node % (1 << 64)] = root % (1 << 64)
    classes = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert classes(got) == classes(want)


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 999), (1000, 998)], "u long, v long").repartition(7)
    found = dict(tuple(r) for r in simhash.components(edges).collect())
    assert found == {**{i: 0 for i in range(1, n + 1)}, 999: 998, 1000: 998}


def test_components_in_rounds(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 999), (1000, 998)], "u long, v long").repartition(7)
    assert sorted(map(tuple, simhash.components(edges, few=0).collect())) == sorted(map(tuple, simhash.components(edges).collect()))
    assert not simhash.components(edges.limit(0), few=0).collect() and not simhash.components(edges.limit(0)).collect()


def test_components_of_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "u long, v long").repartition(7)
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        assert len(simhash.components(edges).collect()) == 300
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) < 10
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_near_duplicates_whole(docs, texts):
    found = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    prints = {plain_fingerprint(r.text) for r in rows}
    root = plain_components(sorted(prints), 3)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            c = root[plain_fingerprint(r.text)]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), plain_fingerprint(r.text), str(least.get(root[plain_fingerprint(r.text)]))) for r in rows)
    assert sorted((str(r.doc_id), r.f0 % (1 << 64), str(r.component_id)) for r in found) == want


def test_spanning_forest_is_least():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (2, 1), (30, 200), (200, 150)):
        u, v, w = rng.integers(0, max(n, 1), m), rng.integers(0, max(n, 1), m), rng.integers(0, 9, m)
        u, v, w = u[u != v], v[u != v], w[u != v]
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        want = []
        for d, a, b in sorted(zip(w.tolist(), np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True)):
            if find(a) != find(b):
                root[find(a)] = find(b)
                want.append((d, a, b))
        a, b, d = spanning_forest(u, v, w)
        assert sorted(zip(d.tolist(), a.tolist(), b.tolist(), strict=True)) == sorted(want)


def test_similar_documents_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for copy in range(5):
            own = list(words)
            for at in rng.choice(150, [0, 1, 2, 6, 14][copy], replace=False):
                own[at] = f"x{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(own)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "one two"), (0, rows[0][1]), (0, "another text under the same number"), (None, rows[3][1])]
    sets = [(k, simhash.shingle_set(t, 5).tobytes()) for k, t in rows if k is not None]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (k, a) in enumerate(sets):
        for j, b in sets[:i]:
            if simhash.jaccard(a, b) >= 0.8:
                x, y = sorted((find(k), find(j)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(3)
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect()} == {(k, find(k)) for k in root}
    assert simhash.similar_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 1000])
def test_candidates_outside_the_forest_are_checked(spark, n):
    # each copy is similar to the first text, two copies seldom are, and some copies' prints are nearer to each other
    rng = np.random.default_rng(n)
    words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    texts = [" ".join(words)]
    for _ in range(n):
        own = list(words)
        for at in rng.choice(300, 6, replace=False):
            own[at] = f"x{rng.integers(0, 5000)}"
        texts.append(" ".join(own))
    sets = [simhash.shingle_set(t, 5).tobytes() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r[0]: np.array(r[1:-1]).view(np.uint64) for r in simhash.set_fingerprints(docs, 5, simhash.WIDE).collect()}
    apart = {k: int(np.bitwise_count(prints[0] ^ prints[k]).sum()) for k in range(1, n + 1)}
    want = {k for k in apart if simhash.jaccard(sets[0], sets[k]) >= 0.8 and apart[k] <= 39}
    assert len(want) > 0.4 * n
    for parts in (1, 5):
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs.repartition(parts)).collect()}
        assert {k for k in want if found[k] != 0} == set()


def test_repeated_words_do_not_hide_what_differs(spark):
    rng = random.Random(4)
    fill = " fill" * 60
    rows = [(k, prose(rng, 50) + fill) for k in range(20)]  # mostly one shingle, else nothing in common
    line = prose(rng, 12)
    text = prose(rng, 100) + " " + line
    rows += [(100, f"{text} {line}"), (101, text + f" {line}" * 40)]  # one set of shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert found == {**{k: k for k in range(20)}, 100: 100, 101: 100}


def test_wide_layout_finds_similar_texts(spark):
    rng = random.Random(9)
    rows, n = [], 40
    for i in range(n):
        w = prose(rng, 300).split()
        rows.append((i, " ".join(w)))
        for _ in range(3):  # about 0.85 of the five-word shingles stay
            w[rng.randrange(300)] = "other"
        rows.append((i + n, " ".join(w)))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, simhash.WIDE).collect()}
    assert found == {i: i % n for i in range(2 * n)}


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert bpe.encode_decode(empty, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert media_ts.media_column(empty).count() == 0
    assert line_dedup.dedup(empty).count() == 0
    assert pii.digest(empty, pii.train(empty)).count() == 0
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, model).count() == 0
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(none, none).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.train(url_filter.labelled_table(spark).limit(0))).count() == 0


# Tokens --------------------------------------------------------------------------------


def test_bpe_matches_tiktoken(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), ids))
    for block in (1 << 23, 50):
        found = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True, block_tokens=block).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in found) == sorted(want)


def test_ranks_round_trip():
    edges = [0, bpe._ONE - 1, bpe._ONE, bpe._TWO - 1, bpe._TWO, bpe._THREE - 1, bpe._THREE, (1 << 32) - 1]
    rng = np.random.default_rng(0)
    for values in (edges, [], [5], rng.integers(0, 1 << 32, 1000).tolist(), (rng.zipf(1.3, 5000) % (1 << 22)).tolist()):
        assert bpe._from_ranks(bpe._ranks(np.array(values, dtype=np.uint32))).tolist() == list(values)


def test_pre_tokens_match_the_pattern():
    import regex

    rx, plain = regex.compile(public_tokenizers.PATTERN), bpe.PreTokens(public_tokenizers.PATTERN)
    rng = random.Random(1)
    marks = "ab é\n\t  ,.'st1²\x1c\x85\xa0漢字😀́_-ΣσªºK"
    for _ in range(3000):
        t = "".join(rng.choice(marks) for _ in range(rng.randint(0, 25)))
        assert plain(t) == [m.group() for m in rx.finditer(t)]
    for c in map(chr, range(0x250)):
        for t in (f"a{c}b", f" {c} ", f"{c}{c} x", f"'{c}ll"):
            assert plain(t) == [m.group() for m in rx.finditer(t)]


def test_word_encoder_matches_the_tokenizer():
    import pyarrow as pa

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), pieces=500)
    rng = random.Random(2)
    marks = "ab é\n\t  ,.'st1²\x1c\x85\xa0漢字😀́_-ΣσªºKAZÀİ<|endoftext|>"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [f"a{chr(c)}b C{chr(c)}, {chr(c)}. d" for c in range(0x400)] + ["it's, he'll. 'S x.y, a.,  b ... ,, end.\nnew,\nline", ""]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_all(pa.array(texts)) == want


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs.repartition(3), path, length=64, with_ids=True).collect()
    spots = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for s, o, n in spots:  # gapless, and every window but the last is full
        assert s * 64 + o == at
        at += n
    assert all(p.sequence_tokens == 64 for p in pieces if p.sequence_id < spots[-1][0])
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) and len(p.ids) == p.length
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        by_doc.setdefault(p.doc_id, []).append(p)
    for r in docs.where("doc_id is not null and doc_id != 3").collect():
        own = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        ids = [x for p in own for x in p.ids]
        assert ids == [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] and {p.doc_tokens for p in own} == {len(ids)}
        assert [p.start for p in own] == list(itertools.accumulate([0, *(p.length for p in own[:-1])]))
    assert sum(p.length for p in by_doc[3]) == 2 * by_doc[3][0].doc_tokens  # the repeated row is packed twice


# Lines ---------------------------------------------------------------------------------


def plain_align(a, b, depth=0):
    """Pairs of places that a patience diff of two lists matches, by definition: quadratic chains on copies of the lists."""
    out, head = [], 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out.append((head, head))
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
        out.append((len(a) - tail, len(b) - tail))
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y and depth < line_dedup.DEPTH:
        anchors = [(i, y.index(v)) for i, v in enumerate(x) if x.count(v) == 1 == y.count(v)]
        if not anchors:
            nth = lambda z: {(v, z[:i].count(v)): i for i, v in enumerate(z)}
            anchors = sorted((i, nth(y)[k]) for k, i in nth(x).items() if k in nth(y))
        size, back = [], []
        for k, (_, j) in enumerate(anchors):
            size.append(1 + max((size[p] for p in range(k) if anchors[p][1] < j), default=0))
            back.append(max((p for p in range(k) if size[p] == size[k] - 1), default=-1) if size[k] > 1 else -1)
        chain, k = [], max((k for k in range(len(anchors)) if size[k] == max(size)), default=-1)
        while k >= 0:
            chain.insert(0, anchors[k])
            k = back[k]
        out += [(i + head, j + head) for i, j in chain]
        if chain:
            for (i, j), (m, n) in zip([(-1, -1), *chain], [*chain, (len(x), len(y))], strict=True):
                out += [(p + i + 1 + head, q + j + 1 + head) for p, q in plain_align(x[i + 1 : m], y[j + 1 : n], depth + 1)]
    return sorted(out)


def plain_blocks(a, b):
    pairs, out = plain_align(a, b), []
    for i, j in pairs:
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def plain_line_dedup(rows, min_words):
    """Every document aligned with every earlier one."""
    out, before = {}, []
    for doc_id, text in sorted(rows):
        raw = text.split("\n")
        full = [i for i, x in enumerate(raw) if x.strip()]
        lines, gone = [raw[i].strip() for i in full], set()
        if text in [t for _, t in before] and sum(len(x.split()) for x in lines) >= min_words:
            out[doc_id] = ""
            continue
        for other, _ in before:
            for i, _, n in plain_blocks(lines, other):
                if sum(len(x.split()) for x in lines[i : i + n]) >= min_words:
                    gone |= set(range(full[i], full[i + n - 1] + 1))
        before.append((lines, text))
        rest = [x for i, x in enumerate(raw) if i not in gone]
        out[doc_id] = ("\n".join(rest) if any(x.strip() for x in rest) else "") if gone else text
    return out


def test_alignment_against_definition():
    rng = random.Random(2)
    for _ in range(3000):
        pool = range(rng.choice((3, 8, 30)))
        a, b = ([rng.choice(pool) for _ in range(rng.randint(0, 14))] for _ in "ab")
        got = line_dedup.aligned(a, b)
        assert got == plain_blocks(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in itertools.pairwise(got))
    long = list(range(100_000))
    assert line_dedup.aligned(long, long[1:]) == [(1, 0, 99_999)]
    assert line_dedup.aligned([7] * 50_000, [7] * 20_000 + [8]) == [(0, 0, 20_000)]


def _lines_of(rng, n, words=6):
    return [prose(rng, words) for _ in range(n)]


def test_line_dedup_against_all_alignments(spark):
    rng = random.Random(11)
    pool, rows = [prose(rng, rng.randint(1, 9)) for _ in range(300)] + ["", "  "], []
    for i in range(60):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        for _ in range(2 if i % 3 == 0 and rows else 0):
            other = rows[rng.randrange(len(rows))][1].split("\n")
            a = rng.randrange(len(other))
            at = rng.randint(0, len(text))
            text[at:at] = other[a : a + 6]
        rows.append((i, "\n".join(text)))
    rows += [(70 + k, rows[k][1]) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_line_dedup(rows, 12)
    assert sum(want[i] != t for i, t in rows) > 10
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs, min_words=12, rare=1000).collect()} == want


def test_crossed_and_repeated_blocks_stay(spark):
    rng = random.Random(12)
    p, q, a, b, c = (_lines_of(rng, n) for n in (10, 12, 3, 3, 3))
    rows = [(1, [*a, *p, *b, *q]), (2, [*c, *q, "between", *p]), (3, [*p, "x", *p, "y"])]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    found = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(docs).collect()}
    assert found[1] == rows[0][1]
    # the plain union of common blocks would take both; the diff holds one order, and the longer block is in it
    assert found[2] == [*c, "between", *p]
    # p is once in each earlier text, so one of two goes
    assert found[3] == ["x", *p, "y"] or found[3] == [*p, "x", "y"]


def test_frequent_passages_are_found(spark):
    rng = random.Random(13)
    passage = _lines_of(rng, 12)
    rows = [(i, [*_lines_of(rng, i % 5), *passage, *_lines_of(rng, 3)]) for i in range(80)]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string").repartition(7)
    for rare in (1, line_dedup.RARE, 1000):
        found = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(docs, rare=rare).collect()}
        assert found == {i: t if i == 0 else [x for x in t if x not in passage] for i, t in rows}


def test_line_dedup_edges(spark, docs):
    out = line_dedup.dedup(docs, min_words=20, whole="before")
    assert out.columns == [*docs.columns, "before"] and out.count() == docs.count()
    got = {(r.doc_id, r.before): r.text for r in out.collect()}
    assert got[None, "no id here"] == "no id here"
    assert any(whole is None and text is None for (_, whole), text in got.items())
    assert line_dedup.dedup(docs).columns == docs.columns


# Personal data -------------------------------------------------------------------------

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), k == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15]
            if good[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(2)
    for _ in range(30_000):
        t = "".join(rng.choice("a1@.+- (29%") for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(t) == plain_spans(t)


def test_base_spans_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000, "1 " * 100_000):
        assert pii.base_spans(t) == [] or t.startswith("1.")


def test_field_adds_mentions_that_the_patterns_miss(spark):
    rng = random.Random(4)

    def card():
        while True:
            c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if pii.luhn(c):
                return c

    train = [f"{prose(rng, 20)} {card()} {prose(rng, 5)} mail{i}@example.com word 10.1.{i % 200}.7 end" for i in range(120)]
    model = pii.fit(train)
    c = card()
    text = f"pay {c} now and later {c} 27.65.93.188 done"
    (base, whole), = pii.tag([text], model)
    assert set(base) <= set(whole) and base == plain_spans(text)
    second = text.index(c, 10)
    assert (second, 2, second + 16) in whole and (second, 2, second + 16) not in base
    assert pii.redacted(text, whole).startswith("pay <CARD> now and later <CARD>")
    assert pii.tag(["", "no data at all", "in 2021 there were 12 of 300"], model)[1:] == [([], []), ([], [])]


@pytest.mark.parametrize("before", [0, 20])
def test_one_observed_mention_reaches_all_others(before):
    card = next(c for c in (f"4{k:015d}" for k in range(10**6, 10**7)) if pii.luhn(c) and not pii.luhn(c + "27"))
    hidden = f"then {card} 27 words "  # the digits run on, so the pattern misses it
    text = hidden * before + f"pay {card} now and " + hidden * 20
    base = pii.base_spans(text)
    assert len(base) == 1
    k = len(pii.KINDS) + 1
    pairs = np.zeros((2, k, k))
    pairs[1] = -4 * (1 - np.eye(k))
    weights = np.zeros((pii.SHAPES, k))
    weights[zlib.crc32(b"bias") % pii.SHAPES] = [1.0, -9.0, -9.0, 0.0, -9.0]  # odds against a card
    model = pii.Field(weights, pairs)
    g = pii.graph([text], [base])
    assert len(g.edges) < 5 * len(g.doc)
    p = model.marginals(g)
    cards = [n for n, (a, b) in enumerate(g.span) if text[a:b] == card]
    assert len(cards) == before + 21 and (p[cards, 3] >= pii.SURE).all()
    assert abs(p - model.marginals(g, 4000)).max() < 1e-3
    # a document's result does not depend on those beside it
    both = pii.graph(["7 of 12", text], [[], base])
    assert abs(model.marginals(both)[-len(p) :] - p).max() < 1e-9


def _exact(g, model, given):
    """Marginals of nodes and edges, and the logarithm of the sum of all labellings that agree with ``given``."""
    n, k = len(g.doc), len(pii.KINDS) + 1
    node, pair, total = np.zeros((n, k)), np.zeros((len(g.edges), k, k)), 0.0
    weight = np.array([model.weights[s].sum(0) for s in g.slots])
    for z in itertools.product(range(k), repeat=n):
        if any(x >= 0 and x != y for x, y in zip(given, z, strict=True)):
            continue
        w = np.exp(sum(weight[i, x] for i, x in enumerate(z)) + sum(model.pairs[min(kind, 1), z[a], z[b]] for a, b, kind in g.edges))
        total += w
        node[range(n), z] += w
        for m, (a, b, _) in enumerate(g.edges):
            pair[m, z[a], z[b]] += w
    return node / total, pair / total, np.log(total)


def test_messages_and_gradients_against_enumeration():
    rng = np.random.default_rng(3)
    model = pii.Field(rng.normal(size=(pii.SHAPES, 5)) * 0.5, rng.normal(size=(2, 5, 5)))
    text = "a 55512345 and b 10.1.2.3 10.1.2.9 then 55512345"  # a tree: no loops, so messages are exact
    g = pii.graph([text], [pii.base_spans(text)])
    assert len(g.doc) == 4 and len(g.edges) == 2
    for given in (np.full(4, -1), np.where(g.seen > 0, g.seen, -1), np.array([-1, 2, -1, 0])):
        node, pair, _ = _exact(g, model, given)
        got = model.beliefs(g, given)
        assert abs(got[0] - node).max() < 1e-3 and abs(got[1] - pair).max() < 1e-3
    gold, shown = np.array([4, 2, -1, 0]), np.array([False, True, False, False])
    by_weight, by_pair = pii.gradients(g, model, gold, shown)

    def likelihood(m):
        return _exact(g, m, gold)[2] - _exact(g, m, np.where(shown, gold, -1))[2]

    small = 1e-4
    for kind, i, j in ((0, 2, 2), (0, 0, 1), (1, 4, 0), (1, 0, 0)):
        step = np.zeros_like(model.pairs)
        step[kind, i, j] = small
        want = (likelihood(pii.Field(model.weights, model.pairs + step)) - likelihood(pii.Field(model.weights, model.pairs - step))) / (2 * small)
        assert abs(want - by_pair[kind, i, j]) < 5e-3
    for slot, label in ((g.slots[0][2], 4), (g.slots[0][2], 0)):
        step = np.zeros_like(model.weights)
        step[slot, label] = small
        want = (likelihood(pii.Field(model.weights + step, model.pairs)) - likelihood(pii.Field(model.weights - step, model.pairs))) / (2 * small)
        assert abs(want - by_weight[slot, label]) < 5e-3


def test_long_tokens_are_read_whole():
    long = "a1" * 5000
    assert pii.shape(long + ".5")[:2] != pii.shape(long + "!5")[:2] and pii.shape(long + "..x")[3] != pii.shape(long + "x")[3]
    text = "x" * 100_000 + "@mail.example.com " + "10.1.2.3 " * 20_000
    g = pii.graph([text], [pii.base_spans(text)])
    assert (g.seen > 0).sum() == 20_001


def test_digest_edges(docs):
    model = pii.fit(["a@b.com"])
    found = pii.digest(docs, model)
    assert found.count() == docs.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in found.where("doc_id is null").collect()} == {nothing}
    assert pii.redact(docs, model).columns == docs.columns


# Toxicity ------------------------------------------------------------------------------


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        e, t, reset = rng.normal(size=n) * 2, rng.normal(size=(2, 2)), np.zeros(n, dtype=bool)
        reset[0] = True
        if n > 4:
            reset[3] = True
        total, want = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n) if not reset[i]))
            total += w
            want += w * np.array(y)
        for block in (1, 4, 256):
            assert np.allclose(want / total, toxicity.marginals(e, reset, t, block))
    long = toxicity.marginals(rng.normal(size=50_000) * 20, np.zeros(50_000, dtype=bool), np.array([[3.0, -3.0], [-3.0, 3.0]]))
    assert np.isfinite(long).all()


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    n = 7
    e, t, reset, y = rng.normal(size=n), rng.normal(size=(2, 2)), np.zeros(n, dtype=bool), rng.integers(0, 2, n).astype(float)
    reset[[0, 4]] = True

    def loss(e, t):
        score = lambda z: sum(e[i] * z[i] for i in range(n)) + sum(t[int(z[i - 1]), int(z[i])] for i in range(n) if not reset[i])
        return np.log(sum(np.exp(score(z)) for z in itertools.product((0, 1), repeat=n))) - score(y)

    by_token, by_pair = toxicity.gradients(e, y, reset, t)
    small = 1e-5
    for i in range(n):
        step = np.eye(n)[i] * small
        assert abs((loss(e + step, t) - loss(e - step, t)) / (2 * small) - by_token[i]) < 1e-6
    for i, j in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = small
        assert abs((loss(e, t + step) - loss(e, t - step)) / (2 * small) - by_pair[i, j]) < 1e-6
    for block in (1, 3, 256):
        assert np.allclose(toxicity.expectations(e, reset, t, block)[1], toxicity.expectations(e, reset, t)[1])


def test_toxicity_on_held_out(spark):
    rng = random.Random(8)
    bad = ["scumbag", "moronic", "trashy"]
    rows, labels = [], []
    for i in range(500):
        w, toxic = prose(rng, 60).split(), i % 4 == 0
        for _ in range(3 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "s", "ness"])
        rows.append((i, " ".join(w), i))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    found = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    held = [r for r in found.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 60 and all((r._toxicity.score >= 0.5) == (r.doc_id % 4 == 0) == bool(r._toxicity.predicted) for r in held)
    for r in held:
        assert all(r.text[s.start : s.end].startswith(tuple(bad)) for s in r._toxicity.spans) and len(r._toxicity.spans) == (3 if r.doc_id % 4 == 0 else 0) or r.doc_id % 4 == 0


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (4, 0)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels))
    assert found.count() == docs.count() and found.where("not (_toxicity.score between 0 and 1)").count() == 0
    marks = toxicity.Field(np.zeros(toxicity.DIMENSION), -6.0, np.zeros((2, 2)), np.zeros(4))
    marks.weights[zlib.crc32(b"w:idiot") % toxicity.DIMENSION] = 20.0
    for text in ("İstanbul idiot scumbag", "İİ idiot", "idiot", "ẞ İ_idiot IDIOT"):
        (p,) = marks.tag([text])
        spans = toxicity.spans_of(text, p)
        assert spans and {text[s["start"] : s["end"]].lower() for s in spans} == {"idiot"}
    for text in map(chr, range(1, 0x3000)):
        assert len(toxicity.words_of(f"a{text}b {text}")) == len(toxicity.WORD.findall(f"a{text}b {text}"))
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("_TOXICITY", F.lit(1)), marks)


# Chat ----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", probe), (1, 2, "assistant", probe + "\\ <\\| \n\n"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "assistant", ""), (4, 0, "tool\\\nx<|", "t"), (4, 0, "tool\\\nx<|", "t"), (None, None, None, "\\"), (5, 0, "user", "<|im_start|>" * 50 + "😀"), (5, 1, "assistant", "ü" * 5000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(turns)
    for r in formatted.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    found = {r.conv_id: r for r in chat.digest(formatted).collect()}
    assert set(found) == {1, 2, 3, 4, 5, None}
    for conv, r in found.items():
        own = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv])
        said = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert {c: r.valid for c, r in found.items()} == {1: True, 2: False, 3: True, 4: False, 5: True, None: False}


# URLs ----------------------------------------------------------------------------------


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else None


def test_rules_and_model(spark):
    urls = ["https://www.Example.com/en/x?y#z", "http://a.example.com/en/1", "http://example.com", "http://notexample.com/en/", "ftp://b.net/es/q", "http://c.net/fr?x", "http://net/fr/", None, "", "no scheme", "://", "http://É.com/#/", "http://x.org?a://b/c", "https://casino-bonus.example/win/jackpot-slots", "https://docs.python-guide.example/guide/install.html", "a://b\nc.com/\nd"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.judge(pages.select("page_id", "url"), url_filter.train(url_filter.labelled_table(spark))).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == (verdict or ("block" if found[i].score >= 0.5 else "allow"))
    assert found[13].verdict == "block" and found[14].verdict == "allow"
    with pytest.raises(ValueError):
        url_filter.judge(pages, url_filter.fit([]))


def test_url_model_on_unseen_hosts(spark):
    n, accuracy = url_filter.held_out(url_filter.labelled_urls())
    assert n > 1000 and accuracy >= 0.98
    own = spark.createDataFrame([("http://red.example/a", 1), ("http://blue.example/b", 0), (None, 1), ("http://x", None)], "url string, blocked int")
    model = url_filter.train(own)
    p = url_filter.predict(model, ["red.example", "blue.example"], ["/a", "/b"])
    assert p[0] > 0.5 > p[1]
    # one row and a batch of rows give the same
    hosts, paths = ["", "é.example", "a" * 5000], ["/ü", "", "/" * 9000]
    assert np.allclose(url_filter.predict(model, hosts, paths), [url_filter.predict(model, [h], [x])[0] for h, x in zip(hosts, paths, strict=True)])


# Media ---------------------------------------------------------------------------------


def test_transport_stream_round_trip():
    rng = random.Random(0)
    for n in (0, 1, 191, 192, 193, 5000, 12288, 12289, 60_001):
        payload, size = media_ts.padded("".join(rng.choice("abc é") for _ in range(n)))
        stream = media_ts.mux(payload)
        back = media_ts.demux(stream)
        assert back.payload == payload and len(payload) % 192 == 0 and len(payload) >= 192
        assert back.programs == {1: {media_ts.ES_PID: 6}} and back.breaks == 0
        assert back.stamps == [k * media_ts.UNIT_TICKS for k in range(len(back.stamps))]
        assert back.random_access == list(range(0, len(back.stamps), media_ts.GROUP))
    lost = stream[: 188 * 10] + stream[188 * 11 :]
    assert media_ts.demux(lost).broken == [(media_ts.ES_PID, 10)]
    twice = stream[: 188 * 11] + stream[188 * 10 :]
    assert media_ts.demux(twice).breaks == 0 and media_ts.demux(twice).payload == payload
    unit = media_ts.mux(payload[:12288])
    announced = bytearray(stream[: len(unit)] + unit[188 * 2 :])  # the counter starts anew
    assert media_ts.demux(bytes(announced)).breaks == 1
    announced[len(unit) + 5] |= 0x80
    assert media_ts.demux(bytes(announced)).breaks == 0
    assert media_ts.demux(stream, media_ts.ES_PID).payload == payload
    with pytest.raises(ValueError):
        media_ts.demux(stream, 0x101)
    for bad in (b"", stream[:100], b"\0" * 188, media_ts.PAT):
        with pytest.raises(ValueError):
            media_ts.demux(bad)


def test_media_rows(docs):
    found = media_ts.media_column(docs, keep_media=True).collect()
    rows = docs.collect()
    assert sorted(r.n_bytes for r in found) == sorted(len((r.text or "").encode()) for r in rows)
    for r in found:
        back = media_ts.demux(bytes(r.media))
        assert hashlib.sha256(back.payload).hexdigest() == r.payload_sha256 and r.tail_crc32 == zlib.crc32(back.payload[-16:]) and r.media_bytes == len(r.media)


def test_sample_is_the_least_hashes(spark):
    rows = spark.range(0, 20_000, 1, 9).withColumnRenamed("id", "doc_id")
    want = [r[0] for r in rows.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id").limit(50).collect()]
    assert [r[0] for r in drawn(rows, 50, "doc_id").collect()] == want
    assert drawn(rows, 30_000, "doc_id").count() == 20_000 and drawn(rows.limit(0), 5, "doc_id").count() == 0
    mostly_equal = rows.withColumn("doc_id", F.when(F.col("doc_id") < 300, F.col("doc_id")).otherwise(-1))
    assert drawn(mostly_equal, 100, "doc_id").count() == 100 and drawn(mostly_equal, 1000, "doc_id").count() == 301


# Search --------------------------------------------------------------------------------


def test_search_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    n = 3000
    x = rng.normal(size=(n, 32)).astype("f4")
    x[100] = x[0]
    x[150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 32), (n + 3, [float("nan")] * 32), (n + 4, [None] * 32), (None, x[5].tolist()), (n + 5, [float("inf")] + [1.0] * 31), (0, x[0].tolist()), (n + 6, [1.0, 2.0])]
    vectors = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0"), 5, ann.Params(stretch=700, asked=9)).collect()
    d = x.astype("f8")
    u = d / np.sqrt((d * d).sum(1, keepdims=True))
    hits = 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, n, 50))
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and len({r.vec_id for r in own}) == 5 and q not in {r.vec_id for r in own}
        assert all(abs(r.score - u[q] @ u[r.vec_id]) < 1e-12 for r in own)
        s = u @ u[q]
        s[q] = -9
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(n), -s))[:5].tolist()))
    assert hits / (5 * len(by)) >= 0.9
    assert [r.vec_id for r in by[0]][:2] == [100, 150]


def test_equal_vectors_are_not_cut(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(size=(n, 16)).astype("f4")
    copies = np.sort(rng.choice(n, n // 3, replace=False))
    x[copies] = x[copies[0]]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    asked = copies[[0, 2, 5, 400, 999]].tolist()
    for params in (ann.DEFAULT, ann.Params(stretch=300)):
        found = ann.search(vectors, vectors.where(F.col("vec_id").isin(asked)), 5, params).orderBy("query_id", "rank").collect()
        for q in asked:
            assert [r.vec_id for r in found if r.query_id == q] == [c for c in copies.tolist() if c != q][:5]


def test_one_number_with_many_vectors_hides_no_other(spark):
    near = [(1, [1.0, 0.001 * i]) for i in range(200)]  # all nearer than any other number
    rows = [(0, [1.0, 0.0]), *near, *((10 + i, [1.0, 1.0 + i]) for i in range(6))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = ann.Params(again=1.0, posted=128, read=128)  # all files hold all rows
    found = ann.search(vectors, vectors.where("vec_id = 0"), 5, whole).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 10, 11, 12, 13]


def test_search_with_few_candidates(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found = ann.search(v, v.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in found] == [(1, 0.707107), (2, 0.0)]
    one = v.where("vec_id = 0")
    assert ann.search(one, one, 5).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit(1)).withColumn("component_id", F.lit("x"))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out
        docs.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
    assert 0 < docs.count() <= 203
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.agg(F.countDistinct("doc_id")).first()[0] == docs.select("doc_id").distinct().count()
