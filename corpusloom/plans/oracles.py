"""SQL for DuckDB, by name of the query: the same results said another way.

Patterns come from the library (they are values, not logic); where RE2 lacks
look-around or back references the SQL says the same by lists.
"""

from __future__ import annotations

from functools import reduce

from corpusloom.functions import pii, quality, text
from corpusloom.functions.text import NWS, WS
from corpusloom.functions.urls import ENTITIES, SKIPPED, TITLE_ENDS
from corpusloom.operators.sft import ASSISTANT, USER
from corpusloom.sources.writers import RULE


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rr(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def fold(x: str, patterns: list[str]) -> str:
    return reduce(rr, patterns, x)


def strip(x: str) -> str:
    return rr(x, rf"^{WS}+|{WS}+\z")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda w: w != '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def by_line(x: str, keep_blank: bool) -> str:
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: {strip('l')})"
    return f"array_to_string({lines if keep_blank else f'list_filter({lines}, lambda l: l != {q('')})'}, chr(10))"


def fix_encoding(x: str) -> str:
    out = f"translate({x}, {q(text.ODD_SPACES)}, {q(' ' * len(text.ODD_SPACES))})"
    return reduce(lambda t, c: f"replace({t}, {q(c)}, '')", text.ODD_DELETED, out)


def wechat(x: str) -> str:
    return fold(rr(fold(x, text.WECHAT), r"[ \t]+", " "), text.EMPTY_PARENTHESES)


def markers(x: str) -> str:
    return rr(fold(x, text.FORMAT_MARKERS), rf"({NWS})\[[0-9]+\]({WS}|$)", r"\1\2")


def spaces(x: str) -> str:
    return by_line(rr(rr(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"), True)


def page_numbers(x: str) -> str:
    return rr(x, f"(?m){text.PAGE_NUMBER}")


def clean_file_plain(x: str) -> str:
    """The whole-file bundle with links and addresses left in."""
    return page_numbers(markers(fold(spaces(by_line(fix_encoding(x), False)), text.BOOK_METADATA)))


def clean_file(x: str) -> str:
    out = markers(fold(spaces(by_line(fix_encoding(x), False)), text.BOOK_METADATA))
    return page_numbers(rr(fold(out, text.URLS), text.EMAIL))


def standard(x: str) -> str:
    out = fold(wechat(rr(fix_encoding(x), text.CONTROL)), text.URLS)
    return by_line(spaces(page_numbers(markers(fold(out, text.BOOK_METADATA)))), False)


def redact(x: str) -> str:
    for _, p, by in pii.PLAIN:
        x = rr(x, p, by)
    for _, k, p, by in pii.CONTEXT:
        x = rr(x, f"({k})({p.removesuffix(chr(92) + 'b')})([^\\p{{L}}\\p{{N}}_]|$)", rf"\1{by}\3") if p.endswith("\\b") else rr(x, f"({k})({p})", rf"\1{by}")
    for _, p, by in pii.COMPOUND:
        x = rr(x, p, by)
    return x


def sentences(x: str) -> str:
    marked = rr(x, f"([{text.SENTENCE_END}]+)([{text.CLOSERS}]*)({WS}*)", "\\1\u001e\\2\u001f\\3\u001d")
    # a mark with closers ends nothing; the white space after a plain one belongs to it
    open_ = rr(marked, f"\u001e([{text.CLOSERS}]+)\u001f({WS}*)\u001d", r"\1\2")
    ended = rr(open_, f"\u001e\u001f({WS}*)\u001d", "\\1\u001e")
    return f"array_to_string(list_filter(list_transform(string_split({ended}, chr(30)), lambda s: {strip('s')}), lambda s: length(s) >= 10), chr(10))"


def grams(x: str, n: int = 5) -> str:
    w = words(x)
    return f"(select list_distinct(case when len(w) >= {n} then list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) else [] end) from (select {w} as w))"


def any_of(x: str, keywords: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(k)})" for k in keywords) + ")"


def score(x: str) -> str:
    """One penalty after the other, in doubles."""
    n, w = f"length({x})::double", words(x)
    filled = f"list_filter(string_split({x}, chr(10)), lambda l: {strip('l')} != '')"
    stops = "[" + ", ".join(map(q, quality.STOP_WORDS)) + "]"
    run = f"(select coalesce(list_bool_or(list_transform(range(1, len(c) - 3), lambda i: c[i] != chr(10) and c[i] = c[i + 1] and c[i] = c[i + 2] and c[i] = c[i + 3] and c[i] = c[i + 4])), false) from (select string_split({x}, '') as c))"
    many = f"len({w}) > 10"
    mean = f"(list_sum(list_transform({filled}, lambda l: length(l)))::double / nullif(len({filled}), 0))"
    rules = [
        (run, 0.25),
        (f"regexp_matches({x}, {q(quality.MIXED)})", 0.2),
        (f"regexp_matches({x}, {q('(?m)' + quality.FOREIGN_LINES)})", 0.15),
        (f"{count(x, text.CONTROL)} / {n} > 0.05::double", 0.15),
        (f"{count(x, quality.PUNCTUATION)} / {n} < 0.005::double", 0.1),
        (f"{mean} < 5", 0.15),
        (f"{mean} > 5000", 0.1),
        (f"{n} > 100000", 0.1),
        (any_of(x, quality.TEMPLATE_KEYWORDS), 0.25),
        (f"{many} and len(list_filter({w}, lambda v: list_contains({stops}, v))) / len({w})::double < 0.01::double", 0.1),
        (f"{many} and {count(x, quality.ENDERS)} / len({w})::double < 0.02::double", 0.1),
        (f"{count(x, '[a-zA-Z0-9]')} / {n} > 0.8::double", 0.15),
        (any_of(x, quality.SYSTEM_KEYWORDS), 0.15),
        (f"{count(x, f'[{quality.CJK}]')} / {n} > 0.3::double", -0.2),
    ]
    out = "1.0::double"
    for holds, weight in rules:
        out = f"({out} - case when coalesce({holds}, false) then {weight}::double else 0.0::double end)"
    return f"case when length({x}) > 0 then greatest(0.0::double, least(1.0::double, {out})) else 0.0::double end"


def plus_lines(x: str = "text") -> str:
    parts = f"regexp_split_to_array({x}, {q(chr(13) + chr(10) + '|' + chr(13) + '|' + chr(10))})"
    return f"case when {parts}[-1] = '' then {parts}[:-2] else {parts} end"


LINES = f"(select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, {plus_lines()} as l from documents))"
FULL_LINES = f"(select * from {LINES} where {strip('line')} != '')"
STRIPPED = f"(select doc_id, line_no, {strip('line')} as line from {FULL_LINES})"
LINE_FIRST = f"(select doc_id, min(line_no) as line_no, line from {STRIPPED} group by doc_id, line)"

_CLEANED = f"""
first as (select min(doc_id) as doc_id from documents group by sha256(text)),
a as (select doc_id, line_no, {standard('line')} as line from {FULL_LINES} where doc_id in (select doc_id from first)),
b as (select doc_id, line_no, {' + '.join(count('line', p.replace(chr(92) + 'b', '')) for p in pii.PATTERNS.values())} as pii, {redact('line')} as line from a where line != ''),
c as (select *, {score('line')} as s from b),
d as (select *, count(*) over (partition by doc_id, line) as n, min(line_no) over (partition by doc_id, line) as f from c where s >= 0.5::double),
e as (select * from d where n < 3 or line_no = f),
t as (select doc_id, sum(pii)::bigint as pii_count, count(*) filter (where s < 0.5::double) as quality_filtered, count(*) filter (where s >= 0.5::double) as good from c group by doc_id),
z as (select doc_id, string_agg(line, chr(10) order by line_no) as cleaned, count(*) as line_count, round(list_sum(list(s order by line_no)) / count(*), 9) as quality_score from e group by doc_id),
y as (select doc_id, md5(cleaned) as cleaned_md5, strlen(cleaned)::bigint as cleaned_size, line_count, quality_score, pii_count, quality_filtered, good - line_count as dedup_filtered from z join t using (doc_id))
"""

_PAIRS = f"""
g as (select doc_id, list_sort(list_transform({grams('text')}, lambda x: hash(x))) as s from documents),
r as (select min(doc_id) as doc_id, s from g where len(s) > 0 group by s),
x as (select doc_id, len(s) as n, unnest(s) as h from r),
p as (select a.doc_id as a_id, b.doc_id as b_id, count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) as jaccard from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2 having count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) > 0.8::double)
"""

_STORE = "(select doc_id as id, 'in/' || doc_id || '.txt' as original_file_path, md5(text) as original_md5, strlen(text)::bigint as original_size, length(text) as cleaned_size, len(string_split(text, chr(10))) as line_count, doc_id % 3 as pii_count, doc_id % 5 as quality_filtered, doc_id % 7 as dedup_filtered, source as run_id, text as cleaned_content from documents)"

_QA = """(select u.conv_id, u.turn, u.text as title, a.text as answer, s.d as desc_ from conversations u
left join conversations a on a.role = 'assistant' and a.conv_id = u.conv_id and a.turn = u.turn + 1
left join (select conv_id, min(text) as d from conversations where role = 'system' group by 1) s on s.conv_id = u.conv_id
where u.role = 'user')"""
_SFT = f"(select conv_id, turn, title as instruction, coalesce(desc_, '') as input, answer as output from {_QA} where {strip('coalesce(title, {0})'.format(q('')))} != '' and {strip('coalesce(answer, {0})'.format(q('')))} != '')"
_ALPACA = "'### Instruction:' || chr(10) || instruction || case when input != '' then chr(10) || chr(10) || '### Input:' || chr(10) || input else '' end || chr(10) || chr(10) || '### Response:' || chr(10)"
_SIMPLE = "'Instruction: ' || instruction || chr(10) || case when input != '' then 'Input: ' || input || chr(10) else '' end || 'Output: '"
_CHAT = f"{q(USER)} || instruction || case when input != '' then chr(10) || input else '' end || chr(10) || {q(ASSISTANT)} || output || chr(10)"

_TOKENS = f"(select doc_id, line_no, list_transform({words('line')}, lambda w: length(w)) as tokens from {FULL_LINES})"


def listed(x: str) -> str:
    """A digest of a whole list, order and all."""
    return f"md5(array_to_string({x}, ','))"


def filled(x: str, width: str, pad: int) -> str:
    return f"list_concat({x}[:{width}], list_transform(range(greatest({width} - len({x}), 0)), lambda i: {pad}))"


def _mask(x: str, width: str) -> str:
    return f"list_concat(list_transform(range(least(len({x}), {width})), lambda i: 1), list_transform(range(greatest({width} - len({x}), 0)), lambda i: 0))"


def _pack(tokens: str, length: int) -> str:
    s = length // 2
    return f"""with t as (select doc_id, line_no, unnest(tokens) as x, unnest(range(len(tokens))) as i from {tokens}),
o as (select x, row_number() over (order by doc_id, line_no, i) - 1 as p from t),
n as (select count(*) as n, case when count(*) >= {length} then (count(*) - {length}) // {s} + 2 when count(*) > 0 then 1 else 0 end as k from o),
w as (select unnest(range(k)) as win, n from n),
m as (select win, list(x order by p) as ids from w join o on p >= win * {s} and p < win * {s} + {length} group by win)
select win as "window", len(ids) as n, list_reduce(list_concat(ids, list_transform(range({length} - len(ids)), lambda i: 1::bigint)), lambda a, x: (a * 31 + x) % 1000003, 0::bigint) as digest
from (select win, list_transform(ids, lambda v: v::bigint) as ids from m)"""


_BATCHED = f"(select doc_id, line_no, doc_id // 8 as batch, tokens as ids, list_transform(tokens, lambda x, i: case when i <= 3 then -100 else x end) as labels from {_TOKENS})"


def _collate(labels: str, most: int) -> str:
    return f"""select doc_id, line_no, width, {listed(filled('ids', 'width', 1))} as ids, {listed(filled(labels, 'width', -100))} as labels, {listed(_mask('ids', 'width'))} as mask
from (select *, least(max(len(ids)) over (partition by batch), {most}) as width from {_BATCHED})"""


_LOGITS = "(select vec_id, list_transform(embedding, lambda v: v::double) as x, label from embeddings)"
_SOFT = "(select vec_id, label, x, list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda u: exp(u - list_max(x))))) as p from {0})"
_RANKED = "(select vec_id, label, i - 1 as i, v, row_number() over (partition by vec_id order by v desc, i) as r from (select vec_id, label, unnest(x) as v, unnest(range(1, len(x) + 1)) as i from {0}))"

_COS = "0.5::double * (1 + cos(pi() * 0.5 * 2.0 * (s - 100) / 900.0::double))"
_PERIOD = "floor(ln(s * 1.0::double / 100 + 1) / ln(2) + 1e-9)"


def _warm(then: str) -> str:
    return f"case when s < 100 then s / 100.0::double else {then} end"


def _kv(heads: str) -> str:
    return f"(12 * 2 * (p_size % 4 + 1) * {heads} * p_size * 64 * 64 * 2)::double / 1048576"


def _title(x: str) -> str:
    def entities(t: str) -> str:
        return reduce(lambda a, e: f"replace({a}, {q(e[0])}, {q(e[1])})", ENTITIES, t)

    out = strip(entities(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)"))
    for end in TITLE_ENDS:
        out = strip(f"split_part({out}, {q(end)}, 1)")
    return out


_DOMAIN = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_VALID = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) in ('http', 'https')" + "".join(f" and not regexp_matches(url, {q(p)})" for p in SKIPPED)


def _scalar(x: str) -> str:
    return f"select doc_id, {x} as out from documents"


def _paragraphs(most: int, overlap: int) -> str:
    """Parts by a walk over paragraphs that carries the part's text and its last two pieces."""
    tail = f"right(case when w.b is null then w.a else w.b || chr(10) || chr(10) || w.a end, {overlap})" if overlap else "null"
    closes = f"w.held + length(s.p) > {most}"
    begun = f"{tail} || chr(10) || chr(10) || s.p" if overlap else "s.p"
    size = f"length({tail}) + length(s.p) + 2" if overlap else "length(s.p) + 2"
    return f"""with recursive s as (select doc_id, p, rn from (select doc_id, unnest(l) as p, unnest(range(1, len(l) + 1)) as rn from (select doc_id, string_split(text, chr(10)) as l from documents))),
w as (select doc_id, rn, 0 as part, p as content, p as a, null::varchar as b, length(p) + 2 as held from s where rn = 1
union all select s.doc_id, s.rn, case when {closes} then w.part + 1 else w.part end, case when {closes} then {begun} else w.content || chr(10) || chr(10) || s.p end, s.p, case when {closes} then {tail} else w.a end,
case when {closes} then {size} else w.held + length(s.p) + 2 end from w join s on s.doc_id = w.doc_id and s.rn = w.rn + 1),
z as (select doc_id, part, arg_max(content, rn) as content from w group by 1, 2)"""


def _unescape(x: str) -> str:
    """The entities that the pages hold."""
    return f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&')"


#: Pages as the tables have them: one article with flat text, one div of class ad, links in nav; parts are cut by patterns, where the library reads any markup.
def _pieces(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '(?s)<!--.*?-->|<[^>]*>'), lambda t: {strip(_unescape('t'))}), lambda t: t != '')"


_PAGE = f"""(select page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)(</article>|<footer|$)', 1) as art, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) as ad from pages)"""
_RAW = f"(select *, {_unescape(rr('art', '(?s)<[^>]*>'))} as art_text, {_unescape('ad')} as ad_text, len(regexp_extract_all(art, '<[a-zA-Z]')) as art_tags from {_PAGE})"
_ART = f"array_to_string({_pieces('art')}, chr(10))"
_AD = f"array_to_string({_pieces('ad')}, chr(10))"
_ART_SIZE, _AD_SIZE = f"length({strip('art_text')})", f"length({strip('ad_text')})"
_ART_SCORE = f"case when {_ART_SIZE} >= 100 then {_ART_SIZE} / 2.0::double + {_ART_SIZE} / greatest(art_tags, 1)::double else 0 end"
_AD_SCORE = f"case when {_AD_SIZE} >= 100 then {_AD_SIZE} / 2.0::double + {_AD_SIZE} else 0 end"
_DENSEST = f"case when {_ART_SCORE} = 0 and {_AD_SCORE} = 0 then {_AD} || case when {_AD} != '' and {_ART} != '' then chr(10) else '' end || {_ART} when {_AD_SCORE} > {_ART_SCORE} then {_AD} else {_ART} end"
_PLAIN_TOKENS = r"regexp_extract_all(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->|<[^>]*>|[^<]+')"
_PLAIN_TEXT = f"array_to_string(list_transform({_PLAIN_TOKENS}, lambda t: case when regexp_matches(t, '^</?(p|div|h[1-6]|br|hr|li|tr|section|article|header|footer|nav|aside|main)[ >]') then chr(10) when starts_with(t, '<') then '' else {strip(_unescape('t'))} end), '')"
_PLAIN = strip(f"array_to_string(list_transform(string_split({rr(rr(_PLAIN_TEXT, chr(10) + '{3,}', chr(10) * 2), '[ ' + chr(9) + ']+', ' ')}, chr(10)), lambda l: {strip('l')}), chr(10))")
_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_CLEAN = strip(rr(rr("t", f"http{NWS}+"), f"{WS}+", " "))


def _batches(most_tokens: int, most_rows: int) -> str:
    rows = f"(select 0 as bucket, doc_id as idx, len({words('text')})::bigint as length from documents)"
    return _greedy_fold(rows, "bucket", "idx", "length", f"s.length * (w.k + 1) > {most_tokens} or w.k >= {most_rows}", "length, idx", "{n}")


def _greedy_fold(source: str, group: str, key: str, size: str, closes: str, start: str, step: str) -> str:
    """Rows numbered within groups, then a recursive walk that carries (chunk, state)."""
    return f"""with recursive s as (select {group}, {key}, {size}, row_number() over (partition by {group} order by {start}) as rn from {source}),
w as (select {group}, {key}, {size}, rn, 0::bigint as chunk, {step.format(held='0', n=size, prev='0')} as held, 1::bigint as k from s where rn = 1
union all select s.{group}, s.{key}, s.{size}, s.rn, case when {closes} then w.chunk + 1 else w.chunk end,
case when {closes} then {step.format(held='0', n='s.' + size, prev='0')} else {step.format(held='w.held', n='s.' + size, prev='w.held')} end,
case when {closes} then 1 else w.k + 1 end from w join s on s.{group} = w.{group} and s.rn = w.rn + 1)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "fix_encoding": _scalar(fix_encoding("text")),
        "strip_special": _scalar(rr("text", text.CONTROL)),
        "wechat_tags": _scalar(wechat("text")),
        "strip_urls": _scalar(fold("text", text.URLS)),
        "strip_emails": _scalar(rr("text", text.EMAIL)),
        "book_metadata": _scalar(fold("text", text.BOOK_METADATA)),
        "format_markers": _scalar(markers("text")),
        "page_numbers": _scalar(page_numbers("text")),
        "clean_whitespace": _scalar(spaces("text")),
        "drop_empty_lines": _scalar(by_line("text", False)),
        "normalize_punct": _scalar(rr(rr("text", r"\.{3,}", "..."), "-{2,}", "——")),
        "page_clean": _scalar(strip(rr(rr("text", f"http{NWS}+"), f"{WS}+", " "))),
        "extracted_clean": _scalar(strip(by_line(rr(rr("text", r"\n{3,}", "\n\n"), r"[ \t]+", " "), True))),
        "clean_file_bundle": _scalar(clean_file("text")),
        "light_bundle": _scalar(spaces(fix_encoding("text"))),
        "standard_bundle": _scalar(standard("text")),
        "sentences": _scalar(sentences("text")),
        "word_ngrams": _scalar(f"md5(array_to_string(list_sort({grams('text')}), chr(10)))"),
        "pii_redact": _scalar(redact("text")),
        "pii_flag": _scalar(" or ".join(f"regexp_matches(text, {q(p.replace(chr(92) + 'b', ''))})" for p in pii.PATTERNS.values())),
        "quality_score": _scalar(f"round({score('text')}, 9)"),
        "codepoints": _scalar(listed("list_transform(list_filter(string_split(text, ''), lambda c: c != ''), lambda c: unicode(c))")),
        "text_lines": f"select * from {FULL_LINES}",
        "file_hashes": "select doc_id, md5(text) as md5, left(sha256(text), 16) as short_id, strlen(text) as size from documents",
        "pii_counts": "select doc_id, " + ", ".join(f"{count('text', p.replace(chr(92) + 'b', ''))} as {n}" for n, p in pii.PATTERNS.items()) + " from documents",
        "quality_filter": f"select doc_id, round(s, 9) as score from (select doc_id, {score('text')} as s from documents) where s >= 0.65::double",
        "quality_stats": f"""with s as (select {score('text')} as s from documents)
select count(*) as total, count(*) filter (where s >= 0.5::double) as passed, count(*) filter (where s < 0.5::double) as filtered, round(count(*) filter (where s >= 0.5::double) / count(*)::double, 9) as pass_rate,
round(avg(s) filter (where s >= 0.5::double), 9) as avg_score, round(min(s) filter (where s >= 0.5::double), 9) as min_score, round(max(s), 9) as max_score from s""",
        "exact_dedup": "select min(doc_id) as doc_id, count(*) as n_copies from documents group by text",
        "near_dup_pairs": f"with {_PAIRS} select a_id, b_id, round(jaccard, 9) as jaccard from p",
        "near_dedup": f"""with recursive {_PAIRS},
e as (select b_id, list(a_id) as earlier from p group by b_id),
o as (select doc_id, coalesce(earlier, []) as earlier, row_number() over (order by doc_id) as rn from r left join e on b_id = doc_id),
w as (select 0::bigint as rn, []::bigint[] as kept
union all select o.rn, case when list_has_any(w.kept, o.earlier) or len(o.earlier) = 0 and false then w.kept else list_append(w.kept, o.doc_id) end from w join o on o.rn = w.rn + 1)
select unnest(kept) as doc_id from (select kept from w order by rn desc limit 1) union all select doc_id from g where len(s) = 0""",
        "line_dedup": f"select * from {LINE_FIRST}",
        "line_dedup_threshold": f"select doc_id, line_no, line from (select *, count(*) over (partition by doc_id, line) as n, min(line_no) over (partition by doc_id, line) as f from {STRIPPED}) where n < 3 or line_no = f",
        "line_out_numbers": f"select doc_id, line_no, row_number() over (partition by doc_id order by line_no) as out_no from {LINE_FIRST}",
        "clean_corpus": f"with {_CLEANED} select * from y",
        "clean_corpus_stats": f"""with {_CLEANED} select (select count(*) from documents) as total_docs, (select count(*) from {FULL_LINES}) as total_lines, count(*) as kept_docs, sum(line_count) as output_lines, sum(pii_count) as pii_detected, sum(quality_filtered) as quality_filtered, sum(dedup_filtered) as dedup_filtered,
round(sum(line_count)::double / (select count(*) from {FULL_LINES}), 9) as retention from y""",
        "cleaned_documents_upsert": f"select original_file_path, case when id % 2 = 0 then line_count + 1000 else line_count end as line_count, run_id, true as has_id from {_STORE} union all select 'new/' || id, line_count + 1000, run_id, true from {_STORE} where id % 2 != 0",
        "incremental_skip": f"select id, original_md5 as md5 from {_STORE} where original_md5 not in (select case when id % 4 = 0 then original_md5 else 'other' end from {_STORE})",
        "run_rollup": f"select run_id, count(*) as success_count, sum(line_count) as total_output_lines, sum(pii_count) as total_pii_detected, sum(quality_filtered) as total_quality_filtered, sum(dedup_filtered) as total_dedup_filtered from {_STORE} group by run_id",
        "run_delete": f"select run_id, count(*) as n from {_STORE} where run_id != 'src0' group by 1",
        "store_stats": f"select count(*) as total_documents, sum(original_size) as total_original_size, sum(cleaned_size) as total_cleaned_size, sum(line_count) as total_lines, sum(pii_count) as total_pii from {_STORE}",
        "content_search": f"select id from {_STORE} where cleaned_content ilike '%Rights Reserved%' order by id limit 20",
        "lookup_by_hash": f"select id, original_md5 from {_STORE} where original_md5 = (select original_md5 from {_STORE} where id = 11)",
        "list_page": f"select id, original_md5 from {_STORE} order by id limit 25 offset 50",
        "domain_counts": f"select {_DOMAIN.format('url')} as domain, count(*) as pages from pages group by 1",
        "csv_text": "select c_custkey, concat_ws(chr(10), " + ", ".join(f"case when trim({c}::varchar) != '' then '{c}: ' || trim({c}::varchar) end" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")) + ") as out from customer",
        "row_text": "select n_nationkey, concat_ws(chr(10), 'n_nationkey: ' || n_nationkey, 'n_name: ' || trim(n_name), 'n_regionkey: ' || n_regionkey) as out from nation",
        "row_chunks": _greedy_fold("(select substr(source, 4)::bigint as grp, doc_id, strlen(text)::bigint as size from documents)", "grp", "doc_id", "size", "w.held + s.size > 20000", "doc_id", "({held} + {n} + 1)") + " select grp, doc_id, size, chunk from w",
        "split_paragraphs": _paragraphs(2000, 0) + """ select doc_id, part, length(content) as size, md5(content) as md5 from z""",
        "split_paragraphs_overlap": _paragraphs(2000, 200) + """ select doc_id, part, length(content) as size, md5(content) as md5 from z""",
        "merge_text": f"select item_id % 4 as grp, length(string_agg(text, {q(RULE)} order by item_id)) as size, md5(string_agg(text, {q(RULE)} order by item_id)) as md5 from benchmark group by 1",
        "reassembled_text": f"select doc_id, md5(string_agg(line, chr(10) order by line_no) || chr(10)) as md5 from {LINE_FIRST} group by 1",
        "export_names": "select doc_id as id, case when n = 1 then source || '.txt' else source || '_' || (n - 1) || '.txt' end as name from (select doc_id, source, row_number() over (partition by source order by doc_id) as n from documents)",
        "day_files": "select event_id, strftime(ts, '%Y%m%d') || '-' || lpad((coalesce(b, 0) // 1000 + 1)::bigint::varchar, 3, '0') || '.txt' as file from (select event_id, ts, sum(strlen(props)) over (partition by ts::date order by event_id rows between unbounded preceding and 1 preceding) as b from events)",
        "qa_to_sft": f"select conv_id, turn, instruction, input, output from {_SFT}",
        "sft_prompt": f"""select conv_id, turn, 'alpaca' as template, {_ALPACA} as prompt, {_ALPACA} || output as "full" from {_SFT}
union all select conv_id, turn, 'chat', left({_CHAT}, strpos({_CHAT}, output) - 1), {_CHAT} from {_SFT}
union all select conv_id, turn, 'simple', {_SIMPLE}, {_SIMPLE} || output from {_SFT}""",
        "chat_render": f"select conv_id, count(*) as n_turns, string_agg(case when role = 'user' then {q(USER)} else {q(ASSISTANT)} end || coalesce(text, '') || chr(10), '' order by turn) as text from conversations where role in ('user', 'assistant') group by 1",
        "sft_labels": f"""select conv_id, turn, {listed('ids')} as ids, {listed('list_transform(ids, lambda x, i: case when i <= p then -100 else x end)')} as labels
from (select conv_id, turn, list_transform({words(_SIMPLE + ' || output')}, lambda w: length(w))[:64] as ids, len({words(_SIMPLE)}) as p from {_SFT})""",
        "pack_windows": _pack(_TOKENS, 512),
        "pack_codepoints": _pack(f"(select doc_id, line_no, list_transform(string_split(line, ''), lambda c: unicode(c)) as tokens from {FULL_LINES.replace('from documents', 'from (select item_id as doc_id, text from benchmark)')})", 256),
        "pad_lines": f"select doc_id, line_no, {listed(filled('tokens', '32', 1))} as ids, {listed(_mask('tokens', '32'))} as mask from {_TOKENS}",
        "collate_causal": _collate("ids", 1 << 30),
        "collate_sft": _collate("labels", 48),
        "dynamic_batches": _batches(4096, 8) + " select idx, length, chunk as batch from w",
        "dynamic_batches_drop_last": _batches(2048, 32) + " select idx, length, chunk as batch from w where chunk < (select max(chunk) from w)",
        "shard_assign": 'select doc_id, (row_number() over (order by doc_id) - 1) // 64 as shard, (row_number() over (order by doc_id) - 1) % 64 as "row" from documents',
        "page_text_auto": f"select page_id, {_DENSEST} as out from {_RAW}",
        "page_text_novel": f"select page_id, {_DENSEST} as out from {_RAW}",
        "page_text_wiki": f"select page_id, {_DENSEST} as out from {_RAW}",
        "page_text_news": f"select page_id, {_ART} as out from {_RAW}",
        "page_plain_text": f"select page_id, {_PLAIN} as out from pages",
        "page_links": f"select distinct page_id, link from (select page_id, {_ORIGIN} || unnest(regexp_extract_all(html, '<a href=\"([^\"#]*)', 1)) as link from pages) where " + _VALID.replace("url", "link"),
        "crawl_corpus": f"""with t as (select page_id, url, html, {_DENSEST} as t from {_RAW}), c as (select page_id, url, html, {_CLEAN} as text from t), h as (select *, sha256(text) as h from c where length(text) >= 1),
f as (select * from h where page_id in (select min(page_id) from h group by h))
select left(h, 16) as id, page_id, url, {_title('html')} as title, {_DOMAIN.format('url')} as domain, h as content_hash, text from f""",
        "crawl_counts": f"""with t as (select {_DENSEST} as t from {_RAW}), c as (select {_CLEAN} as text from t)
select count(*) as total, count(*) filter (where text = '') as empty, count(*) filter (where text != '') - count(distinct case when text != '' then text end) as duplicates, count(distinct case when text != '' then text end) as added from c""",
        "rate_limit": """with recursive s as (select user_id, event_id, epoch(ts::timestamp) as t, row_number() over (partition by user_id order by epoch(ts::timestamp), event_id) as rn from events),
w as (select user_id, event_id, rn, true as allowed, [floor(t)::bigint] as held from s where rn = 1
union all select s.user_id, s.event_id, s.rn, len(list_filter(w.held, lambda x: x > s.t - 3600)) < 2,
case when len(list_filter(w.held, lambda x: x > s.t - 3600)) < 2 and not list_contains(list_filter(w.held, lambda x: x > s.t - 3600), floor(s.t)::bigint) then list_append(list_filter(w.held, lambda x: x > s.t - 3600), floor(s.t)::bigint) else list_filter(w.held, lambda x: x > s.t - 3600) end
from w join s on s.user_id = w.user_id and s.rn = w.rn + 1)
select user_id, event_id, allowed from w""",
        "seen_marks": "select user_id, event_id, coalesce(epoch(ts::timestamp) - lag(epoch(ts::timestamp)) over (partition by user_id order by ts, event_id) >= 3600, true) as fresh from events",
        "url_resolve": f"select page_id, k, case k when 0 then {_ORIGIN} || '/a/b' when 1 then 'http://other.example/x?y' when 2 then split_part(url, '#', 1) when 3 then {_ORIGIN} || regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://[^/]*(/.*/)[^/]*$', 1) || 'c?d' end as out from pages, range(4) t(k)",
        "find_by_run": f"select id, run_id from {_STORE} where run_id = 'src1'",
        "find_by_path": f"select id, original_md5 from {_STORE} where original_file_path = 'in/7.txt'",
        "find_by_domain": f"select page_id as id, url from pages where {_DOMAIN.format('url')} = (select min({_DOMAIN.format('url')}) from pages where page_id % 3 != 0) and page_id % 3 != 0 order by page_id limit 100",
        "page_counts": f"select count(*) as total, count(*) filter (where page_id % 3 != 0) as crawled, count(distinct {_DOMAIN.format('url')}) as domains from pages",
        "run_finish": f"select run_id, count(*) as success_count, sum(line_count) as total_output_lines, sum(pii_count) as total_pii_detected, sum(quality_filtered) as total_quality_filtered, sum(dedup_filtered) as total_dedup_filtered, true as finished from {_STORE} where run_id = 'src1' group by 1 union all select 'none', 0, 0, 0, 0, 0, false",
        "processed_hashes": f"select distinct original_md5 from {_STORE}",
        "file_dedup": f"select min('f' || lpad(doc_id::varchar, 9, '0')) as path from (select doc_id, {by_line(rr('text', chr(13) + chr(10) + '|' + chr(13), chr(10)), False)} as d from documents) where d != '' group by d",
        "file_dedup_stats": f"with d as (select {by_line(rr('text', chr(13) + chr(10) + '|' + chr(13), chr(10)), False)} as d from documents) select count(*) as total_files, count(distinct case when d != '' then d end) as unique_files, count(*) filter (where d != '') - count(distinct case when d != '' then d end) as duplicates from d",
        "file_dedup_raw": "select min('f' || lpad(doc_id::varchar, 9, '0')) as path from documents group by text",
        "clean_files": f"select 'f' || doc_id as path, md5({clean_file_plain('text')}) as md5, null::varchar as error from documents",
        "batch_summary": "select count(*) filter (where text is not null) as succeeded, count(*) filter (where text is null) as failed from documents",
        "site_dump": f"""select site, md5(string_agg('# ' || case when t != '' then t else url end || chr(10) || chr(10) || '# URL: ' || url || chr(10) || chr(10) || x || chr(10) || chr(10) || repeat('=', 50) || chr(10), chr(10) order by page_id)) as md5
from (select page_id, url, {_DOMAIN.format('url')} as site, {_title('html')} as t, left(html, 100) as x from pages) group by 1""",
        "site_meta": f"select {_DOMAIN.format('url')} as site, count(*) filter (where page_id % 4 != 0) as total_pages, count(*) filter (where page_id % 4 = 0) as failed_pages from pages group by 1",
        "corpus_manifest": """with r as (select text, (row_number() over (order by doc_id) - 1) // 100 as s from documents), m as (select s, count(*) as n, sum(length(text)) as t, sum(strlen(text)) as b from r group by 1)
select s as "index", 'train_' || lpad(s::varchar, 5, '0') as file, n as document_count, t as tokens, b as bytes from m union all select -1, '', sum(n), sum(t), sum(b) from m""",
        "corpus_index": "select doc_id, i as \"index\", i // 100 as shard, i // 8 as batch from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents)",
        "indexed_lines": f"select doc_id::varchar as path, unnest(range(len(l))) as line_no, unnest(list_transform(l, lambda x: {strip('x')})) as line from (select doc_id, case when l[-1] = '' then l[:-2] else l end as l from (select doc_id, string_split(text, chr(10)) as l from documents))",
        "sample_bytes": """with l as (select source as file, doc_id, strlen(source || doc_id) + 1 as b from documents), z as (select file, sum(b) as b, count(*) as n from l group by 1), a as (select sum(b) as whole, count(*) as files from z)
select file, case when b <= 2 * floor(b * least(3000.0::double / whole, 1.0::double) * files) then n else least(greatest(floor(n * least(3000.0::double / whole, 1.0::double) * files), 1), n) end::bigint as n from z, a""",
        "estimated_examples": "select doc_id::varchar as name, floor(5000 * strlen(text) / (select sum(strlen(text)) from documents)::double)::bigint as num_examples from documents",
        "next_examples": """with c as (select doc_id, doc_id // 50 as old, case when doc_id % 11 = 0 then 'new' when doc_id % 7 = 0 then 'modified' when doc_id % 5 = 0 then 'deleted' else 'unchanged' end as change from documents),
top as (select max(old) + 1 as t from c where change != 'new'),
f as (select doc_id, row_number() over (order by lpad(doc_id::varchar, 9, '0')) - 1 as o from c where change in ('new', 'modified'))
select lpad(doc_id::varchar, 9, '0') as name, old as shard from c where change in ('unchanged', 'deleted') union all select lpad(doc_id::varchar, 9, '0'), t + o // 20 from f, top""",
        "dataset_summary": """with c as (select doc_id, doc_id // 50 as old, doc_id % 5 = 0 as gone from documents) select count(*) filter (where not gone) as total_files, count(distinct old) as total_shards, max(old) + 1 as next_shard_index, count(*) as total_examples from c""",
        "change_counts": """with a as (select doc_id, md5(text) as h, case when doc_id % 7 = 0 then 'old' else md5(text) end as o from documents) select case when h = o then 'unchanged' else 'modified' end as change, count(*) as n from a group by 1""",
        "agents": """select c_custkey, k, case k when 0 then 'edge' when 1 then 'chrome' when 2 then 'safari' when 3 then 'firefox' when 4 then 'opera' else 'unknown' end as browser,
case k when 0 then 'windows_10' when 1 then 'linux' when 2 then 'macos' when 3 then 'windows_8.1' when 4 then 'windows' else 'android' end as os,
case k when 2 then '605' when 4 then '0' when 5 then '0' else (80 + c_nationkey)::varchar end as version from (select c_custkey, c_nationkey, c_custkey % 6 as k from customer)""",
        "agent_counts": """with a as (select case c_custkey % 6 when 0 then 'edge' when 1 then 'chrome' when 2 then 'safari' when 3 then 'firefox' when 4 then 'opera' else 'unknown' end as b, case c_custkey % 6 when 0 then 'windows_10' when 1 then 'linux' when 2 then 'macos' when 3 then 'windows_8.1' when 4 then 'windows' else 'android' end as o from customer)
select 'total' as kind, '' as name, count(*) as n from a union all select 'browser', b, count(*) from a group by b union all select 'os', o, count(*) from a group by o""",
        "proxies": "select s_suppkey, case when s_suppkey % 2 = 0 then 'http' else 'socks5' end as type, 'h' || s_suppkey || '.example' as host, case when s_suppkey % 3 = 0 then 8080 else 1000 + s_suppkey end::int as port, case when s_suppkey % 5 = 0 then 'u' || s_suppkey end as \"user\", case when s_suppkey % 5 = 0 then 'p:w' end as password, case when s_suppkey % 2 = 0 then 'http' else 'socks5' end || '://' || case when s_suppkey % 5 = 0 then 'u' || s_suppkey || ':p:w@' else '' end || 'h' || s_suppkey || '.example:' || case when s_suppkey % 3 = 0 then 8080 else 1000 + s_suppkey end as url from supplier",
        "proxy_health": """select user_id as proxy, count(*) filter (where ok) as successes, count(*) filter (where not ok) as failures, round(count(*) filter (where ok) / count(*)::double, 9) as success_rate, round(case when count(*) filter (where ok) > 0 then sum(value) filter (where ok) / count(*) filter (where ok) else 'inf'::double end, 6) as avg_time, count(*) filter (where ok) / count(*)::double >= 0.8::double as alive from (select user_id, value, event_type != 'error' as ok from events) group by 1""",
        "proxy_stats": """with p as (select user_id, count(*) filter (where ok) as s, count(*) filter (where ok) / count(*)::double as r, sum(value) filter (where ok) as t from (select user_id, value, event_type != 'error' as ok from events) group by 1)
select count(*) as total, count(*) filter (where r >= 0.8::double) as alive, count(*) filter (where r < 0.8::double) as dead, round(coalesce(avg(r) filter (where s > 0), 0), 9) as avg_success_rate, round(coalesce(avg(t / s) filter (where s > 0), 0), 6) as avg_time from p""",
        "proxy_pick": """with p as (select user_id as proxy, count(*) filter (where not ok) as f, count(*) filter (where ok) / count(*)::double as r, sum(value) filter (where ok) / nullif(count(*) filter (where ok), 0) as t from (select user_id, value, event_type != 'error' as ok from events) group by 1)
select 'least_used' as strategy, * from (select proxy from p where r >= 0.8::double order by f, proxy limit 3) union all select 'fastest', * from (select proxy from p where r >= 0.8::double order by t, proxy limit 3)""",
        "round_robin": "select event_id, case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as pick from events",
        "stream_use": "select p_partkey, round(least(1.0::double, (p_size * 200) / 4100.0::double), 9) as utilization, p_size * 200 > 4100 as streaming, least(p_size * 200, 4100)::int as \"window\", round(case when p_size % 5 = 0 then 0.0::double else (p_size % 4) / (p_size % 5)::double end, 9) as acceptance, round(case when p_size % 3 = 0 then 1.0::double else ((p_size % 4) + p_size % 3) / (p_size % 3)::double end, 9) as tokens_per_step, round(case when p_size % 7 = 0 or p_size % 11 = 0 then 1.0::double else (p_size % 11) / (p_size % 7)::double end, 9) as speedup from part",
        "attention_memory": "select p_partkey, round(n, 9) as standard_mb, round(f, 9) as flash_mb, round(1 - f / n, 9) as reduction, greatest(p_size * 2 // 8, 1)::bigint as capacity, p_size * 4 as effective_batch from (select *, (2 * 8 * (p_size * 16) * (p_size * 16) * 2 * 12)::double / 1048576 as n, (2 * 8 * (p_size * 16) * 64 * 2 * 4 * 12)::double / 1048576 as f from part)",
        "formatted": "select event_id, case when b < 1024 then b || ' B' when b < 1048576 then printf('%.2f KB', b / 1024.0::double) when b < 1073741824 then printf('%.2f MB', b / 1048576.0::double) else printf('%.2f GB', b / 1073741824.0::double) end as size, case when t < 60 then printf('%.0fs', t::double) when t < 3600 then printf('%.1fm', round(t / 60.0::double, 1)) else printf('%.1fh', round(t / 3600.0::double, 1)) end as duration from (select event_id, (event_id * event_id * 7919) as b, (event_id * 13) % 20000 as t from events)",
        "trainer_perplexity": "select event_type, round(case when sum(value * (event_id % 4 + 1)) / sum(event_id % 4 + 1) < 10 then exp(sum(value * (event_id % 4 + 1)) / sum(event_id % 4 + 1)) else 'inf'::double end, 6) as perplexity from events group by 1",
        "progress": "select user_id, event_id, n as step, n % 10 = 0 as logged, round(n / 500.0::double * 100, 6) as percent, round((500 - n) * (n * 2.0::double) / n, 6) as eta from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events)",
        "label_classes": "select distinct c as class from (select quality as c from labels union all select toxic + 10 from labels)",
        "line_stream_dedup": f"select doc_id, line_no, line from (select *, count(*) over (partition by doc_id, line) as n, min(line_no) over (partition by doc_id, line) as f from {LINES}) where n < 3 or line_no = f",
        "record_counts": "select c_mktsegment as path, count(*) as record_count from customer group by 1",
        "file_order": "select doc_id::varchar as path, row_number() over (order by doc_id::varchar) - 1 as place from documents",
        "file_changes": """select coalesce(a.name, b.name) as name, case when b.hash is null then 'new' when a.hash is null then 'deleted' when a.hash != b.hash then 'modified' else 'unchanged' end as change
from (select case when doc_id % 5 = 0 then 'new-' || doc_id else doc_id::varchar end as name, md5(text) as hash from documents) a full join (select case when doc_id % 3 = 0 then 'old-' || doc_id else doc_id::varchar end as name, case when doc_id % 7 = 0 then 'old' else md5(text) end as hash from documents) b on a.name = b.name""",
        "oov_chars": 'select c as "char", count(*) as n from (select unnest(string_split(text, \'\')) as c from documents) where c not in (select unnest(string_split(text, \'\')) from documents where lang = \'en\') group by 1',
        "page_title": f"select page_id, {_title('html')} as title from pages",
        "page_domain": f"select page_id, {_DOMAIN.format('url')} as domain, left(sha256(html), 32) as key from pages",
        "url_normalize": "select page_id, split_part(url, '#', 1) as url from pages",
        "url_valid": f"select page_id, {_VALID} as valid, {_VALID} and contains(url, '/en/') as valid_en from pages",
        "daily_stats": "select strftime(ts, '%Y-%m-%d') as date, count(*) as pages_crawled, count(*) filter (where event_type = 'error') as pages_failed, round(sum(value), 4) as total_time from events group by 1",
        "recent_stats": "select strftime(ts, '%Y-%m-%d') as date, count(*) as n from events group by 1 order by 1 desc limit 7",
        "stage_timing": "select event_type, count(*) as n, round(sum(value), 4) as t, round(avg(value), 6) as mean, min(value) as least, max(value) as most, round(100 * sum(value) / (select sum(value) from events), 6) as share from events group by 1",
        "weighted_metrics": "select event_type, round(sum(value * (event_id % 4 + 1)) / sum(event_id % 4 + 1), 6) as mean, round(arg_max(value * (event_id % 4 + 1), event_id) / sum(event_id % 4 + 1), 9) as last from events group by 1",
        "perplexity": "select event_type, round(exp(sum(value / 100 * (event_id % 4 + 1)) / sum(event_id % 4 + 1)), 6) as perplexity from events group by 1",
        "rolling_loss": "select user_id, event_id, round(avg(value) over (partition by user_id order by event_id rows between 9 preceding and current row), 6) as rolling from events",
        "early_stop": """with a as (select user_id, event_id, value, min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as best, row_number() over (partition by user_id order by event_id) as nth from events),
b as (select *, max(case when best is null or value < best then nth end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as at_ from a)
select user_id, event_id, nth - at_ as waited, nth - at_ >= 5 as stop from b""",
        "checkpoint_keep": "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as n from events) where n <= 3",
        "bleu": f"""with t as (select conv_id * 1000 + turn as id, {words('title')} as c, {words('answer')} as r from {_QA} where answer is not null),
ns as (select unnest([1, 2, 3, 4]) as n),
gc as (select id, n, g, count(*) as k from (select id, n, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ' '))) as g from t, ns) group by 1, 2, 3),
gr as (select id, n, g, count(*) as k from (select id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) as g from t, ns) group by 1, 2, 3),
m as (select gc.n, sum(least(gc.k, coalesce(gr.k, 0)))::double / sum(gc.k) as p from gc left join gr on gc.id = gr.id and gc.n = gr.n and gc.g = gr.g group by 1),
p as (select ns.n, coalesce(m.p, 0) as p from ns left join m on m.n = ns.n)
select a.n, round(case when min(b.p) > 0 then exp(avg(ln(case when b.p > 0 then b.p end))) else 0 end, 9) as score from p a join p b on b.n <= a.n group by 1""",
        "f1_scores": """with e as (select case when n_chars > 1000 then 1 else 0 end as p, quality as a from documents join labels using (doc_id)),
k as (select distinct c from (select p as c from e union all select a from e)),
m as (select c, count(*) filter (where p = c and a = c) as tp, count(*) filter (where p = c and a != c) as fp, count(*) filter (where p != c and a = c) as fn from k, e group by 1),
v as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as pr, coalesce(tp / nullif(tp + fn, 0)::double, 0) as re, tp + fn as w from m),
f as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) as f from v),
u as (select sum(tp) / nullif(sum(tp + fp), 0)::double as pr, sum(tp) / nullif(sum(tp + fn), 0)::double as re from m)
select 'micro' as average, round(pr, 9) as "precision", round(re, 9) as recall, round(2 * pr * re / (pr + re), 9) as f1 from u
union all select 'macro', round(avg(pr), 9), round(avg(re), 9), round(avg(f), 9) from f
union all select 'weighted', round(sum(pr * w) / sum(w), 9), round(sum(re * w) / sum(w), 9), round(sum(f * w) / sum(w), 9) from f""",
        "topk_accuracy": f"select round(sum((label = i and r = 1)::int)::double / count(distinct vec_id), 9) as accuracy, round(sum((label = i and r <= 5)::int)::double / count(distinct vec_id), 9) as topk_accuracy from {_RANKED.format(_LOGITS)}",
        "router_topk": f"select vec_id, string_agg(i::varchar, ',' order by r) as experts from {_RANKED.format(_LOGITS)} where r <= 2 group by 1",
        "nucleus": f"""with b as (select vec_id, label, list_transform(embedding, lambda v: v::double * 8) as x from embeddings), s as {_SOFT.format('b')},
r as (select vec_id, i, v, row_number() over (partition by vec_id order by v desc, i) as r from (select vec_id, unnest(p) as v, unnest(range(len(p))) as i from s))
select vec_id, string_agg(i::varchar, ',' order by r) as kept from (select *, coalesce(sum(v) over (partition by vec_id order by r rows between unbounded preceding and 1 preceding), 0) as b from r) where b < 0.9::double group by 1""",
        "moe_balance": f"""with s as {_SOFT.format(_LOGITS)}, e as (select i, avg(v) as p from (select unnest(p) as v, unnest(range(len(p))) as i from s) group by 1),
t as (select i, avg((r <= 2)::int) as f from {_RANKED.format(_LOGITS)} group by 1)
select round((select 0.01::double * count(*) * sum(p * f) from e join t using (i)), 9) as balance_loss, round((select 0.01::double * avg(v * v) from {_RANKED.format(_LOGITS)}), 9) as z_loss""",
        "cross_entropy": f"select vec_id, round(-ln(p[label + 1]), 9) as loss from {_SOFT.format(_LOGITS)}",
        "learning_rates": f"""select s as step, round({_warm(f'greatest(0.1::double, {_COS})')}, 9) as cosine, round({_warm('greatest(0.0::double, (1000 - s) / 900.0::double)')}, 9) as linear, round({_warm('1.0::double')}, 9) as constant,
round({_warm('((1e-3::double - 1e-7::double) * power(1 - (s - 100) / 900.0::double, 2) + 1e-7::double) / 1e-3::double')}, 9) as polynomial,
round((1 + cos(pi() * (s - 100.0::double * (power(2, {_PERIOD}) - 1)) / (100.0::double * power(2, {_PERIOD})))) / 2, 9) as restarts,
round(case when s <= 300 then 4e-4::double + (1e-2::double - 4e-4::double) * (1 - cos(pi() * s / 300.0::double)) / 2 else 1e-2::double - (1e-2::double - 1e-6::double) * (1 - cos(pi() * (s - 300) / 700.0::double)) / 2 end, 9) as one_cycle from range(1001) t(s)""",
        "kv_cache": f"select p_partkey, round({_kv('kv')}, 9) as mb, round({_kv('16')} - {_kv('kv')}, 9) as saved_mb, round(1 - kv / 16.0::double, 9) as reduction, case when p_size * 64 <= 512 then 2.0 when p_size * 64 <= 1024 then 2.5 when p_size * 64 <= 2048 then 3.0 else 4.0 end::double as speedup from (select *, power(2, p_size % 5)::int as kv from part)",
        "ring_slots": "select i as position, case when i < 4100 then i else 4 + (i - 4100) % 4096 end as slot from range(20000) t(i)",
    }
    return out
