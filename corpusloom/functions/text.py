"""Text cleaning as column expressions (string to string) and the two line models.

Regular expressions are written so that Java and RE2 read them alike: white space is
one explicit class (Unicode, as Python's ``str.split``), digits are ASCII, and ``.``
excludes the line feed only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spaces below 256 are listed one by one, as Java looks such up in one table; the complement begins with printable ASCII.
_SPACES = r"\t\n\x{0b}\x{0c}\r\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{_SPACES}]"
NWS = f"[^{_SPACES}]"
#: The spaces one by one, those of them below 256, and a class around the others: a text without any of it is split by the few.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_FEW = r"[\t\n\x{0b}\x{0c}\r\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}]"
_MORE = r"[\x{1680}-\x{3000}]"

# The patterns and characters that cleaning removes, in the order of their use.
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"
ODD_DELETED = "�​﻿"
ODD_SPACES = "  "
URLS = [rf"https?://{NWS}+", rf"www\.{NWS}+"]
EMAIL = rf"{NWS}+@{NWS}+\.{NWS}+"
PAGE_NUMBER = rf"^{WS}*[0-9]+{WS}*$"
WECHAT = ["（[^）]*<WECHAT>[^）]*）", r"\([^)]*<WECHAT>[^)]*\)", "<WECHAT>"]
EMPTY_PARENTHESES = [f"（{WS}*）", rf"\({WS}*\)"]
BOOK_METADATA = [
    "图书在版编目[^\\n]*\\n[^\\n]*",
    f"ISBN{WS}*[0-9-]+",
    f"出版社{WS}*[：:]{WS}*[^\\n]+",
    f"出{WS}*版{WS}*[：:]{WS}*[^\\n]+",
    f"作{WS}*者{WS}*[：:]{WS}*[^\\n]+",
    f"译{WS}*者{WS}*[：:]{WS}*[^\\n]+",
    f"责{WS}*任{WS}*编{WS}*辑{WS}*[：:]{WS}*[^\\n]+",
    f"文{WS}*字{WS}*编{WS}*辑{WS}*[：:]{WS}*[^\\n]+",
    f"美{WS}*术{WS}*编{WS}*辑{WS}*[：:]{WS}*[^\\n]+",
    f"定{WS}*价{WS}*[：:]{WS}*[^\\n]+",
    f"版{WS}*次{WS}*[：:]{WS}*[^\\n]+",
    f"开{WS}*本{WS}*[：:]{WS}*[^\\n]+",
    f"字{WS}*数{WS}*[：:]{WS}*[^\\n]+",
    f"书{WS}*号{WS}*[：:]{WS}*[^\\n]+",
    "中国版本图书馆CIP数据核字[^\\n]+",
    "京权图字[^\\n]+",
    "版权[^\\n]*必究[^\\n]*",
    "中青版图书，版权所有，盗版必究[^\\n]*",
    f"by{WS}+{NWS}+[^\\n]*Copyright[^\\n]+",
    f"Simplified{WS}+Chinese{WS}+translation{WS}+copyright[^\\n]+",
    f"购{WS}*书{WS}*网{WS}*址{WS}*[：:]{WS}*[^\\n]+",
    f"公{WS}*司{WS}*网{WS}*址{WS}*[：:]{WS}*[^\\n]+",
    f"电{WS}*话{WS}*[：:]{WS}*[^\\n]+",
    f"发{WS}*行{WS}*[：:]{WS}*[^\\n]+",
]
FORMAT_MARKERS = [f"={{3,}}{WS}*", f"-{{3,}}{WS}*", f"～{{2,}}{WS}*", f"第{WS}*[0-9]+{WS}*章{WS}*-{{2,}}", "「[^」]*」", "『[^』]*』", r"\[[0-9]+\]", rf"\[[0-9]+{WS}*[^\]]*\]"]
#: Where wide characters (ideographs and full-width marks) begin; most patterns hold one, so other texts need few of them.
WIDE = r"[\x{2e80}-\x{ffff}]"
#: The ninth marker, in Java's syntax: a bracketed number after a character, at the end of a word.
INNER_FOOTNOTE = rf"(?<={NWS})\[[0-9]+\](?={WS}|$)"
SENTENCE_END, CLOSERS = "。！？.!?", "」』】)\"'"


def _narrow(patterns: list[str]) -> list[str]:
    """Those that hold no wide character outside of a choice."""
    return [p for p in patterns if not any("\u2e80" <= c for c in re.sub(r"\[[^\]]*\]", "", p))]


def fold(text: Column, patterns: list[str], by: str = "") -> Column:
    """Replace each pattern in turn."""
    return reduce(lambda t, p: F.regexp_replace(t, p, by), patterns, text)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has lambdas of its own."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns so that later filters and projections read them and do not repeat them.

    Catalyst moves filters below projections and writes the expressions out in both
    places; it does not move them below a generator.
    """
    for name, c in columns.items():
        rows = rows.select(*(x for x in rows.columns if x != name), F.explode(F.array(c)).alias(name))
    return rows


def strip(text: Column) -> Column:
    """Python's ``str.strip``."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Python's ``str.split``."""
    parts = F.when(text.rlike(_MORE), F.split(text, f"{WS}+", -1)).otherwise(F.split(text, f"{_FEW}+", -1))
    return F.filter(parts, lambda w: w != "")


def split_lines(text: Column) -> Column:
    """``str.split('\\n')``: as many lines as line feeds, and one."""
    return F.split(text, "\n", -1)


def iterated_lines(text: Column) -> Column:
    """Lines as a text file yields them: any line ending, and none after the last one."""
    parts = F.split(text, r"\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def _by_line(text: Column, keep_blank: bool) -> Column:
    lines = F.transform(split_lines(text), strip)
    return F.array_join(lines if keep_blank else F.filter(lines, lambda x: x != ""), "\n")


def fix_encoding(text: Column) -> Column:
    return F.translate(text, ODD_SPACES + ODD_DELETED, " " * len(ODD_SPACES))


def strip_special(text: Column, keep: str | None = None) -> Column:
    """Without control characters, or with the characters of class ``keep`` only."""
    return F.regexp_replace(text, f"[^{keep}]" if keep else CONTROL, "")


def _by_width(text: Column, use: Callable[[Column, Callable], Column]) -> Column:
    """``use(text, choice of patterns)``: all of them, or those that a text without wide characters can hold.

    Removal makes no new characters, so a chain of removals is chosen once, by its input.
    """
    return F.when(text.rlike(WIDE), use(text, lambda p: p)).otherwise(use(text, _narrow))


def _wechat_tags(text: Column, of: Callable) -> Column:
    return fold(F.regexp_replace(fold(text, of(WECHAT)), r"[ \t]+", " "), of(EMPTY_PARENTHESES))


def wechat_tags(text: Column) -> Column:
    """Also squeezes blanks and empty parentheses of any text."""
    return _by_width(text, _wechat_tags)


def strip_urls(text: Column) -> Column:
    return fold(text, URLS)


def strip_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "")


def _book_metadata(text: Column, of: Callable) -> Column:
    return fold(text, of(BOOK_METADATA))


def book_metadata(text: Column) -> Column:
    return _by_width(text, _book_metadata)


def _format_markers(text: Column, of: Callable) -> Column:
    return F.regexp_replace(fold(text, of(FORMAT_MARKERS)), INNER_FOOTNOTE, "")


def format_markers(text: Column) -> Column:
    return _by_width(text, _format_markers)


def page_numbers(text: Column) -> Column:
    return F.regexp_replace(text, f"(?md){PAGE_NUMBER}", "")


def clean_whitespace(text: Column) -> Column:
    return _by_line(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), keep_blank=True)


def drop_empty_lines(text: Column) -> Column:
    return _by_line(text, keep_blank=False)


def normalize_punct(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\.{3,}", "..."), "-{2,}", "——")


def page_clean(text: Column) -> Column:
    """The crawler's form: no links, one blank for any white space."""
    return strip(F.regexp_replace(F.regexp_replace(text, f"http{NWS}+", ""), f"{WS}+", " "))


def extracted_clean(text: Column) -> Column:
    """The extractors' form: blank lines are squeezed before blanks are."""
    return strip(_by_line(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " "), keep_blank=True))


def clean_file(text: Column, urls: bool = True, emails: bool = True, numbers: bool = True) -> Column:
    """The bundle for a whole file."""

    def chain(value: Column, of: Callable) -> Column:
        out = _format_markers(_book_metadata(clean_whitespace(drop_empty_lines(fix_encoding(value))), of), of)
        out = strip_urls(out) if urls else out
        out = strip_emails(out) if emails else out
        return page_numbers(out) if numbers else out

    return _by_width(text, chain)


def light(text: Column) -> Column:
    return clean_whitespace(fix_encoding(text))


def standard(text: Column, urls: bool = True, numbers: bool = True) -> Column:
    """The bundle for a line (personal data, quality and duplicates come after it)."""

    def chain(value: Column, of: Callable) -> Column:
        out = _wechat_tags(strip_special(fix_encoding(value)), of)
        out = strip_urls(out) if urls else out
        out = _format_markers(_book_metadata(out, of), of)
        out = page_numbers(out) if numbers else out
        return drop_empty_lines(clean_whitespace(out))

    return _by_width(text, chain)


def sentences(text: Column, min_length: int = 10) -> Column:
    """Sentences of at least ``min_length`` characters; a mark followed by a closing quote ends none."""
    marked = F.regexp_replace(text, f"([{SENTENCE_END}]+)(?![{SENTENCE_END}{CLOSERS}])({WS}*)", "$1$2\u001e")
    return F.filter(F.transform(F.split(marked, "\u001e", -1), strip), lambda s: F.length(s) >= min_length)


def ngrams(text: Column, n: int = 5) -> Column:
    """Distinct n-grams of white-space tokens, joined by blanks; none for shorter texts."""
    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(none)

    return let(words(text), of)


def gram_hashes(text: Column, n: int = 5) -> Column:
    """Hashes of the distinct n-grams, sorted: of their tokens in turn, so no n-gram is put together."""

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        hashes = F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, F.array_sort(F.array_distinct(hashes))).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), of)


class Pipeline:
    """Cleaners applied from left to right; each maps a column to a column."""

    def __init__(self) -> None:
        self.steps = []

    def add(self, step) -> Pipeline:
        self.steps.append(step)
        return self

    def add_python(self, function) -> Pipeline:
        """A Python function on one string, run over Arrow batches."""
        def run(values: pd.Series) -> pd.Series:
            return values.map(function, na_action="ignore")

        return self.add(lambda c: F.pandas_udf(run, "string")(c))

    def __call__(self, text: Column) -> Column:
        return reduce(lambda t, step: step(t), self.steps, text)


def lines(docs: DataFrame, keep_blank: bool = False) -> DataFrame:
    """(doc_id, line_no from 0, line) of ``docs``."""
    out = docs.select("doc_id", F.posexplode(iterated_lines(F.col("text"))).alias("line_no", "line"))
    return out if keep_blank else out.where(strip(F.col("line")) != "")
