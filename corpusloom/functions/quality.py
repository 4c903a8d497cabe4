"""The heuristic quality score (0 to 1) as one expression, and filters by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import CONTROL, NWS, bound, let, split_lines, words

# Word lists, character classes and weights of the score.
STOP_WORDS = "的 了 是 在 和 有 我 也 就 人 都 一个 上 不 与 为 这 那 中 来 到 对 以 可 会 被 用 他 她 它 们 而 但 或 如 从 说 要 去 你 还 把 让 给 想 能 没 很 只 这个 自己".split()
TEMPLATE_KEYWORDS = ["此处填写", "待填写", "TODO", "待定", "空白", "无内容", "[此处省略", "（以下空白）", "未完待续", "略", "......", "（略）", "[  ]", "□", "■", "★", "☆", "请填写", "请输入", "暂无", "暂无信息"]
SYSTEM_KEYWORDS = ["http://", "https://", "Copyright", "版权所有"]
CJK, HANGUL = r"\x{4e00}-\x{9fff}", r"\x{ac00}-\x{d7af}"
LONG_RUN = r"([^\n])\1{4,}"
MIXED = f"[{CJK}]{{1,3}}[{HANGUL}]{{1,3}}"
FOREIGN_LINES = f"^[^{CJK}]{{30,}}$"
PUNCTUATION = "[。！？.!?;,:，、]"
ENDERS = "[。！？.!?]"


def _any(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def _count(text: Column, one_of: str) -> Column:
    """Characters of a class: what its removal takes away, as that makes no list of all matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{one_of}+", ""))).cast("double")


def score(text: Column) -> Column:
    """Penalties in a fixed order of double subtractions; the empty text scores 0."""
    n_tokens = F.size(words(text))
    # stop words are ideographs all
    stops = F.when(text.rlike(f"[{CJK}]"), F.size(F.filter(words(text), lambda w: w.isin(*STOP_WORDS)))).otherwise(0)
    filled = F.filter(split_lines(text), lambda x: x.rlike(NWS))
    lines = F.aggregate(filled, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + F.length(x)).alias("sum"), (a["n"] + 1).alias("n")))
    return let(F.struct(text.alias("t"), n_tokens.cast("double").alias("tokens"), stops.cast("double").alias("stops"), lines.alias("lines"), _count(text, ENDERS).alias("enders")), _score)


def _score(x: Column) -> Column:
    text, n_tokens, stops = x["t"], x["tokens"], x["stops"]
    n = F.length(text).cast("double")
    n = F.when(n > 0, n)
    many = n_tokens > 10
    per_token = F.when(n_tokens > 0, n_tokens)
    mean_line = x["lines"]["sum"] / F.when(x["lines"]["n"] > 0, x["lines"]["n"])
    rules = [
        (text.rlike(LONG_RUN), 0.25),
        (text.rlike(MIXED), 0.2),
        (text.rlike(f"(?md){FOREIGN_LINES}"), 0.15),
        (_count(text, CONTROL) / n > 0.05, 0.15),
        (_count(text, PUNCTUATION) / n < 0.005, 0.1),
        (mean_line < 5, 0.15),
        (mean_line > 5000, 0.1),
        (n > 100000, 0.1),
        (_any(text, TEMPLATE_KEYWORDS), 0.25),
        (many & (stops / per_token < 0.01), 0.1),
        (many & (x["enders"] / per_token < 0.02), 0.1),
        (_count(text, "[a-zA-Z0-9]") / n > 0.8, 0.15),
        (_any(text, SYSTEM_KEYWORDS), 0.15),
        (_count(text, f"[{CJK}]") / n > 0.3, -0.2),
    ]
    out = F.lit(1.0)
    for holds, weight in rules:
        out = out - F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))).otherwise(F.lit(0.0))


def filter_by_quality(rows: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Rows that reach the score, with it."""
    return bound(rows, score=score(F.col(text))).where(F.col("score") >= min_score)


def stats(rows: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Total, passed, filtered, pass_rate, and mean, least and largest score of the rows that pass (0 for none)."""
    scored = bound(rows.select(text), s=score(F.col(text)))
    ok = F.col("s") >= min_score
    found = scored.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.avg(F.when(ok, F.col("s"))).alias("a"), F.min(F.when(ok, F.col("s"))).alias("lo"), F.max(F.when(ok, F.col("s"))).alias("hi"))
    zero = F.lit(0.0)
    return found.select("total", "passed", (F.col("total") - F.col("passed")).alias("filtered"), F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(zero).alias("pass_rate"), F.coalesce("a", zero).alias("avg_score"), F.coalesce("lo", zero).alias("min_score"), F.coalesce("hi", zero).alias("max_score"))
