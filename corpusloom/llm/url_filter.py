"""URL filter: host rules first, else logistic regression on hashed character n-grams.

The model is trained on a small labelled table of URLs (``url string, blocked int``; the
rows of :func:`labelled_urls` where none is given): signed hashes of the character 3- to
5-grams of host and path, L2-regularised logistic loss, full-batch gradient steps on the
driver.  The table is read up to :data:`LABELLED_ROWS` rows, drawn by a hash of the URL.
:func:`held_out` measures a table on hosts that the fit has not seen.  Scoring is one
narrow pass over the URLs, batch by batch in arrays; rules are column expressions.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and
is judged by the model on empty text (its bias); repeated rows are judged alike; very
long URLs are read whole; an empty table gives no rows; labelled rows with a null are left
out, and without any the model allows all; extra columns pass, but for those named like an
added one (host, path, rule, verdict, score), which raise ``ValueError``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import drawn, free_name

DIMENSION = 1 << 16
GRAMS = (3, 4, 5)
#: Rows of the labelled table that a fit reads at most.
LABELLED_ROWS = 20_000
ADDED = ("host", "path", "rule", "score", "verdict")
#: Fixed rules: (host, path, verdict); a rule is named by host and path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def labelled_urls() -> list[tuple[str, int]]:
    """The small training table: invented sites of both kinds, 1 = blocked; both have neutral paths, so hosts must tell too."""
    neutral = ("/", "/en/17", "/de/2045.html", "/fr/391?page=2", "/es/8800#top", "/it/66.html")
    ends = (".example.com", ".example.net", ".example.org", ".example")
    wanted = {
        "hosts": "docs.python-guide library.state news.daily wiki.open blog.science www.university m.city shop.garden archive.museum data.weather school.music forum.chess www.old-maps m.train-times blog.bread-baking river-valley thornton www.harbour m.mountain-hut sheet-music blog.history northern www.three-oaks m.kitchen translation www.weekly-news theatre blog.winter-sport m.farm-shop free-library".split()
        + [f"{w}{a}{b}" for a in "ban tor mel thin sor wer kan lith".split() for w, b in zip(("", "www.", "m.", "blog.", "", "", "www.", "blog."), "der than ing ville sted ure ona berg".split(), strict=True)],
        "paths": ("/articles/2021/history-of-maps", "/guide/install.html", "/wiki/linear_algebra", "/lessons/grammar/"),
    }
    unwanted = {
        "hosts": "casino-bonus m.casino-king www.win-casino blog.slots-win free-slots m.bets-online blog.free-casino sport-bets www.free-spins cheap-viagra www.pills-shop blog.cheap-meds m.pills-online adult-cams www.adult-porn blog.xxx-adult m.porn-x free-porn spam-links www.spam-mail blog.link-farm m.farm-links ads-click www.track-clicks blog.ads-server m.tracker-ads keygen-warez www.crack-free m.warez-x blog.jackpot-bets".split(),
        "paths": ("/win/jackpot-slots", "/porn/videos?id=1", "/buy-viagra-cheap", "/download/keygen-crack.exe"),
    }
    return [(f"https://{h}{ends[(i + j) % len(ends)]}{p}", k) for k, kind in ((0, wanted), (1, unwanted)) for i, h in enumerate(kind["hosts"]) for j, p in enumerate((*neutral, *kind["paths"]))]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and sign of the n-grams of all rows' UTF-8; host and path have marks of their own.

    The hash of an n-gram is a polynomial over its bytes, mixed: all windows of a batch at once.
    """
    rows, hashed = [], []
    for mark, texts in ((1, hosts), (2, paths)):
        raw = [f"^{t}$".encode() for t in texts]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(raw)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes up to the end of the row
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), mark * 16 + n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + data[at + k]
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            rows.append(row[at])
            hashed.append(h ^ h >> np.uint64(32))
    h = np.concatenate(hashed)
    return np.concatenate(rows), (h % np.uint64(DIMENSION)).astype(np.int64), 1.0 - 2.0 * (h >> np.uint64(40) & np.uint64(1))


def _cut(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    return host.lower(), path


def fit(rows: list[tuple[str, int]], steps: int = 600, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias; of blocked as label 1."""
    w, b = np.zeros(DIMENSION), 0.0
    if not rows:
        return w, -1.0
    cut = [_cut(u) for u, _ in rows]
    y = np.array([k for _, k in rows], dtype=np.float64)
    row, slot, sign = grams([h for h, _ in cut], [p for _, p in cut])
    sign = sign / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))[row]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, w[slot] * sign, minlength=len(rows)))))
        gap = (p - y) / len(rows)
        w -= 6.0 * (np.bincount(slot, gap[row] * sign, minlength=DIMENSION) + ridge * w)
        b -= 2.0 * gap.sum()
    return w, float(b)


def predict(model: tuple[np.ndarray, float], hosts: list[str], paths: list[str]) -> np.ndarray:
    """P(blocked) of each host and path."""
    weights, bias = model
    row, slot, sign = grams(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    return 1 / (1 + np.exp(-(bias + np.bincount(row, weights[slot] * sign, minlength=len(hosts)) / np.sqrt(np.maximum(n, 1)))))


def labelled_table(spark: SparkSession) -> DataFrame:
    """(url, blocked) of :func:`labelled_urls`."""
    return spark.createDataFrame(labelled_urls(), "url string, blocked int")


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on a labelled table (url string, blocked int)."""
    known = labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("int").alias("blocked")).where("url is not null and blocked is not null")
    return fit([(r[0], int(r[1] > 0)) for r in drawn(known, LABELLED_ROWS, "url", "blocked").collect()])


def held_out(rows: list[tuple[str, int]], parts_of: int = 5) -> tuple[int, float]:
    """Rows and accuracy over folds by host: each host is judged by a model that has seen no row of it."""
    fold = [zlib.crc32(_cut(u)[0].encode()) % parts_of for u, _ in rows]
    right = 0
    for k in range(parts_of):
        test = [r for r, f in zip(rows, fold, strict=True) if f == k]
        if test:
            cut = [_cut(u) for u, _ in test]
            p = predict(fit([r for r, f in zip(rows, fold, strict=True) if f != k]), [h for h, _ in cut], [x for _, x in cut])
            right += int(((p >= 0.5) == np.array([y for _, y in test])).sum())
    return len(rows), right / max(1, len(rows))


def judge(pages: DataFrame, model: tuple[np.ndarray, float], rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Columns of ``pages`` with host, path, rule, score (of blocked) and verdict."""
    clash = {c.lower() for c in pages.columns} & set(ADDED)
    if clash:
        raise ValueError(f"there are columns {sorted(clash)} already")

    @F.pandas_udf("double")
    def score(found: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in found:
            out = [predict(model, hosts[at : at + 4096].tolist(), paths[at : at + 4096].tolist()) for at in range(0, len(hosts), 4096)]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    fit_rule = free_name("_rule", pages)
    host, path = parts(F.col("url"))
    named = pages.withColumn("host", host).withColumn("path", path)
    named = named.withColumn(fit_rule, rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score("host", "path"))
    verdict = F.coalesce(F.col(fit_rule)["verdict"], F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return named.select(*pages.columns, "host", "path", F.col(fit_rule)["rule"].alias("rule"), "score", verdict.alias("verdict"))
