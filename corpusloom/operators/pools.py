"""Proxies and user agents of a crawl as tables: parsing, health, choice, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What tells browsers, systems and versions apart, in the order of the tests, and the port where none is given.
BROWSERS = [("edge", ("edg/", "edge/"), ()), ("chrome", ("chrome/",), ("chromium/",)), ("safari", ("safari/",), ("chrome/",)), ("firefox", ("firefox/",), ()), ("opera", ("opera/", "opr/"), ())]
SYSTEMS = [("windows_10", ("windows nt 10",), ()), ("windows_8.1", ("windows nt 6.3",), ()), ("windows", ("windows",), ()), ("macos", ("mac os x",), ()), ("linux", ("linux",), ("android",)), ("android", ("android",), ()), ("ios", ("iphone", "ipad"), ())]
VERSIONS = ["chrome/([0-9]+)", "firefox/([0-9]+)", "safari/([0-9]+)", "edg/([0-9]+)"]
MOBILE = ("android", "ios")
PORT = 8080


def _first_of(text: Column, rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> Column:
    """The name of the first rule of which one word is in the text and none of the others."""
    has = lambda words: reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))
    out = F.lit("unknown")
    for name, some, none in reversed(rules):
        out = F.when(has(some) & ~has(none), F.lit(name)).otherwise(out)
    return out


def browser(agent: Column) -> Column:
    return _first_of(F.lower(agent), BROWSERS)


def system(agent: Column) -> Column:
    return _first_of(F.lower(agent), SYSTEMS)


def version(agent: Column) -> Column:
    """The number behind the first of the known names, in their order; 0 for none."""
    low = F.lower(agent)
    found = [F.regexp_extract(low, p, 1) for p in VERSIONS]
    return F.coalesce(*(F.when(x != "", x) for x in found), F.lit("0"))


def agents(rows: DataFrame, agent: str = "agent") -> DataFrame:
    """Adds browser, os and version."""
    a = F.col(agent)
    return rows.withColumn("browser", browser(a)).withColumn("os", system(a)).withColumn("version", version(a))


def agent_counts(rows: DataFrame) -> DataFrame:
    """(kind, name, n) of all rows with browser and os: one scan, counted before the shuffle."""
    each = rows.select(F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("browser").alias("kind"), F.col("browser").alias("name")), F.struct(F.lit("os").alias("kind"), F.col("os").alias("name")))).alias("x"))
    return each.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def proxy_parts(url: Column) -> dict[str, Column]:
    """type, host, port, user and password of a proxy URL; http and PORT where not given."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    account, place = F.regexp_extract(authority, "^(.*)@", 1), F.regexp_extract(authority, "([^@]*)$", 1)
    port = F.regexp_extract(place, ":([0-9]+)$", 1)
    present = lambda x: F.when(x != "", x)
    return {
        "type": F.coalesce(present(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))), F.lit("http")),
        "host": F.lower(F.regexp_replace(place, ":[0-9]*$", "")),
        "port": F.coalesce(F.when(port.try_cast("int") > 0, port.try_cast("int")), F.lit(PORT)),
        "user": present(F.regexp_extract(account, "^([^:]*)", 1)),
        "password": present(F.regexp_extract(account, "^[^:]*:(.*)$", 1)),
    }


def proxy_url(kind: Column, host: Column, port: Column, user: Column, password: Column) -> Column:
    """type://user:password@host:port; without an account unless both are given; null without a host."""
    both = (F.coalesce(user, F.lit("")) != "") & (F.coalesce(password, F.lit("")) != "")
    account = F.when(both, F.concat(user, F.lit(":"), password, F.lit("@"))).otherwise("")
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(kind, F.lit("://"), account, host, F.lit(":"), port.cast("string")))


def health(releases: DataFrame, min_rate: float = 0.5) -> DataFrame:
    """(proxy, successes, failures, time, success_rate, avg_time, alive) from releases (proxy, ok, seconds).

    The rate of a proxy never used is 1 and its mean time infinite, as is that of one that never succeeded.
    """
    found = releases.groupBy("proxy").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("seconds"))), F.lit(0.0)).alias("time"))
    n = F.col("successes") + F.col("failures")
    rate = F.when(n > 0, F.col("successes") / n).otherwise(1.0)
    mean = F.when(F.col("successes") > 0, F.col("time") / F.col("successes")).otherwise(F.lit(float("inf")))
    return found.withColumn("success_rate", rate).withColumn("avg_time", mean).withColumn("alive", F.col("success_rate") >= min_rate)


def pool_stats(proxies: DataFrame) -> DataFrame:
    """total, alive, dead, and means of the rates and mean times of proxies that succeeded (0 for none)."""
    good = F.col("successes") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0))
    return proxies.agg(F.count("*").alias("total"), F.count_if("alive").alias("alive"), F.count_if(~F.col("alive")).alias("dead"), mean("success_rate").alias("avg_success_rate"), mean("avg_time").alias("avg_time"))


def pick(proxies: DataFrame, strategy: str, k: int = 1, order: str = "proxy") -> DataFrame:
    """The first ``k`` alive proxies: least_used (fewest failures) or fastest; ties by name."""
    by = {"least_used": "failures", "fastest": "avg_time"}[strategy]
    return proxies.where("alive").orderBy(by, order).limit(k)


def round_robin(requests: DataFrame, members: list[str], order: str = "id") -> DataFrame:
    """Adds ``pick``: members in turn, by the running number ``order`` of the requests (from 0)."""
    if not members:
        raise ValueError("no members to pick from")
    listed = F.array(*map(F.lit, members))
    return requests.withColumn("pick", F.element_at(listed, (F.pmod(F.col(order), F.lit(len(members))) + 1).cast("int")))


def least_used(agents_used: DataFrame, k: int = 1) -> DataFrame:
    """Agents (agent, use_count, last_used) by uses, then the longest unused (never first), then name."""
    nth = F.row_number().over(Window.orderBy("use_count", F.asc_nulls_first("last_used"), "agent"))
    return agents_used.withColumn("place", nth).where(F.col("place") <= k)
