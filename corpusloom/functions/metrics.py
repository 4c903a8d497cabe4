"""Evaluation metrics and router formulas over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import words


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def ranked(values: Column) -> Column:
    """(value, index from 0), largest first, ties to the smaller index."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("less"), i.alias("index")))
    return F.transform(F.array_sort(pairs), lambda p: F.struct((-p["less"]).alias("value"), p["index"].alias("index")))


def top_indexes(values: Column, k: int) -> Column:
    return F.transform(F.slice(ranked(values), 1, k), lambda p: p["index"])


def nucleus(values: Column, p: float) -> Column:
    """Indexes of the fewest largest values whose sum reaches p."""
    order = ranked(values)
    kept = F.aggregate(order, F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("ids")), lambda a, x: F.struct((a["sum"] + x["value"]).alias("sum"), F.when(a["sum"] < p, F.concat(a["ids"], F.array(x["index"]))).otherwise(a["ids"]).alias("ids")))
    return kept["ids"]


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax at the label; null where it is -100."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(label != -100, F.log(total) + top - F.get(logits, label))


def accuracy(rows: DataFrame, logits: Column, label: Column, k: int = 5) -> DataFrame:
    """Accuracy and top-k accuracy over labels other than -100; 0 for none."""
    scored = rows.where(label != -100).select(F.array_contains(top_indexes(logits, 1), label.cast("int")).alias("one"), F.array_contains(top_indexes(logits, k), label.cast("int")).alias("any"))
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return scored.agg(share("one").alias("accuracy"), share("any").alias("topk_accuracy"))


def bleu(pairs: DataFrame, max_n: int = 4) -> DataFrame:
    """(n, score): clipped precision of 1..n-grams over all pairs of (id, candidate, reference), geometric mean, 0 if one is 0, no brevity penalty."""
    tokens = pairs.select("id", words(F.col("candidate")).alias("c"), words(F.col("reference")).alias("r"))

    def grams(column: str) -> DataFrame:
        each = [tokens.select("id", F.lit(n).alias("n"), F.explode(F.when(F.size(column) >= n, F.transform(F.sequence(F.lit(1), F.size(column) - n + 1), lambda i: F.array_join(F.slice(column, i, n), " "))).otherwise(F.array().cast("array<string>"))).alias("g")) for n in range(1, max_n + 1)]
        out = each[0]
        for e in each[1:]:
            out = out.unionAll(e)
        return out.groupBy("id", "n", "g").agg(F.count("*").alias("k"))

    have, want = grams("c"), grams("r").withColumnRenamed("k", "most")
    match = have.join(want, ["id", "n", "g"], "left").groupBy("n").agg(F.sum(F.least("k", F.coalesce("most", F.lit(0)))).alias("hit"), F.sum("k").alias("all"))
    ns = pairs.sparkSession.range(1, max_n + 1).select(F.col("id").cast("int").alias("n"))
    precision = ns.join(match, "n", "left").select("n", F.coalesce(F.col("hit") / F.col("all"), F.lit(0.0)).alias("p"))
    up_to = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # max_n rows
    return precision.select("n", F.when(F.min("p").over(up_to) > 0, F.exp(F.avg(F.log(F.when(F.col("p") > 0, F.col("p")))).over(up_to))).otherwise(F.lit(0.0)).alias("score"))


def classes(rows: DataFrame, *columns: Column) -> DataFrame:
    """(class): all values of the columns, each once."""
    return rows.select(F.explode(F.array(*columns)).alias("class")).distinct()


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """(class, tp, fp, fn) of all classes on either side."""
    each = rows.select(predicted.alias("p"), actual.alias("a"))
    sides = each.select(F.explode(F.array_distinct(F.array("p", "a"))).alias("class"), "p", "a")
    hit = lambda c: F.count_if(c)
    return sides.groupBy("class").agg(hit((F.col("p") == F.col("class")) & (F.col("a") == F.col("class"))).alias("tp"), hit((F.col("p") == F.col("class")) & (F.col("a") != F.col("class"))).alias("fp"), hit((F.col("p") != F.col("class")) & (F.col("a") == F.col("class"))).alias("fn"))


def f1(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """(average, precision, recall, f1) for micro, macro (mean of class values) and weighted (by class size)."""
    ratio = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    c = confusion(rows, predicted, actual)
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("w", F.col("tp") + F.col("fn"))
    macro = c.agg(*(F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in ("precision", "recall", "f1"))).select(F.lit("macro").alias("average"), "precision", "recall", "f1")
    weighted = c.agg(*(ratio(F.sum(F.col(x) * F.col("w")), F.sum("w")).alias(x) for x in ("precision", "recall", "f1"))).select(F.lit("weighted").alias("average"), "precision", "recall", "f1")
    micro = c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).select(ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    micro = micro.select(F.lit("micro").alias("average"), "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))
    return micro.unionAll(macro).unionAll(weighted)


def perplexity(loss: Column, tokens: Column) -> Column:
    """exp of the token-weighted mean loss; infinite where it overflows."""
    mean = F.sum(loss * tokens) / F.when(F.sum(tokens) > 0, F.sum(tokens))
    return F.when(mean > 709.78, F.lit(float("inf"))).otherwise(F.exp(mean))


def evaluation_perplexity(loss: Column, rows: Column) -> Column:
    """As a trainer reports it: of the row-weighted mean loss, infinite from 10 on."""
    mean = F.sum(loss * rows) / F.when(F.sum(rows) > 0, F.sum(rows))
    return F.when(mean < 10, F.exp(mean)).otherwise(F.lit(float("inf")))


def balance_loss(rows: DataFrame, logits: Column, k: int, alpha: float = 0.01) -> DataFrame:
    """alpha * experts * sum of (share of tokens routed * mean probability), and the mean square of the logits."""
    probs = rows.select(softmax(logits).alias("p"), top_indexes(logits, k).alias("top"), logits.alias("x"))
    each = probs.select(F.posexplode("p").alias("expert", "p"), "top")
    experts = each.groupBy("expert").agg(F.avg("p").alias("mean_p"), F.avg(F.array_contains("top", F.col("expert")).cast("double")).alias("share"))
    z = probs.select(F.explode("x").alias("x")).agg(F.avg(F.col("x") * F.col("x")).alias("z"))
    return experts.agg((F.lit(alpha) * F.count("*") * F.sum(F.col("mean_p") * F.col("share"))).alias("balance_loss")).crossJoin(z.select((F.lit(alpha) * F.col("z")).alias("z_loss")))  # one row each
