"""What changed between a folder and its manifest, and whether the tokenizer still fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import tokens


def file_changes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, change): new, modified, unchanged, or deleted, from (name, hash) of both sides."""
    a, b = current.select("name", F.col("hash").alias("_now")), manifest.select("name", F.col("hash").alias("_then"))
    kind = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_then"), "modified").otherwise("unchanged")
    return a.join(b, "name", "full_outer").select("name", kind.alias("change"))


def next_manifest(manifest: DataFrame, changes: DataFrame, current: DataFrame) -> DataFrame:
    """(name, hash, status): deleted files stay as orphaned, the others take their present hash."""
    rows = changes.join(current.select("name", F.col("hash").alias("_now")), "name", "left").join(manifest.select("name", F.col("hash").alias("_then")), "name", "left")
    return rows.select("name", F.coalesce("_now", "_then").alias("hash"), F.when(F.col("change") == "deleted", "orphaned").otherwise("active").alias("status"))


def oov(texts: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(char, n): characters that the vocabulary (char) lacks."""
    chars = texts.select(F.explode(F.split(text, "")).alias("char")).where("char != ''")
    return chars.groupBy("char").agg(F.count("*").alias("n")).join(vocabulary.select("char"), "char", "left_anti")


def policy(n_oov: int, mode: str = "extend", most: int = 100) -> str:
    """keep or retrain: frozen never retrains, retrain always, extend beyond ``most`` unknown characters."""
    return "retrain" if mode == "retrain" or mode == "extend" and n_oov > most else "keep"


def sample_lines(lines: DataFrame, per_file: int, seed: int = 42) -> DataFrame:
    """At most ``per_file`` lines of each file, drawn by a seeded hash: the same on every run."""
    drawn = lines.withColumn("_h", F.xxhash64(F.lit(seed), "line", "line_no"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("_h", "line_no"))
    return drawn.withColumn("_n", nth).where(F.col("_n") <= per_file).select("file", "line_no", "line")


def sample_bytes(lines: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """A sample of (file, line_no, line) of about ``target`` bytes in which every file has its part.

    With ratio = min(target / all bytes, 1): a file of at most twice ratio * files of its
    own bytes comes whole, of others that share of their lines is drawn by a seeded hash.
    """
    sizes = lines.groupBy("file").agg(F.sum(F.octet_length("line") + 1).alias("_bytes"), F.count("*").alias("_lines"))
    whole = sizes.agg(F.sum("_bytes").alias("_all"), F.count("*").alias("_files"))
    ratio = F.least(F.lit(float(target)) / F.col("_all"), F.lit(1.0)) * F.col("_files")
    wanted = F.when(F.col("_bytes") <= 2 * F.floor(F.col("_bytes") * ratio), F.col("_lines")).otherwise(F.least(F.greatest(F.floor(F.col("_lines") * ratio), F.lit(1)), F.col("_lines")))
    plan = sizes.crossJoin(whole).select("file", wanted.alias("_wanted"))  # one row on the right
    nth = F.row_number().over(Window.partitionBy("file").orderBy(F.xxhash64(F.lit(seed), "line", "line_no"), "line_no"))
    return lines.withColumn("_n", nth).join(plan, "file").where(F.col("_n") <= F.col("_wanted")).select("file", "line_no", "line")


def estimated_examples(files: DataFrame, total: int) -> DataFrame:
    """(name, num_examples): ``total`` examples shared out by the bytes of files (name, size)."""
    everything = files.agg(F.sum("size").alias("_all"))
    return files.crossJoin(everything).select("name", F.when(F.col("_all") > 0, F.floor(F.lit(total) * F.col("size") / F.col("_all"))).otherwise(0).alias("num_examples"))  # one row on the right


def change_counts(changes: DataFrame) -> DataFrame:
    """(change, n): what a run would do, without doing it."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def next_examples(examples: DataFrame, changes: DataFrame, fresh: DataFrame, shard_size: int) -> DataFrame:
    """(name, row, payload, shard) after a run: examples of the manifest's files with those of new and modified files anew.

    Examples of unchanged and deleted files keep their shards (deleted files are orphaned,
    not removed), those of modified files go, and ``fresh`` (name, row, payload) is put
    into shards after the last one, ``shard_size`` rows to each, in order of (name, row).
    """
    touched = changes.where("change in ('new', 'modified')").select("name")
    kept = examples.join(changes.where("change = 'modified'").select("name"), "name", "left_anti")
    top = examples.agg((F.coalesce(F.max("shard"), F.lit(-1)) + 1).alias("_top"))
    placed = tokens.offsets(fresh.join(touched, "name", "left_semi").withColumn("_one", F.lit(1)), ("name", "row"), "_one")
    added = placed.crossJoin(top).withColumn("shard", F.col("_top") + F.floor(F.col("offset") / shard_size))  # one row on the right
    return kept.select("name", "row", "payload", F.col("shard").cast("long").alias("shard")).unionByName(added.select("name", "row", "payload", F.col("shard").cast("long").alias("shard")))


def rebuilt(fresh: DataFrame, shard_size: int) -> DataFrame:
    """(name, row, payload, shard): all examples anew, from shard 0."""
    placed = tokens.offsets(fresh.withColumn("_one", F.lit(1)), ("name", "row"), "_one")
    return placed.select("name", "row", "payload", F.floor(F.col("offset") / shard_size).cast("long").alias("shard"))


def dataset_summary(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    """(total_files, total_shards, next_shard_index, total_examples): active files, and the shards there are."""
    shards = examples.agg(F.count_distinct("shard").alias("total_shards"), (F.coalesce(F.max("shard"), F.lit(-1)) + 1).alias("next_shard_index"), F.count("*").alias("total_examples"))
    return manifest.agg(F.count_if(F.col("status") != "orphaned").alias("total_files")).crossJoin(shards)  # one row each


def migrated(old: dict) -> dict:
    """A manifest of the second format in the third: files with hash, status and a share of the examples, shards, summary."""
    hashes, shards = old.get("file_hashes", {}), old.get("files", {}).get("train", [])
    n = old.get("train_metadata", {}).get("num_examples", 0)
    # The settings' defaults.
    config = {k: old.get(k, v) for k, v in {"max_seq_length": 512, "vocab_size": 32000, "min_frequency": 2, "shard_size": 10000}.items()}
    files = {path.rpartition("/")[2]: {"hash": h, "status": "legacy", "shards": list(shards), "num_examples": n // max(len(hashes), 1)} for path, h in hashes.items()}
    return {"version": "3.0", "config": config, "files": files, "shards": {s: {"num_examples": n // max(len(shards), 1)} for s in shards}, "summary": {"total_files": len(files), "total_shards": len(shards), "next_shard_index": len(shards)}}


def shuffled(rows: DataFrame, seed: int, epoch: int, shard: str = "shard", row: str = "row") -> DataFrame:
    """Two-level order of an epoch: shards by one hash, rows within them by another."""
    return rows.orderBy(F.xxhash64(F.lit(seed + epoch), F.col(shard)), F.xxhash64(F.lit(seed + epoch), F.col(shard), F.col(row)))
