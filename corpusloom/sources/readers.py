"""Files to tables: text, CSV, JSON, Parquet, EPUB, instruction and shard files."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.html import plain_text
from corpusloom.functions.text import iterated_lines, strip
from corpusloom.operators import tokens


def text_files(spark: SparkSession, folder: str, recursive: bool = False, any_case: bool = True) -> DataFrame:
    """(path, name, content, md5, size) of the .txt files of a folder; bytes that are no UTF-8 are left out, as are empty files (Spark lists none). Order by path where order matters."""
    glob = "*.[tT][xX][tT]" if any_case else "*.txt"
    return binary_files(spark, folder, glob, recursive).select("path", "name", decoded(F.col("content")).alias("content"), "md5", "size")


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text, without bytes that are none; only such files leave the JVM."""

    def run(parts: pd.Series) -> pd.Series:
        return parts.map(plain_document, na_action="ignore")

    good = F.is_valid_utf8(content.cast("string"))
    return F.coalesce(F.when(good, content.cast("string")), F.pandas_udf(run, "string")(F.when(~good, content)))


def paths(files: DataFrame) -> DataFrame:
    """(place, path): files in order of their paths, numbered from 0."""
    return files.select("path").withColumn("place", F.row_number().over(Window.orderBy("path")) - 1)  # a folder's listing, which the driver has


def decode_lines(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, line_no, line) of the lines of files that are not blank, bytes that are no UTF-8 left out."""
    files = binary_files(spark, folder, glob).select("path", decoded(F.col("content")).alias("content"))
    return file_lines(files)


def binary_files(spark: SparkSession, folder: str, glob: str, recursive: bool = False) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.md5("content").alias("md5"), F.col("length").alias("size"))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of the lines that are not blank."""
    rows = files.select("path", F.posexplode(iterated_lines(F.col("content"))).alias("line_no", "line"))
    return rows.where(strip(F.col("line")) != "")


def labelled_fields(columns: list[str], label_single: bool = False) -> Column:
    """``column: value`` lines of the fields that are not blank; one column alone is its bare value."""
    value = lambda c: strip(F.col(c).cast("string"))
    if len(columns) == 1 and not label_single:
        return F.coalesce(value(columns[0]), F.lit(""))
    return F.concat_ws("\n", *(F.when(value(c) != "", F.concat(F.lit(f"{c}: "), value(c))) for c in columns))


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the records of CSV files with a header."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    columns = rows.columns
    named = rows.toDF(*(c.lstrip("﻿") for c in columns))
    return named.select(F.input_file_name().alias("path"), labelled_fields(named.columns, label_single=True).alias("text")).where("text != ''")


def record_counts(records: DataFrame) -> DataFrame:
    """(path, record_count): records that are not blank, of each file."""
    return records.groupBy("path").agg(F.count("*").alias("record_count"))


def parquet_text(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(F.input_file_name().alias("path"), labelled_fields(rows.columns).alias("text")).where("text != ''")


def json_lines(value, prefix: str = "") -> Iterator[str]:
    """``path: value`` lines of a parsed JSON value; nulls and numbers inside lists are left out."""
    for key, x in value.items():
        if isinstance(x, dict):
            yield from json_lines(x, f"{prefix}{key}. ")
        elif isinstance(x, list):
            for item in x:
                if isinstance(item, dict):
                    yield from json_lines(item, f"{prefix}{key}. ")
                elif isinstance(item, str) and item.strip():
                    yield f"{prefix}{key}: {item.strip()}"
        elif isinstance(x, str):
            if x.strip():
                yield f"{prefix}{key}: {x.strip()}"
        elif x is not None:
            yield f"{prefix}{key}: {x}"


def json_document(content: str) -> str:
    """A JSON object as lines; the records of an array under numbered headings."""
    value = json.loads(content)
    if isinstance(value, list):
        return "\n\n".join(f"--- 记录 {i} ---\n" + "\n".join(json_lines(x)) for i, x in enumerate(value, 1) if isinstance(x, dict))
    return "\n".join(json_lines(value)) if isinstance(value, dict) else str(value)


def epub_document(content: bytes) -> str:
    """Title, author and publisher, then the chapters in reading order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        opf = next(e.attrib["full-path"] for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(opf))
        meta = {k: next(((e.text or "").strip() for e in package.iter(f"{{http://purl.org/dc/elements/1.1/}}{k}")), "") for k in ("title", "creator", "publisher")}
        items = {e.attrib["id"]: e.attrib for e in package.iter() if e.tag.endswith("}item")}
        order = [e.attrib["idref"] for e in package.iter() if e.tag.endswith("}itemref")]
        order = [i for i in order if i in items] or [i for i, a in items.items() if "html" in a.get("media-type", "")]
        chapters = []
        for i in order:
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[i]["href"]))
            if name in names:
                chapters.append(plain_text(book.read(name).decode("utf-8", "ignore")))
    head = [x for x in meta.values() if x]
    return "\n\n".join([*head, *(c for c in chapters if c)])


def pdf_document(content: bytes) -> str:
    """Title, author, subject and creator where given, then the pages under numbered headings; needs pdfplumber."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        head = [x for k in ("Title", "Author", "Subject", "Creator") if (x := str((pdf.metadata or {}).get(k) or "").strip())]
        return "\n\n".join([*head, *(f"--- 第 {i} 页 ---\n{text}" for i, p in enumerate(pdf.pages, 1) if (text := page_lines(p.extract_text() or "")).strip())])


def page_lines(text: str) -> str:
    """A page's text with single blanks, stripped lines and at most one blank line."""
    text = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text))
    return "\n".join(x.strip() for x in text.split("\n"))


def plain_document(content: bytes) -> str:
    return content.decode("utf-8", "ignore")


def html_document(content: bytes) -> str:
    return plain_text(content.decode("utf-8", "ignore"))


#: Format by lower-cased ending: bytes of a file to its text.
EXTRACTORS = {".epub": epub_document, ".pdf": pdf_document, ".json": lambda b: json_document(b.decode("utf-8-sig")), ".txt": plain_document, ".html": html_document, ".htm": html_document}


def extractor(name: str):
    """The function for a file name; raises ValueError for an unknown ending."""
    ending = posixpath.splitext(name)[1].lower()
    if ending not in EXTRACTORS:
        raise ValueError(f"unknown format {ending or name}, known are {', '.join(EXTRACTORS)}")
    return EXTRACTORS[ending]


def documents(spark: SparkSession, folder: str, recursive: bool = True, unknown: str = "skip") -> DataFrame:
    """(path, name, text, error) of all files; a file that cannot be read has its error instead of a text.

    Files of unknown formats are left out, or with ``unknown="error"`` listed with a ValueError.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = files.where(ending.isin(*EXTRACTORS)) if unknown == "skip" else files
    known = files.select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    out.append((path, path.rpartition("/")[2], extractor(path)(content), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job; its error is the result
                    out.append((path, path.rpartition("/")[2], None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "name", "text", "error"])

    return known.mapInPandas(run, "path string, name string, text string, error string")


def instructions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a .json array or .jsonl file with instruction, input and output; missing fields are empty."""
    if not re.search(r"\.jsonl?$", path):
        raise ValueError("instruction files end in .json or .jsonl")
    rows = spark.read.schema("instruction string, input string, output string").option("multiLine", path.endswith(".json")).json(path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in rows.columns))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(title, desc, answer) of JSON lines; lines that do not parse are left out."""
    rows = spark.read.schema("title string, desc string, answer string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def shards(spark: SparkSession, folder: str, split: str = "train", expect: dict[str, str] | None = None) -> DataFrame:
    """Rows of the shards of a split; raises if the metadata of the folder differ from ``expect``."""
    if expect:
        meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{folder}/metadata").collect()}  # a few settings
        wrong = {k: meta[k] for k, v in expect.items() if k in meta and meta[k] != v}  # settings that were not kept are not compared
        if wrong:
            raise ValueError(f"shards were made with other settings: {wrong}")
    return spark.read.parquet(f"{folder}/data").where(F.col("split") == split)


def shard_sizes(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """(shard, num_examples) in order of shards, by the files' own row counts; raises if there is none."""
    sizes = spark.read.parquet(f"{folder}/data").where(F.col("split") == split).groupBy("shard").agg(F.count("*").alias("num_examples"))
    if sizes.isEmpty():
        raise ValueError(f"no shards of {split} in {folder}")
    return sizes.orderBy("shard")


def indexed(rows: DataFrame, order: str = "row", size: int = 10_000) -> DataFrame:
    """Adds index (from 0 in ``order``), shard (index // size) and row (index % size): any row is found by its index."""
    numbered = tokens.shards(rows.withColumnRenamed("row", "row_") if "row" in rows.columns and order != "row" else rows, size, order)
    return numbered.withColumn("index", F.col("shard") * size + F.col("row"))


def batches(rows: DataFrame, size: int, index: str = "index") -> DataFrame:
    """Adds batch: consecutive rows by index, ``size`` to a batch."""
    return rows.withColumn("batch", F.floor(F.col(index) / size))


def indexed_lines(files: DataFrame, keep_unterminated: bool = True) -> DataFrame:
    """(path, line_no from 0, line stripped) of all lines, blank ones too, so that (path, line_no) finds a line.

    ``keep_unterminated=False`` leaves out a last line without a line feed.
    """
    parts = F.split("content", "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts) if keep_unterminated else F.slice(parts, 1, F.size(parts) - 1)
    return files.select("path", F.posexplode(kept).alias("line_no", "line")).withColumn("line", strip(F.col("line")))


def settings(path: str, defaults: dict | None = None) -> dict:
    """A configuration file (.json, or .yaml and .yml where PyYAML is there) over ``defaults``, section by section; read on the driver."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(file) or {}
        else:
            found = json.load(file)
    out = dict(defaults or {})
    for key, value in found.items():
        out[key] = {**out[key], **value} if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
