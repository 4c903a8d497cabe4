"""Ids of texts by a given tokenizer file, with the padded call; tokenizers are read, never trained."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tokens import padded

# Special tokens and the ids they have where the file lacks them.
SPECIAL = {"unk_token": ("<unk>", 0), "pad_token": ("<pad>", 1), "bos_token": ("<s>", 2), "eos_token": ("</s>", 3)}


def load(path: str):
    """A tokenizer from a file, or from tokenizer.json of a folder."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join(path, "tokenizer.json") if os.path.isdir(path) else path)


def special_ids(tokenizer) -> dict[str, int]:
    return {f"{name}_id": tokenizer.token_to_id(token) or default for name, (token, default) in SPECIAL.items()}


def save(path: str, folder: str) -> None:
    """A folder with tokenizer.json, its special tokens and its merges, from the file at ``path``."""
    tokenizer = load(path)
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, "tokenizer.json")
    source = os.path.join(path, "tokenizer.json") if os.path.isdir(path) else path
    if os.path.abspath(source) != os.path.abspath(target):
        shutil.copyfile(source, target)
    with open(os.path.join(folder, "tokenizer_config.json"), "w", encoding="utf-8") as file:
        json.dump({name: token for name, (token, _) in SPECIAL.items()} | special_ids(tokenizer), file, ensure_ascii=False, indent=2)
    with open(target, encoding="utf-8") as file:
        merges = json.load(file).get("model", {}).get("merges", [])
    with open(os.path.join(folder, "merges.txt"), "w", encoding="utf-8") as file:
        file.writelines(f"{m if isinstance(m, str) else ' '.join(m)}\n" for m in merges)


def encode(texts: DataFrame, path: str, text: str = "text", to: str = "ids", add_special_tokens: bool = True) -> DataFrame:
    """Adds ``to``: the ids of each text (null: none) by the file at ``path``, which every worker has; one narrow pass in Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load(path)
        for part in parts:
            found = tokenizer.encode_batch([x or "" for x in part], add_special_tokens=add_special_tokens)
            yield pd.Series([e.ids for e in found], dtype=object)

    return texts.withColumn(to, run(F.col(text)))


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "text", skip_special_tokens: bool = False) -> DataFrame:
    """Adds ``to``: the texts of ids."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load(path)
        for part in parts:
            yield pd.Series(tokenizer.decode_batch([[] if x is None else list(x) for x in part], skip_special_tokens=skip_special_tokens), dtype=object)

    return rows.withColumn(to, run(F.col(ids)))


def called(rows: DataFrame, pad: int, ids: str = "ids", width: Column | None = None, max_length: int | None = None, truncation: bool = False) -> DataFrame:
    """Adds input_ids and attention_mask: ids cut to ``max_length`` with ``truncation``, and filled with ``pad`` to ``width`` where given.

    The mask has a one for each id other than ``pad``, then zeros.
    """
    cut = F.slice(ids, F.lit(1), F.lit(max_length)) if truncation and max_length else F.col(ids)
    if width is not None:
        most = F.least(width, F.lit(max_length)) if max_length else width
        cut = F.when(F.size(cut) < most, padded(cut, most, F.lit(pad))).otherwise(cut)
    out = rows.withColumn("input_ids", cut)
    real = F.size(F.filter("input_ids", lambda x: x != pad))
    return out.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.size("input_ids") - real)))
