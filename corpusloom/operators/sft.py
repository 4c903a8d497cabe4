"""Instruction data: question-answer rows, prompts, chats and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# The tags of the chat form.
USER, ASSISTANT = "<|user|>\n", "<|assistant|>\n"


def qa_to_sft(rows: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    """title, desc, answer to instruction, input, output; rows with a blank title or answer go."""
    good = (strip(F.coalesce("title", F.lit(""))) != "") & (strip(F.coalesce("answer", F.lit(""))) != "")
    out = rows.where(good)
    out = out.orderBy(order).limit(limit) if limit else out
    keep = [c for c in out.columns if c not in ("title", "desc", "answer")]
    return out.select(*keep, F.col("title").alias("instruction"), F.coalesce("desc", F.lit("")).alias("input"), F.col("answer").alias("output"))


def prompt(template: str = "alpaca", instruction: str = "instruction", given: str = "input", output: str = "output") -> tuple[Column, Column]:
    """(prompt, full text) of a template: alpaca, chat or simple; missing fields are empty."""
    i, x, o = (F.coalesce(F.col(c), F.lit("")) for c in (instruction, given, output))
    if template == "alpaca":
        asked = F.concat(F.lit("### Instruction:\n"), i, F.when(x != "", F.concat(F.lit("\n\n### Input:\n"), x)).otherwise(""), F.lit("\n\n### Response:\n"))
        return asked, F.concat(asked, o)
    if template == "chat":
        full = F.concat(F.lit(USER), i, F.when(x != "", F.concat(F.lit("\n"), x)).otherwise(""), F.lit("\n" + ASSISTANT), o, F.lit("\n"))
        # the prompt ends where the output is found first
        return F.substring(full, F.lit(1), F.position(o, full) - 1), full
    asked = F.concat(F.lit("Instruction: "), i, F.lit("\n"), F.when(x != "", F.concat(F.lit("Input: "), x, F.lit("\n"))).otherwise(""), F.lit("Output: "))
    return asked, F.concat(asked, o)


def render_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): user and assistant turns in order; other roles are left out."""
    said = turns.where(F.col("role").isin("user", "assistant"))
    body = F.concat(F.when(F.col("role") == "user", F.lit(USER)).otherwise(F.lit(ASSISTANT)), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", body.alias("body")))).alias("t"))
    return rows.select("conv_id", F.size("t").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["body"]), "").alias("text"))


def labels(full: Column, prompt_tokens: Column, length: int) -> tuple[Column, Column]:
    """(ids, labels): the whole cut to ``length``, and the same with the prompt's places masked."""
    ids = F.slice(full, F.lit(1), F.lit(length))
    masked = F.transform(ids, lambda x, i: F.when(i < F.size(prompt_tokens), F.lit(-100)).otherwise(x))
    return ids, masked
