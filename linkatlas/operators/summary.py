"""Prompts, summaries through a pluggable batch provider, and the offline default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkatlas.operators.skew import salted_join, top_per_group

# What stands in for a summary that did not come, the shape of a chat reply,
# characters of content per token of the budget.
EMPTY_SUMMARY = "Описание не сформировано: LLM не вернул содержимое"
FAILED_SUMMARY = "Ошибка генерации описания: "
REPLY = "choices array<struct<message: struct<content: string>>>, error struct<message: string, type: string, code: string>"
CHARS_PER_TOKEN = 3
DEFAULT_TEMPLATE = "Опиши страницу в двух-трёх фразах.\n\nЗаголовок: {title}\n\n{content}\n"

Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def prompt(template: str, max_tokens: int, **fields: Column) -> Column:
    """Fill ``{title}`` and ``{content}``; the content is cut to three characters per token.

    The template is taken apart once, so braces inside a title or a text are never filled again.
    """
    cut = {**fields, "content": F.substring(fields["content"], 1, max_tokens * CHARS_PER_TOKEN)}
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(cut[name])
    return F.concat(*parts)


def load_template(spark: SparkSession, path: str) -> str:
    """The text of a template file, which any file system that Spark reads may hold. A missing file is an error, and so is a field that is not known."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"one template file expected at {path}, found {len(rows)}")
    unknown = {name for _, name, _, _ in Formatter().parse(rows[0][0]) if name is not None} - {"title", "content"}
    if unknown:
        raise ValueError(f"unknown fields in the template: {', '.join(sorted(unknown))}")
    return rows[0][0]


def provided_summaries(prompts: DataFrame, provider: Provider, concurrency: int | None = None) -> DataFrame:
    """Run a batch provider over ``(url, prompt)``; it yields frames ``(url, content, error)``.

    The provider is called in the partitions as they come, without a shuffle. ``concurrency`` is for a service that bears only so
    many callers: the prompts are then dealt evenly over that many partitions. Failures come back as rows.
    """
    shape = StructType([StructField(n, StringType()) for n in ("url", "content", "error")])
    asked = prompts.select("url", "prompt")
    replies = (asked if concurrency is None else asked.repartition(concurrency)).mapInPandas(provider, shape)
    return with_fallbacks(replies)


def with_fallbacks(replies: DataFrame) -> DataFrame:
    """Adds ``summary`` and ``summary_status`` (ok, empty, error) to ``content`` and ``error`` columns."""
    failed, empty = F.col("error").isNotNull(), F.col("content").isNull()
    return replies.withColumn(
        "summary", F.when(failed, F.concat(F.lit(FAILED_SUMMARY), "error")).otherwise(F.coalesce("content", F.lit(EMPTY_SUMMARY)))
    ).withColumn("summary_status", F.when(failed, "error").when(empty, "empty").otherwise("ok"))


def parse_replies(replies: DataFrame, body: str = "body") -> DataFrame:
    """Chat replies as JSON text: content, or the message of an error object; unreadable text is an error too."""
    reply = F.from_json(F.col(body), REPLY)
    first = F.get(F.col("_reply.choices"), F.lit(0))
    error = F.coalesce(F.col("_reply.error.message"), F.when(F.col("_reply.choices").isNull() | (F.size("_reply.choices") == 0), "no choices in reply"))
    parsed = replies.withColumn("_reply", reply).withColumn("content", first["message"]["content"]).withColumn("error", error)
    return with_fallbacks(parsed.drop("_reply"))


# ---------------------------------------------------------------- offline default

SENTENCE = r"[^.!?\n]+[.!?]*"
WORD = r"\p{L}+"


def sentences(text: Column) -> Column:
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: s != "")


def extractive_summaries(docs: DataFrame, key: str, text: str, top: int = 3) -> DataFrame:
    """The ``top`` sentences with the most common words of the corpus, in their order of appearance.

    A sentence scores the mean corpus count of its words. Word counts are partially aggregated; the join
    of words with their counts is salted, as a stop word may be a large part of all words. Sentences
    themselves stay out of that join and are picked from the text at the end. Documents without
    any word keep a NULL summary.
    """
    words = docs.select(key, F.posexplode(sentences(F.col(text))).alias("_i", "_s")).select(
        key, "_i", F.explode(F.regexp_extract_all(F.lower("_s"), F.lit(WORD), F.lit(0))).alias("_word"))
    corpus = words.groupBy("_word").agg(F.count(F.lit(1)).alias("_count"))
    scored = salted_join(words, corpus, ["_word"], "inner", [key, "_i"], hash_build=True,
                         sizes=corpus.select("_word", F.col("_count").alias("count"))).groupBy(key, "_i").agg(
        (F.sum("_count") / F.count(F.lit(1))).alias("_score"))
    best = top_per_group(scored, [key], [F.col("_score").desc(), F.col("_i")], top, ["_i"], "_rank")
    picks = best.groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_picks"))
    chosen = docs.select(key, sentences(F.col(text)).alias("_all")).join(picks, key, "left")
    return chosen.select(key, F.array_join(F.transform("_picks", lambda i: F.get("_all", i)), " ").alias("summary"))
