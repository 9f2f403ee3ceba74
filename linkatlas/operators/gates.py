"""Gates before a summary is made: a page without content or text is a failed row, not a lost one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Why a link fails before any summary is made.
NO_CONTENT = "Не удалось загрузить контент: "
NO_TEXT = "Не удалось извлечь текст из контента: "


def gated(text: DataFrame) -> DataFrame:
    """Adds ``status`` and ``error`` to page text (columns ``url``, ``html``, ``text``)."""
    html, body = F.coalesce(F.col("html"), F.lit("")), F.col("text")
    error = F.when(html == "", F.concat(F.lit(NO_CONTENT), "url")).when(body == "", F.concat(F.lit(NO_TEXT), "url"))
    return text.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed"))
