"""Cutting texts into overlapping windows, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import sha256_hex, trim_space

SIZE, OVERLAP = 1200, 200


def window_chunks(texts: DataFrame, id: str = "id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``id, ordinal, content, content_hash``: windows of ``size`` characters that share ``overlap`` with the next.

    The last window ends with the text. Windows are trimmed, blank ones left out, and the rest counted from 0. Null and
    empty texts have none. The windows of a text are made within its row: no shuffle.
    """
    step = size - overlap
    length = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((length - size) / step)).cast("int")
    starts = F.sequence(F.lit(0), last)
    pieces = F.transform(starts, lambda i: trim_space(F.substring(F.col(text), i * step + 1, F.lit(size))))
    kept = F.filter(pieces, lambda p: p != "")
    rows = texts.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(id).alias("id"), F.posexplode(kept).alias("ordinal", "content"))
    return rows.withColumn("content_hash", sha256_hex(F.col("content")))
