"""Cutting oversized chunks into pieces under their token limit, at natural boundaries, with overlap and start lines.

Limits, token counts and the choice of oversized rows are expressions in the JVM; only oversized texts reach Python, where
one regular expression with bounded quantifiers finds each cut: its alternatives, strongest boundary first, consume from
half a window up to the whole, and the last takes the window as it is. It returns offsets; pieces are then cut and numbered
with SQL's array functions. A row's cost is linear in its text, rows are independent and there is no shuffle but one by id.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A token is one Han character of the basic block or a longest run of these ASCII characters.
TOKEN = r"[一-鿿]|[A-Za-z0-9_./:\-]+"
DEFAULT_LIMIT = 800
DEFAULT_OVERLAP = 0
_TOKEN = re.compile(TOKEN)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def number_in(metadata: Column, key: str, default: int, least: int) -> Column:
    """A whole number of the JSON metadata, also one in quotes; the default if absent, null, unreadable or below ``least``."""
    raw = F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "string")
    value = F.when(raw.rlike(r"^\s*\+?\d{1,9}(\.\d*)?\s*$"), F.expr("1.0d") * F.trim(raw).try_cast("double"))
    return F.when(value >= least, F.floor(value)).otherwise(F.lit(default)).cast("int")


@lru_cache(maxsize=64)
def boundaries(low: int, high: int) -> re.Pattern[str]:
    """Blank line, before a heading, after a statement's line, line, sentence, gap; each after ``low`` to ``high`` characters."""
    run = f".{{{low},{high}}}"
    ends = [r"\n[ \t\r]*\n\s*", r"\n(?=\#{1,6}[ \t])", r"[;}][ \t]*\r?\n", r"\n", r"(?:[.!?][\"')\]]*\s+|[。！？；][”’」]*)", r"\s+"]
    return re.compile("|".join(f"{run}{end}" for end in ends), re.S)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, new) of the pieces: text[start:end] has at most ``limit`` tokens, and its new part begins at ``new``.

    The new parts join to the whole text. The overlap is what the previous piece ends with: as many tokens as asked, but at
    most half the limit, so that every piece brings something new.
    """
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in spans]
    if len(spans) <= limit:
        return [(0, len(text), 0)]
    overlap = max(0, min(overlap, limit // 2))
    pieces, new = [], 0
    while new < len(text):
        first = bisect_left(starts, new)
        back = min(overlap, first) if pieces else 0
        start = starts[first - back] if back else new
        beyond = first + limit - back
        if beyond >= len(spans):
            end = len(text)
        else:
            window = starts[beyond]
            size = window - new
            power = max(size // 2, 1).bit_length() - 1
            found = boundaries(1 << power, 1 << (power + 3)).match(text, new, window) if size > 1 else None
            end = found.end() if found and bisect_left(starts, found.end()) > first else window
        pieces.append((start, end, new))
        new = end
    return pieces


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("fresh", pa.int32()), ("line", pa.int32())]))
    for batch in batches:
        out = []
        for text, limit, overlap in zip(batch["content"].to_pylist(), batch["limit"].to_pylist(), batch["overlap"].to_pylist()):
            row, at, line = [], 0, 0
            for start, end, new in cuts(text, limit, overlap):
                line += text.count("\n", at, start) if start >= at else -text.count("\n", start, at)
                at = start
                row.append({"start": start, "size": end - start, "fresh": new - start, "line": line})
            out.append(row)
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in batch.schema.names], pa.array(out, kind)], [*batch.schema.names, "pieces"])


def oversized(chunks: DataFrame, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The active chunks with more tokens than their limit, the latest row of each id; null ids and contents are left out."""
    limit = number_in(F.col("metadata"), "max_tokens", default_limit, 1)
    rows = chunks.where((F.col("status") == "active") & F.col("id").isNotNull() & F.col("content").isNotNull()).select(
        F.col("id").alias("chunk_id"), "content", "start_line", "updated_at", limit.alias("limit"),
        number_in(F.col("metadata"), "overlap_tokens", DEFAULT_OVERLAP, 0).alias("overlap"),
    )
    big = rows.where((F.length("content") > F.col("limit")) & (token_count(F.col("content")) > F.col("limit")))
    rest = F.struct("content", "start_line", "limit", "overlap")
    return big.groupBy("chunk_id").agg(F.max_by(rest, F.struct("updated_at", "content")).alias("r")).select("chunk_id", "r.*")


def pieces(chunks: DataFrame, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(chunk_id, piece, content, start_line, start_offset, overlap_chars, tokens) of every oversized active chunk.

    ``piece`` counts from 0; ``start_line`` is the line of the piece's first character, null where the chunk's is null;
    a line ends with a line feed, so CRLF counts once. Chunks at or under their limit have no row.
    """
    big = oversized(chunks, default_limit)
    schema = "chunk_id string, content string, start_line int, limit int, overlap int, pieces array<struct<start: int, size: int, fresh: int, line: int>>"
    cut_up = big.mapInArrow(_offsets, schema).select("*", F.posexplode("pieces").alias("piece", "p"))
    text = F.substring(F.col("content"), F.col("p.start") + 1, F.col("p.size"))
    return cut_up.select(
        "chunk_id", F.col("piece").cast("long").alias("piece"), text.alias("content"), (F.col("start_line") + F.col("p.line")).alias("start_line"),
        F.col("p.start").alias("start_offset"), F.col("p.fresh").alias("overlap_chars"), token_count(text).cast("long").alias("tokens"), "limit",
    )
