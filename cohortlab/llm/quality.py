"""Quality rules: word, line and symbol counts plus compression bands.

The verdict of the method comes from zstandard ratios (compressed bytes over
UTF-8 bytes) of the whole text and of its fixed chunks. Repetitive text
compresses far better than prose, random text hardly at all, and a short text
carries the fixed cost of a frame, so the accepted band depends on the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

WHITE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


@dataclass(frozen=True)
class Band:
    """Texts of ``min_bytes`` or more (up to the next band) keep ratios in [low, high]."""

    min_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules.

    ``bands``: whole texts by length; shorter ones than the first band get no
    verdict from the ratio. ``chunk_low``/``chunk_high``: band of each chunk of
    ``chunk_bytes``; what is left after the full chunks is judged by a last
    chunk of that size that ends where the text ends. A text goes when more
    than ``chunk_share`` of its chunks lie outside. A text shorter than a chunk
    is one chunk by itself, judged by its length's band alone. ``min_words``,
    ``repeat_percent``: the base rules.
    """

    bands: tuple[Band, ...] = (Band(200, 0.35, 0.95), Band(600, 0.28, 0.85), Band(2400, 0.22, 0.72))
    chunk_bytes: int = 4096
    chunk_low: float = 0.22
    chunk_high: float = 0.75
    chunk_share: float = 0.25
    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) > 2_000_000:  # the third factor would leave 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    inside = np.zeros(len(w), bool)
    for k in range(3):
        inside[k:k + len(again)] |= again
    return int(inside.sum())


def ratios(text: bytes, limits: Limits, zip_: zstandard.ZstdCompressor) -> tuple[float | None, int, int]:
    """Ratio of the whole text (None if empty), its chunks, and those outside the chunk band."""
    if not text:
        return None, 0, 0
    size, bad = limits.chunk_bytes, 0
    starts = [*range(0, len(text) - size + 1, size)]
    if starts and len(text) % size:
        starts.append(len(text) - size)
    for at in starts:
        bad += not limits.chunk_low <= len(zip_.compress(text[at:at + size])) / size <= limits.chunk_high
    return len(zip_.compress(text)) / len(text), len(starts), bad


def judge(text: bytes | None, limits: Limits, zip_: zstandard.ZstdCompressor) -> tuple:
    """The columns after doc_id for one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.decode()) - sum(text.count(x) for x in WHITE)
    symbols = sum(text.count(x) for x in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    base_failed = n < limits.min_words or 100 * repeated > limits.repeat_percent * n
    ratio, full, bad = ratios(text, limits, zip_)
    band = next((b for b in reversed(limits.bands) if len(text) >= b.min_bytes), None)
    fits = band is None or band.low <= ratio <= band.high
    kept = not base_failed and fits and bad <= limits.chunk_share * full
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, base_failed, kept, ratio, full, bad


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Counts, base rules and verdict of every row of ``docs``, one row each, no shuffle.

    Words are runs of other characters than space and U+0009 to U+000D. A null
    text counts as empty: zero counts, no ratio, ``base_failed`` and not kept.
    Null ids and repeated rows come out as they came in; other columns are not
    read, whatever their names. A text is held whole in one task and no other
    state is kept, so memory is bounded by the Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=limits.level)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        kinds = [types[x.split()[1]] for x in SCHEMA.split(", ")]
        for batch in batches:
            for part in slices(batch):
                rows = [judge(t, limits, zip_) for t in as_bytes(part.column(1))]
                columns = [part.column(0), *(pa.array([r[k] for r in rows], kinds[k + 1]) for k in range(len(names) - 1))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The verdict is computed from the text alone, row by row, so null or
    repeated ids do not matter.
    """
    def kept(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        zip_ = zstandard.ZstdCompressor(level=limits.level)
        for t in texts:
            yield pa.array([judge(x, limits, zip_)[6] for x in as_bytes(t)], pa.bool_())

    return docs.where(F.arrow_udf(kept, "boolean")(docs[text_col].cast("string")))
