"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An
n-gram's vector binds (multiplies) the vectors of its letters, each permuted
(rotated) by its place; a text's vector bundles (adds) its n-grams. A
language's prototype bundles its texts, and a text is given the language whose
prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Vectors of n-grams that a task keeps, and that it gathers at once.
KEPT_GRAMS, GATHERED = 16_384, 4_096
#: Distinct labels up to which prototypes are fitted.
MAX_LANGUAGES = 10_000


@dataclass(frozen=True)
class Space:
    """Parameters of the vectors."""

    size: int = 1024
    n: int = 3
    seed: int = 7


class Encoder:
    """Vectors of texts; n-grams run over lower-cased letters, where every run
    of other characters, and either end, is one blank."""

    def __init__(self, space: Space):
        self.space = space
        self.kind = np.full(0x110000, -1, np.int8)  # of a code point: 1 letter, 0 other, -1 not seen yet
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int | tuple[int, ...], int] = {}
        self.table = np.empty((KEPT_GRAMS, space.size), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            draw = np.random.Generator(np.random.Philox(key=[self.space.seed, point]))
            self.letters[point] = (draw.integers(0, 2, self.space.size, np.int8) * 2 - 1).astype(np.int8)
        return self.letters[point]

    def points(self, text: str) -> np.ndarray | None:
        """Code points with blanks as 0; None for a text without letters."""
        p = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
        kind = self.kind[p]
        if (kind < 0).any():
            for c in np.unique(p[kind < 0]).tolist():
                self.kind[c] = chr(c).isalpha()
            kind = self.kind[p]
        if not kind.any():
            return None
        p = np.r_[0, np.where(kind == 1, p, 0), 0].astype(np.int64)
        return p[np.r_[True, (p[1:] != 0) | (p[:-1] != 0)]]

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The text's vector; None if it has no letter."""
        p = self.points(text) if text else None
        if p is None:
            return None
        n = self.space.n
        if len(p) < n:
            p = np.r_[p, np.zeros(n - len(p), np.int64)]
        if n <= 3:
            key = p[:len(p) - n + 1].copy()
            for k in range(1, n):
                key = key << 21 | p[k:len(p) - n + 1 + k]
            unique, counts = np.unique(key, return_counts=True)
            mask = (1 << 21) - 1
            grams = unique.tolist()
            unpack = lambda g: tuple(g >> 21 * k & mask for k in range(n - 1, -1, -1))
        else:
            unique, counts = np.unique(np.lib.stride_tricks.sliding_window_view(p, n), axis=0, return_counts=True)
            grams = list(map(tuple, unique.tolist()))
            unpack = lambda g: g
        out = np.zeros(self.space.size, np.float64)
        for at in range(0, len(grams), GATHERED):
            part = grams[at:at + GATHERED]
            if len(self.rows) + len(part) > KEPT_GRAMS:
                self.rows.clear()
            rows = self.rows
            for g in part:
                if g not in rows:
                    self.enter(g, unpack(g))
            index = np.fromiter(map(rows.__getitem__, part), np.int64, len(part))
            out += counts[at:at + len(part)].astype(np.float32) @ self.table[index]
        return out

    def enter(self, key: int | tuple[int, ...], gram: tuple[int, ...]) -> None:
        v = np.ones(self.space.size, np.int8)
        for place, point in enumerate(reversed(gram)):
            v = v * np.roll(self.letter(point), place)
        self.table[len(self.rows)] = v
        self.rows[key] = len(self.rows)


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; true for a null id, which is never learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def prototypes(labelled: DataFrame, space: Space = Space(), sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """One bundled vector for each label of the rows that are not held out.

    ``sample`` is the expected number of rows that a label's prototype is
    fitted on: all of a label's rows if it has no more, else each row by a
    hash of its id with the probability that makes it so many. Sums are taken
    in the tasks and per label and dimension, so labels * dimensions numbers
    reach the driver.
    """
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if not sizes:
        return {}
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))])
    picked = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(space.seed)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sums = Encoder(space), {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    v = encode(text)
                    if v is not None:
                        sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * space.size), pa.array(np.arange(space.size, dtype=np.int32)), pa.array(v)], ["lang", "dim", "x"])

    found = picked.select("lang", "text").mapInArrow(bundle, "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in found:
        out.setdefault(r["lang"], np.zeros(space.size))[r["dim"]] = r["x"]
    return dict(sorted(out.items()))


def languages(docs: DataFrame, learned: dict[str, np.ndarray], space: Space = Space(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its text alone, no shuffle.

    The score is the cosine with the chosen prototype, not below 0; ties go to
    the first label. A null text, one without letters, and any text where
    nothing was learned, is ``und`` with score 0. Null ids and repeated rows
    come out as they came in; other columns are not read.
    """
    names = list(learned)
    unit = np.stack([v / (np.linalg.norm(v) or 1) for v in learned.values()]) if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(space)
        for batch in batches:
            for part in slices(batch):
                lang, score = [], []
                for text in part.column(2).to_pylist():
                    v = encode(text) if names else None
                    length = 0 if v is None else np.linalg.norm(v)
                    if not length:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    near = unit @ v / length
                    k = int(near.argmax())
                    lang.append(names[k])
                    score.append(float(min(1.0, max(0.0, near[k]))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))
