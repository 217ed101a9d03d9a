"""Spelling variants: words one edit apart, and the frequent form each rare one belongs to.

Candidates come from asymmetric chunks. A word of length L contributes its two
halves, each with its place; the other word, of length L or L + 1, its grams of
those lengths. One inserted, deleted or replaced character leaves one half as
it is, at the same place if it is the first and shifted by the difference of
the lengths (none or one) if it is the second, so only the grams at these
places are dealt out. Words that meet in a half are compared exactly.

Where very many words share a half, they meet again in finer chunks: the other
half is cut in two, one of which is preserved too, and so on down to single
characters, where no more words can meet than there are letters. So the work
for a key is bounded, and no word is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, as_bytes, slices, stage

#: Shortest word, least occurrences, and how many times more often a form occurs than its variant.
LENGTH, LEAST, TIMES = 7, 2, 10
#: Words that meet under one key before they are dealt out by finer ones.
MEET = 128
#: Distinct words a task counts before it passes them on.
KEPT_WORDS = 300_000
#: One run in so many loses a character, by its hash.
DAMAGE = 31


def results(doc_id: str, text: bytes, shortest: int, damage: int = DAMAGE) -> Iterator[tuple[str, int]]:
    """(word, times) of a text: its lower-cased runs of letters, some with a character deleted."""
    begin = zlib.crc32(f"{doc_id}:".encode())
    letters = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)
    for run, times in Counter(letters.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), begin)
        if damage and h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < shortest:
                continue
        yield run, times


def words(rows: DataFrame, shortest: int = LENGTH, least: int = LEAST, damage: int = DAMAGE) -> DataFrame:
    """(word, n) over all of ``rows(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                    for word, times in results(doc_id, text or b"", shortest, damage):
                        found[word] += times
                    if len(found) > KEPT_WORDS:
                        yield out()
        yield out()

    return rows.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _left_out(word: Column, size: Column, longer: Column, pieces: int, piece: Column) -> Column:
    """The word without one of its pieces, as a word of length ``size`` is cut; ``longer`` is what this one has more."""
    begin, end = (F.floor((piece + k) * size / pieces).cast("int") for k in (0, 1))
    return F.concat(F.substr(word, F.lit(1), begin), F.lit("\x00"), F.substr(word, end + longer + 1, F.length(word)))


def near_pairs(found: DataFrame, meet: int = MEET) -> DataFrame:
    """(a, a_n, b, b_n), each pair of ``found(word, n)`` within one edit once, words distinct."""
    # Each word as one of its own length, and as one that is a character longer than the other.
    rows = found.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    rows = rows.withColumn("size", F.length("word") - F.col("longer")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("piece"))
    pieces, parts, made = 2, None, []
    while True:
        keyed = rows.withColumn("key", F.xxhash64("size", "piece", _left_out(F.col("word"), F.col("size"), F.col("longer"), pieces, F.col("piece"))))
        by_key = Window.partitionBy("key")
        met = Stage(keyed.withColumn("met", F.count("*").over(by_key)).withColumn("own", F.count(F.when(F.col("longer") == 0, 1)).over(by_key))
                    .where("met > 1 AND own > 0").drop("own"))
        made.append(met)
        whole = (F.col("met") <= meet) | (F.col("size") <= pieces)
        few = met.df.where(whole)
        a = few.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = few.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
        pairs = a.join(b, "key").where("(longer = 1 OR a < b) AND levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n")
        parts = pairs if parts is None else parts.unionByName(pairs)
        rows = met.df.where(~whole).select("word", "n", "longer", "size", F.explode(F.array(F.col("piece") * 2, F.col("piece") * 2 + 1)).alias("piece"))
        if rows.isEmpty():
            break
        pieces *= 2
    out = stage(parts.dropDuplicates(["a", "b"]))
    for each in made:
        each.drop()
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: each round doubles the steps taken.
    Counts rise along the way, so it ends."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = LENGTH, least: int = LEAST,
             times: int = TIMES, damage: int = DAMAGE, meet: int = MEET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``shortest`` or more characters and ``least`` or more occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z
    lower-cased; a run whose crc32 of ``<id>:<run>`` is a multiple of
    ``damage`` loses one character (0: none does). Two words are near if one
    inserted, deleted or replaced character makes them equal. A word's form is
    its near word of most occurrences (ties: the smallest), if that has at
    least ``times`` as many, else null; its root is the last form reached, or
    the word itself. Null texts and empty ones have no words; a null id counts
    as empty text, repeated rows count each; without words there are no rows.
    Other columns are not read.
    """
    doc_id = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    counted = Stage(words(docs.select(doc_id.alias("doc_id"), docs[text_col].cast("string").alias("text")), shortest, least, damage))
    found = counted.df
    pairs = near_pairs(found, meet)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = found.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * times
    judged = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = _roots(judged.where("form IS NOT NULL").select("word", "form"))
    out = stage(judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    counted.drop()
    return out
