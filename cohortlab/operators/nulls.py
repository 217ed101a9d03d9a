"""Null distribution of the AUC from counts.

Under permuted labels the positives of each distinct score follow a multivariate
hypergeometric law with the numbers of rows as colours, so a permutation is drawn
from the table of distinct scores, without a hash or an order of the rows. The draw
halves the table again and again: how many positives fall in the lower half is
hypergeometric, given how many there are in all. The upper levels of that tree
(blocks of distinct scores) are drawn first, then each block by itself.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import BROADCAST_BYTES, cumulative

# Executors need not have this module: what runs in tasks is sent with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Blocks are at least this many distinct scores, and there are at most MAX_BLOCKS of them.
BLOCK_SCORES = 4096
MAX_BLOCKS = 65536
# Permutations drawn together, as long as a block's table has at most CELLS cells.
CHUNK = 256
CELLS = 1 << 22
# numpy draws from populations below this size; larger ones go by summed probabilities.
NUMPY_LIMIT = 10 ** 9
# Rank sums are added as two longs of this many low bits and the rest, so no sum overflows.
LOW_BITS = 20


def large_hypergeometric(good: int, bad: int, sample: int, u: float) -> int:
    """The quantile at ``u`` of the number of good ones in a sample. Probabilities
    are taken relative to the mode by their exact ratios, 14 standard deviations
    to each side (beyond, they are below what a double ``u`` can tell apart)."""
    low, high = max(0, sample - bad), min(sample, good)
    total = good + bad
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    share = good / total if total else 0.0
    reach = int(14 * (sample * share * (1 - share) * max(total - sample, 0) / max(total - 1, 1)) ** 0.5) + 64
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(log_p - log_p[mode - first]))
    return first + int(np.searchsorted(p, u * p[-1], side="right").clip(0, len(p) - 1))


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Good ones in samples without replacement; the arguments are broadcast."""
    good, bad, sample = np.broadcast_arrays(good, bad, sample)
    large = (good >= NUMPY_LIMIT) | (bad >= NUMPY_LIMIT)
    if not large.any():
        return rng.hypergeometric(good, bad, sample)
    out = np.zeros(good.shape, np.int64)
    out[~large] = rng.hypergeometric(good[~large], bad[~large], sample[~large])
    out[large] = [large_hypergeometric(int(g), int(b), int(s), u)
                  for g, b, s, u in zip(good[large], bad[large], sample[large], rng.random(int(large.sum())))]
    return out


def deal(rng: np.random.Generator, sizes: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """For each of ``samples`` a multivariate hypergeometric draw: how many come
    from each colour, of which there are ``sizes``. One row a sample."""
    width = 1 << max(0, len(sizes) - 1).bit_length()
    levels = [np.concatenate([sizes, np.zeros(width - len(sizes), np.int64)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    drawn = np.asarray(samples, np.int64)[:, None]
    for below in levels[-2::-1]:
        halves = np.empty((len(drawn), len(below)), np.int64)
        halves[:, 0::2] = hypergeometric(rng, below[0::2], below[1::2], drawn)
        halves[:, 1::2] = drawn - halves[:, 0::2]
        drawn = halves
    return drawn[:, :len(sizes)]


def null_auc_from_counts(df: DataFrame, label: str, score: str, n_permutations: int, seed: int = 0) -> DataFrame:
    """AUC of fixed scores under ``n_permutations`` random permutations of
    the labels. Returns ``(perm, auc)``; rows with a NULL label or a score that is
    NULL or NaN are left out. With no row of one class the AUC is NULL; an empty
    frame gives a NULL for each permutation.

    The cost is permutations x distinct scores; the rows are read once for their
    counts by score. The stream of a block and chunk of permutations is seeded by
    their numbers, so a task that runs again draws the same.
    """
    spark = df.sparkSession
    base = df.where(F.col(label).isNotNull()).select((F.col(label) == 1).cast("long").alias("_y"), F.col(score).cast("double").alias("_s"))
    base = base.where(F.col("_s").isNotNull() & ~F.isnan("_s"))
    counted = cut_lineage(base.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_y")))
    whole = counted.agg(F.sum("_n"), F.sum("_y"), F.count(F.lit(1))).first()
    n, n1, distinct = (int(x or 0) for x in whole)
    perms = spark.range(n_permutations).select(F.col("id").cast("int").alias("perm"))
    if n1 in (0, n):
        return perms.select("perm", F.lit(None).cast("double").alias("auc"))
    width = max(BLOCK_SCORES, -(-distinct // MAX_BLOCKS))
    chunk = max(1, min(CHUNK, CELLS // width))

    scores = cumulative(counted, [], "_s", weight="_n").select("_s", F.col("_tie").alias("n"), (2 * F.col("_cum") - F.col("_tie") + 1).alias("twice"))
    if distinct > width:
        place = cumulative(counted.select("_s"), [], "_s").select("_s", F.floor((F.col("_cum") - 1) / width).cast("long").alias("block"))
        scores = scores.join(place, "_s")
    else:
        scores = scores.withColumn("block", F.lit(0).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct("_s", "n", "twice")))
    blocks = cut_lineage(scores.groupBy("block").agg(ordered.alias("x")).select(
        "block", F.col("x.n").alias("sizes"), F.col("x.twice").alias("twice"), F.aggregate("x.n", F.lit(0).cast("long"), lambda a, b: a + b).alias("rows")))
    # At most MAX_BLOCKS rows of two numbers.
    found = sorted(blocks.select("block", "rows").collect())
    numbers, rows = [r[0] for r in found], np.array([r[1] for r in found], np.int64)
    chunks = -(-n_permutations // chunk)

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                some = np.full(min(chunk, n_permutations - c * chunk), n1, np.int64)
                drawn = deal(np.random.default_rng([seed, c]), rows, some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), pa.array([c] * len(numbers), pa.int64()), pa.array(list(drawn.T), pa.list_(pa.int64()))],
                    ["block", "chunk", "positives"])

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, c = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                positives, sizes, twice = (np.asarray(batch.column(j)[i].values) for j in (2, 3, 4))
                drawn = deal(np.random.default_rng([seed, c, block + 1]), sizes, positives)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(drawn), dtype=np.int32) + c * chunk), pa.array(drawn @ (twice >> LOW_BITS)), pa.array(drawn @ (twice & ((1 << LOW_BITS) - 1)))],
                    ["perm", "high", "low"])

    parts = max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism))
    above = spark.range(0, chunks, 1, parts).mapInArrow(upper, "block long, chunk long, positives array<long>")
    tables = blocks.select("block", "sizes", "twice")
    if len(found) * width * 16 <= BROADCAST_BYTES:
        tables = F.broadcast(tables)
    else:
        # Named numbers of partitions: the work is in the draws, not in the bytes that AQE would merge by.
        parts = max(parts, len(found) // 4)
        above, tables = above.repartition(parts, "block"), tables.repartition(parts, "block")
    joined = above.join(tables, "block").select("block", "chunk", "positives", "sizes", "twice")
    sums = joined.mapInArrow(lower, "perm int, high long, low long").groupBy("perm").agg(F.sum("high").alias("_h"), F.sum("low").alias("_l"))
    rank_sum = (F.col("_h").cast("double") * float(1 << LOW_BITS) + F.col("_l")) / 2.0
    return sums.select("perm", ((rank_sum - F.lit(n1 * (n1 + 1) / 2.0)) / F.lit(float(n1 * (n - n1)))).alias("auc"))


def null_variance(df: DataFrame, label: str, score: str) -> DataFrame:
    """The variance of the AUC under permuted labels, with the correction for
    equal scores: ``(n1, n0, variance)``; NULL with no row of one class."""
    base = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ties = base.groupBy(score).agg(F.count(F.lit(1)).cast("double").alias("t"), F.sum((F.col(label) == 1).cast("long")).alias("y"))
    t = F.col("t")
    g = ties.agg(F.sum("y").cast("double").alias("n1"), (F.sum("t") - F.sum("y")).alias("n0"), F.sum("t").alias("N"), F.sum(t * t * t - t).alias("T"))
    variance = F.try_divide(F.col("N") + 1 - F.try_divide(F.col("T"), F.col("N") * (F.col("N") - 1)), 12 * F.col("n1") * F.col("n0"))
    return g.select(F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"), variance.alias("variance"))
