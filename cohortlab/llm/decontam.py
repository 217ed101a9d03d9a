"""Benchmark decontamination with DataFrame functions only.

Documents are searched for windows of each benchmark item's own length in
words. A window is fingerprinted by SimHash over its weighted word shingles; a
multi-index over the blocks of the items' fingerprints finds every item within
the Hamming radius; the exact weighted similarity of the shingles decides.

Which windows are fingerprinted: every place and every length of an item is judged
by a bound. A window as similar as asked for shares with its item at least that
part of the item's weight, so the shingles in it that are of any item of its
length weigh at least that part of the lightest such item. Their weight is a running
sum over a document's places; all windows that reach the bound are laid, whatever the
order of their shingles, and no other window could pass. Laying names no item; the
multi-index does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Rows of a benchmark index up to which it is broadcast (its size is counted
#: first); beyond it the same join shuffles.
BROADCAST_ROWS = 200_000
BLOCKS, BLOCK_BITS = 4, 16


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; no words for a null or empty text."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean != "", F.split(clean, " "))


def grams(hashes: str, size: int) -> str:
    """SQL of the hashes of all runs of ``size`` words, by position."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(size))
    return f"CASE WHEN size({hashes}) >= {size} THEN transform(sequence(0, size({hashes}) - {size}), i -> xxhash64({size}, {parts})) END"


def weighted(words: str, size: int) -> str:
    """SQL of the distinct shingles with their weights: a shingle weighs its letters."""
    hashes = ", ".join(f"xxhash64({words}[i + {j}])" for j in range(size))
    letters = " + ".join(f"char_length({words}[i + {j}])" for j in range(size))
    return f"array_distinct(transform(sequence(0, size({words}) - {size}), i -> named_struct('g', xxhash64({size}, {hashes}), 'w', {letters})))"


#: SQL of the SimHash of an array ``s`` of (g, w): bit j is the sign of the
#: weights summed with the sign of bit j of each shingle's hash.
SIMHASH = """aggregate(sequence(0, 63), 0L, (acc, j) -> acc | IF(
    aggregate(s, 0L, (t, x) -> t + IF((shiftrightunsigned(x.g, j) & 1L) = 1L, x.w, -x.w)) > 0, shiftleft(1L, j), 0L))"""
WEIGHT = "aggregate({0}, 0L, (t, x) -> t + x.w)"


def blocks(fp: str) -> Column:
    """The (number, value) of each block of a fingerprint."""
    mask = (1 << BLOCK_BITS) - 1
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> named_struct('b', b, 'v', cast(shiftrightunsigned({fp}, b * {BLOCK_BITS}) & {mask}L AS int)))")


def items_of(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words, n, size, s, fp) of the different texts of items that have words and an id.

    ``item`` numbers the rows; it is fixed by being written once.
    """
    items = (benchmark.select(benchmark[id_col].cast("long").alias("item_id"), words_of(benchmark[text_col].cast("string")).alias("words"))
             .where("item_id is not null and words is not null").distinct()
             .withColumn("n", F.size("words")).withColumn("size", F.least("n", F.lit(size))))
    cases = " ".join(f"WHEN size = {k} THEN {weighted('words', k)}" for k in range(1, size + 1))
    return stage(items.withColumn("s", F.expr(f"CASE {cases} END")).withColumn("fp", F.expr(SIMHASH)).withColumn("item", F.monotonically_increasing_id()))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, radius: int = 15, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that it contains a copy of.

    Returns (key, doc_id, item_id, similarity, hamming, start, n_windows):
    the best window's similarity, its fingerprint's distance from the item's
    and its first word (from 0; ties: least distance, then first), and at how
    many places windows passed: windows of a text that start at adjacent words
    are one place, that of the best of them. A window passes when it is as long as the
    item (or is the whole of a shorter document), its fingerprint lies within
    ``radius`` and shared weight / weight of the union of the shingles is
    percent/100 or more. Items shorter than a shingle are their own only one.

    ``key`` is the id, or a hash of the text where the id is null (then
    ``doc_id`` is null too). Null and empty texts and items contain and match
    nothing. Rows with the same id are one document: its best window over all
    its texts counts, and a place counts once. Equal item rows count once; an
    item with several texts is found where any of them is. Empty tables give no
    rows. Only the named columns are read.

    Windows are laid without regard to which item asked for them: a place and a
    length is fingerprinted once, and the multi-index names the items, any within
    the radius, that its fingerprint is compared with. With b-bit blocks and a radius
    r, two fingerprints within r agree in one of the blocks up to r / blocks
    bits, so the items' blocks are entered under all values that near, and
    windows look up their own. Four wide blocks mean more entries an item than
    eight narrow ones (2788 and 72), but a sixth of the candidates a window, of
    which a corpus has more than a benchmark has items.
    """
    text = docs[text_col].cast("string")
    docs = docs.select(F.coalesce(docs[id_col].cast("long"), F.xxhash64(text)).alias("key"), docs[id_col].isNotNull().alias("named"), F.xxhash64(text).alias("of"), text.alias("text"))
    items = items_of(benchmark, size, item_col, item_text_col)
    small = items.count() * BLOCKS * 64 <= BROADCAST_ROWS
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``size`` values

    at = []
    for k in sizes or [size]:
        of_item = items.where(F.col("size") == k).select("n", "s", F.expr(WEIGHT.format("s")).alias("weight"))
        lightest = of_item.groupBy("n").agg(F.min("weight").alias("least"))
        index = stage(of_item.select("n", F.explode("s").alias("x")).select("n", "x.g", "x.w").distinct().join(lightest, "n"))
        if index.count() <= BROADCAST_ROWS:
            index = F.broadcast(index)
        hashed = docs.select("key", "named", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
        of_doc = hashed.select("key", "named", F.posexplode(F.expr(grams("h", k))).alias("in_doc", "g"))
        at.append(of_doc.join(index, "g").select("key", "named", F.lit(k).alias("size"), "n", "least", "in_doc", "w"))
    hits = at[0]
    for more in at[1:]:
        hits = hits.unionByName(more)
    # A hit weighs in the windows that start from n - size places before it up to its own place.
    steps = F.array(F.struct((F.col("in_doc") - F.col("n") + F.col("size")).alias("at"), F.col("w").alias("by")),
                    F.struct((F.col("in_doc") + 1).alias("at"), (-F.col("w")).alias("by")))
    length = ["key", "named", "size", "n", "least"]
    steps = hits.distinct().select(*length, F.explode(steps).alias("x")).groupBy(*length, "x.at").agg(F.sum("x.by").alias("by"))
    along = Window.partitionBy(*length).orderBy("at")
    enough = steps.select(*length, "at", (100 * F.sum("by").over(along) >= percent * F.col("least")).alias("enough"))
    turns = enough.withColumn("before", F.coalesce(F.lag("enough").over(along), F.lit(False))).where("enough != before")
    ranges = turns.withColumn("end", F.lead("at").over(along)).where("enough and end is not null")
    laid = stage(ranges.groupBy("key", "named").agg(F.collect_list(F.struct("size", "n", "at", "end")).alias("laid")))

    # The whole of a document shorter than several items is one window.
    some = F.expr("filter(laid, x -> x.n <= len OR x.n = array_min(transform(filter(laid, y -> y.n > len AND y.size = x.size), y -> y.n)))")
    first, last = F.expr("greatest(0, x.at)"), F.expr("least(x.end - 1, greatest(0, len - x.n))")
    short = laid.agg(F.sum(F.size("laid"))).first()[0] or 0
    words = docs.join(_small(laid, short <= BROADCAST_ROWS), ["key", "named"]).select("key", "named", "of", "laid", words_of(F.col("text")).alias("words")).withColumn("len", F.size("words"))
    windows = (words.select("key", "named", "of", "words", "len", F.explode(some).alias("x")).where(F.expr("least(x.n, len) >= x.size"))
               .select("key", "named", "of", "words", "len", "x.size", F.expr("least(x.n, len)").alias("n"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("start"))
               .select("key", "named", "of", "len", "size", "n", "start", F.expr("slice(words, start + 1, n)").alias("words")))
    cases = " ".join(f"WHEN size = {k} THEN {weighted('words', k)}" for k in (sizes or [size]))
    windows = windows.select("key", "named", "of", "len", "size", "n", "start", F.expr(f"CASE {cases} END").alias("s"))
    windows = stage(windows.withColumn("fp", F.expr(SIMHASH)))

    flips = f"filter(sequence(0, {(1 << BLOCK_BITS) - 1}), m -> bit_count(m) <= {radius // BLOCKS})"
    entries = (items.select("item", "size", F.col("n").alias("of_n"), F.col("fp").alias("of_item"), F.explode(blocks("fp")).alias("x"))
               .select("item", "size", "of_n", "of_item", "x.b", "x.v", F.explode(F.expr(flips)).alias("m"))
               .select("item", "size", "of_n", "of_item", "b", F.expr("v ^ m").alias("v")))
    asked = windows.select("fp", "size").distinct().select("fp", "size", F.explode(blocks("fp")).alias("x")).select("fp", "size", "x.b", "x.v")
    # Spark would guess the entries as small as the items and broadcast them, whatever they grow to.
    near = stage(asked.join(entries.hint("merge"), ["size", "b", "v"]).withColumn("hamming", F.expr("bit_count(fp ^ of_item)"))
                 .where(F.col("hamming") <= radius).select("fp", "size", "item", "of_n", "hamming").distinct())
    # A fingerprint may stand for windows of a third of all documents: few pairs go to the windows.
    named = windows.join(_small(near, near.count() <= BROADCAST_ROWS), ["fp", "size"]).where("n = least(of_n, len)")

    exact = (named.join(_small(items.select("item", "item_id", F.col("s").alias("t"), F.expr("transform(s, x -> x.g)").alias("tg")), small), "item")
             .withColumn("both", F.expr(WEIGHT.format("filter(s, x -> array_contains(tg, x.g))")))
             .withColumn("all", F.expr(WEIGHT.format("s")) + F.expr(WEIGHT.format("t")))
             .where((100 + percent) * F.col("both") >= percent * F.col("all"))
             .withColumn("similarity", F.col("both") / (F.col("all") - F.col("both"))))
    text_item = ["key", "named", "of", "item_id"]
    passed = exact.groupBy(*text_item, "start").agg(F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"))).alias("x"))
    along = Window.partitionBy(*text_item).orderBy("start")
    passed = passed.withColumn("apart", F.coalesce(F.col("start") - F.lag("start").over(along) > 1, F.lit(False)).cast("int"))
    places = passed.withColumn("place", F.sum("apart").over(along)).groupBy(*text_item, "place").agg(F.max("x").alias("x"))
    return (places.groupBy("key", "named", "item_id").agg(F.max("x").alias("x"), F.count_distinct("x.s").alias("n_windows"))
            .select("key", F.when(F.col("named"), F.col("key")).alias("doc_id"), "item_id", "x.similarity",
                    (-F.col("x.h")).alias("hamming"), (-F.col("x.s")).alias("start"), "n_windows"))


def _small(side: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(side) if small else side


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that contain no copy of an item, with all their columns."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **parameters).select(F.col("key").alias("__key")).distinct()
    key = F.coalesce(docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string")))
    return docs.join(found, key == F.col("__key"), "left_anti")
