"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Shingles are hashed into the bits
of a sketch by XOR, so the Hamming distance of two sketches is never more than
the size of the symmetric difference of the sets, and a block of the sketch
that no differing shingle falls into is equal in both. A link at similarity t
between sets of sizes a and b allows a symmetric difference of
(a + b)(1 - t)/(1 + t) at most; with more blocks than that, at least one block
of the pair is equal (pigeonhole), so documents are joined on equal blocks
within bands of size, and candidates are verified exactly.

Near copies can be very many. The join therefore runs in two rounds:

1. In every group of equal blocks each member is verified against the group's
   smallest id only (a star), and the components of the verified links are
   taken.
2. Groups whose members still lie in different components are compared in
   full, in tiles of bounded size, by the Hamming distance of the sketches;
   only pairs from different components that may link are verified.

Pairs that round 2 leaves out are in one component already, so the components
are exactly those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, as_bytes, kept, slices, stage
from .components import components

KEPT_WORDS = 300_000
#: Members of a group that one tile holds.
TILE = 512
#: Words of a folded sketch.
FOLDED = 32
#: Growth of the size bands, and spare blocks as a share of the needed ones.
RATIO, SPARE = 1.6, 0.15
CONTEXT_BITS = 8

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal input, equal output on every machine."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Digests(dict):
    """64-bit digests of words; long words are not kept."""

    def __missing__(self, word: bytes) -> bytes:
        out = xxhash.xxh3_64_digest(word)
        if len(word) <= 64:
            self[word] = out
        return out


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of other bytes than space and 0x09 to 0x0D, A-Z
    lower-cased. A text of fewer words than a shingle has its whole sequence
    as its only one; a text without words has none.
    """

    def __init__(self, size: int):
        self.size = size
        self.known = kept("word digests", Digests)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        h = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint64)
        k = min(n, self.size)
        acc = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            acc = mix(acc * _M1 + h[j:n - k + 1 + j])
        return np.unique(acc)


class Bands:
    """Size bands and the numbers that the pigeonhole argument needs.

    A pair belongs to the band of its smaller set, so a set of size n takes
    part in its own band and, as the larger set, in the bands whose sizes
    reach percent/100 of n.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.seen: dict[int, list[tuple[int, int, int]]] = {}

    @staticmethod
    def lows(top: int) -> list[int]:
        out = [1]
        while out[-1] <= top:
            out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
        return out

    def allowed(self, total: int) -> int:
        """Most elements in which two linked sets of ``total`` elements together differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, blocks of the band, most differences of this set) for a set of size n."""
        if n in self.seen:
            return self.seen[n]
        lows, out = self.lows(n), []
        for c in range(len(lows) - 1):
            low, last = lows[c], lows[c + 1] - 1
            if low > n or 100 * last < self.percent * n:
                continue
            partner = n * 100 // self.percent if n <= last else last
            most = self.allowed(n + partner)
            widest = self.allowed(last + last * 100 // self.percent)
            if most:
                out.append((c, widest + 1 + int(SPARE * widest), most))
        if len(self.seen) < 50_000:
            self.seen[n] = out
        return out


def sketch(s: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity word, XOR of hashes and number of shingles of each block.

    The high half of a shingle's hash picks its block, so the sorted hashes
    lie block by block; its low six bits pick the bit.
    """
    block = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    at = block[starts].astype(np.int64)
    parity, whole, count = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64), np.zeros(blocks, np.int64)
    parity[at] = np.bitwise_xor.reduceat(np.uint64(1) << (s & np.uint64(63)), starts)
    whole[at] = np.bitwise_xor.reduceat(s, starts)
    count[at] = np.diff(np.r_[starts, len(s)])
    return parity, whole, count


def block_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: band, block and content of its fullest blocks.

    At least (blocks - most) blocks of a linked pair are equal, and equal
    blocks hold equally many shingles. Fewer blocks than that are as empty as
    the ones left out here, in either set, so an equal block is always among
    the keys of both. Key and content hold the XOR of whole hashes besides
    the parity word: both are equal wherever the block is. The band is in the
    lowest bits.
    """
    out = []
    for c, blocks, most in bands.of(len(s)):
        parity, whole, count = sketch(s, blocks)
        least = np.sort(count)[blocks - most - 1]  # blocks - most of them hold this or less
        keep = np.flatnonzero(count >= least)
        key = mix(mix(mix(parity[keep] + _M1) + whole[keep]) + keep.astype(np.uint64) * _M2 + np.uint64(c))
        out.append((key & ~np.uint64((1 << CONTEXT_BITS) - 1)) | np.uint64(c))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def signatures(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(doc_id, n, fp, keys): number of shingles, 128-bit digest of the set (null if empty), block keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            for part in slices(batch):
                n, fp, keys = [], [], []
                for t in as_bytes(part.column(1)):
                    s = shingles(t)
                    n.append(len(s))
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    keys.append(block_keys(s, bands))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "fp", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, keys array<long>")


def shared(rows: DataFrame) -> DataFrame:
    """(key, leader, id) of the rows (key, id) whose key occurs again; the leader is the key's smallest id.

    Rows come sorted by key; they stream through and only the open run's
    leader is held, so a key may have any number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, leader, whether its first row is still held back
        for batch in batches:
            key, id_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            if not new[0]:
                run_of += 1
                first = np.r_[0, first]
            leaders = id_[first]
            held: list[tuple[int, int]] = []
            if not new[0]:
                leaders = leaders.copy()
                leaders[0] = last[1]
                if last[2]:
                    held = [(last[0], last[1])]
            sizes = np.bincount(run_of, minlength=len(first))
            if not new[0]:
                sizes[0] += 1
            out = sizes[run_of] > 1
            k, lead, i = key[out], leaders[run_of[out]], id_[out]
            if held:
                k, lead, i = np.r_[[held[0][0]], k], np.r_[[held[0][1]], lead], np.r_[[held[0][1]], i]
            last = (key[-1], leaders[-1], bool(sizes[-1] == 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, lead, i)], ["key", "leader", "id"])

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, leader long, id long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: exact sizes and intersections of the sets of hashes."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb")  # 100 * both >= percent * (total - both), with both once
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * small >= percent * large)
            .where((100 + percent) * both >= percent * total).select("a", "b"))


def close_pairs(pairs: DataFrame, words: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that their folded sketches allow to link, before any
    set is dealt out for them: lossless, as sketches never overstate."""
    left = words.select(F.col("id").alias("a"), "band", F.col("n").alias("na"), F.col("sketch").alias("wa"))
    right = words.select(F.col("id").alias("b"), "band", F.col("n").alias("nb"), F.col("sketch").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum(dtype=np.int64) <= bands.allowed(m + n)
                    for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(left, "a").join(right, ["b", "band"]).where(100 * F.least("na", "nb") >= bands.percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long").distinct()


def tiled(members: DataFrame) -> DataFrame:
    """Rows (key, ti, tj, ...) of ``members(key, id, ...)``: each group in tiles
    of about ``TILE`` members, each member in every pair of tiles with its own."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    own = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    out = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return out.withColumn("ti", F.least("own", "other")).withColumn("tj", F.greatest("own", "other")).drop("other", "tiles")


def near(rows: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) from different components in one tile pair whose sketches
    are as near as their sizes allow.

    ``rows`` are (key, ti, tj, own, id, comp, n, sketches); those of one tile
    pair follow each other and at most two tiles are held.
    """

    def close(cross: bool, ids: list, comps: list, own: list, ns: list, words: list) -> list[tuple[int, int]]:
        id_, comp, tile, n = (np.asarray(x, np.int64) for x in (ids, comps, own, ns))
        if (comp == comp[0]).all():
            return []
        w = np.stack(words)
        out = []
        for i in range(len(id_) - 1):
            j = i + 1 + np.flatnonzero((comp[i + 1:] != comp[i]) & ((tile[i + 1:] != tile[i]) | (not cross)))
            low, high = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
            j = j[100 * low >= bands.percent * high]
            if len(j):
                apart = np.bitwise_count(w[j] ^ w[i]).sum(axis=1, dtype=np.int64)
                j = j[apart <= (n[j] + n[i]) * (100 - bands.percent) // (100 + bands.percent)]
                out += [(min(id_[i], x), max(id_[i], x)) for x in id_[j].tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, ([], [], [], [], [])
        for batch in batches:
            found: list[tuple[int, int]] = []
            names = ("key", "ti", "tj", "id", "comp", "own", "n")
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            texts = batch.column(batch.schema.get_field_index("sketch"))
            for r, (key, ti, tj, *rest) in enumerate(zip(*columns, strict=True)):
                if (key, ti, tj) != open_:
                    if open_ is not None and len(held[0]) > 1:
                        found += close(open_[1] != open_[2], *held)
                    open_, held = (key, ti, tj), ([], [], [], [], [])
                for x, y in zip(held, (*rest, np.frombuffer(texts[r].as_py(), np.uint64)), strict=True):
                    x.append(y)
            yield pairs(found)
        if open_ is not None and len(held[0]) > 1:
            yield pairs(close(open_[1] != open_[2], *held))

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.asarray(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return (rows.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInArrow(run, "a long, b long").distinct())


def sketches(sets: DataFrame, bands: Bands) -> DataFrame:
    """(id, band, sketch, n): the parity words of every band that a set takes
    part in, folded by XOR to ``FOLDED`` words at most. Folding keeps the bound:
    a differing shingle still turns one bit. Groups and pairs then carry a few
    hundred bytes for a set of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                out = []
                for i, s in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    s = s.values.to_numpy().view(np.uint64)
                    out += [(i, c, folded(sketch(s, blocks)[0]).tobytes(), len(s)) for c, blocks, _ in bands.of(len(s))]
                columns = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["id", "band", "sketch", "n"])

    return sets.select("id", "s").mapInArrow(run, "id long, band long, sketch binary, n long")


def folded(words: np.ndarray) -> np.ndarray:
    if len(words) <= FOLDED:
        return words
    return np.bitwise_xor.reduce(np.pad(words, (0, -len(words) % FOLDED)).reshape(-1, FOLDED), axis=0)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, s): the sorted hashes of the documents (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            for part in slices(batch):
                s = [shingles(t).view(np.int64) for t in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.list_(pa.int64()))], ["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def similar(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's number of shingles and the smallest id that links reach.

    Returns (doc_id, n_shingles, component_id), one row for each row of
    ``docs``. Two documents link when 100 * intersection >= percent * union
    of their shingle sets. Equal sets are one class from the start and only
    its smallest id is joined, so copies are never paired. A text without
    words (or a null one) links with nothing and is its own component. Rows
    with the same id are one document: a link to either is a link to it. A
    row with a null id cannot be reached by a name; it gets its class's
    component, or null if no copy has an id. Other columns are not read. An
    empty table gives no rows.

    The rows that are dealt out are the keys of the fullest blocks, about
    n * (1 - t)/t of them for n shingles. Sets of hashes are only built for
    documents that share a key. Shingles are compared by 64-bit hashes.
    """
    bands = Bands(percent)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    full = Stage(signatures(docs, size, bands))
    rows = stage(full.df.select("doc_id", "n", "fp"))
    classes = stage(rows.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # Copies are few beside all documents, so it is their ids that are left out of the keys.
    copies = stage(rows.join(classes, "fp").where("doc_id <> rep").select("doc_id", "fp").distinct())
    keyed = full.df.where(F.col("doc_id").isNotNull() & (F.size("keys") > 0)).join(copies, ["doc_id", "fp"], "left_anti")
    members = stage(shared(keyed.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))))
    full.drop()

    wanted = members.select("id").distinct()
    texts = docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id"), F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text"))
    sets = stage(shingle_sets(texts.select("id", "text"), size))
    stars = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    words = stage(sketches(sets, bands))
    links = stage(verified(close_pairs(stars, words, bands), sets, percent))
    first = stage(components(links))

    placed = stage(members.select("key", "id").join(first.withColumnRenamed("node", "id"), "id", "left")
                   .select("key", "id", F.coalesce("component", "id").alias("comp")))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    open_ = placed.join(mixed, "key").withColumn("band", F.col("key").bitwiseAND(F.lit((1 << CONTEXT_BITS) - 1)))
    open_ = stage(open_)
    candidates = near(tiled(open_.join(words, ["id", "band"])), bands)
    more = stage(verified(candidates, sets, percent))

    # An id with several sets is one document, also where a copy's row was left out of the keys: it ties its classes.
    again = rows.where("fp is not null and doc_id is not null").select("doc_id", "fp").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("a"))
    of_several = copies.join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(again, "a", "left_semi")
    reached = stage(components(first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(of_several)))
    named = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return (rows.select("doc_id", "n", "fp").join(named, "fp", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, all columns.

    The document with the component's smallest id stays; of several rows with
    that id, the one with the smallest text (nulls first). Rows with a null
    id stay, since nothing can name their group.
    """
    found = similar(docs, size, percent, id_col, text_col)
    kept = found.where(F.col("component_id") == F.col("doc_id")).groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    joined = docs.join(kept, docs[id_col].cast("long") == F.col("__id"))
    single = joined.where("__n = 1").drop("__id", "__n")
    whole, text = F.struct(*(docs[c] for c in docs.columns)), F.col(text_col)
    several = (joined.where("__n > 1").groupBy("__id").agg(F.min_by(whole, F.struct(text.isNotNull(), text)).alias("__row"))
               .select(*(F.col("__row").getField(c).alias(c) for c in docs.columns)))
    return single.unionByName(several).unionByName(docs.where(docs[id_col].isNull()))
