"""How the sources of a language differ in their words: an exact recount over minimal perfect hashes.

First the rows of each (language, term) are counted exactly and rare terms go.
The kept terms of a language are dealt to shards; a task builds a minimal
perfect hash of each shard (levels of bits: a key rests at the first level
where no other key wants its bit, its slot is the rank of that bit), with the
keys in slot order. Batches of shards of a fixed total size are broadcast, and
a second pass over the texts finds the slot of every term by array operations,
compares the term with the key stored there byte by byte, and increments dense
counters for each group. Shares, divergences and ranks follow from the counts
of a shard, all sources side by side.

A term is hashed to 64 bits. Keys that share all of them, within a shard, are
moved to a short list that is searched by their bytes, so results are exact.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, as_bytes, kept, slices, stage

#: Letters and all other bytes than ASCII ones.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Distinct (language, term) pairs a task counts before it passes them on.
KEPT_TERMS = 400_000
#: Keys of a shard, about; bytes of the shards broadcast at once.
SHARD_KEYS, BROADCAST_BYTES = 4096, 64 << 20
#: Counters that a task holds at once.
DENSE = 12 << 20
#: Bits a key at each level, and the number of levels; keys left after them join the list.
GAMMA, LEVELS = 1.6, 24
#: Text bytes handled at once.
SLICE_BYTES = 1 << 20
#: Sources whose shares are compared at once.
BLOCK = 32
_ODD, _MIX1, _MIX2, _LEVEL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SCALE = 1_000_000_000


# ------------------------------------------------------------------- hashes
def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD to the powers 0..n-1 modulo 2^64, and their inverses; a worker keeps those of usual sizes."""
    size = 1 << max(16, (n - 1).bit_length())

    def make() -> tuple[np.ndarray, ...]:
        both = (_ODD, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in both)

    up, down = kept(("divergence powers", size), make) if size <= 4 * SLICE_BYTES else make()
    return up[:n], down[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of some bytes: a polynomial taken from sums over all bytes, then mixed with the size."""
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return mixed((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64) * _LEVEL)


def below(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The upper 32 bits of a hash, scaled to 0..size-1."""
    return ((h >> np.uint64(32)) * size.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def level_hash(h: np.ndarray, level: int) -> np.ndarray:
    return mixed(h + np.uint64((level + 1) * int(_LEVEL) % (1 << 64)))


def words_at(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k+7 of each span as a number, zero after its end; ``data`` has eight bytes more than the spans."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    found = np.ascontiguousarray(view[starts + 8 * k]).view("<u8").ravel()
    left = np.minimum(8, sizes - 8 * k).astype(np.uint64)
    return found & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of equal sizes hold the same bytes."""
    good, at, k = np.ones(len(sizes), bool), np.arange(len(sizes)), 0
    while len(at):
        some = words_at(a, a_starts[at], sizes[at], k) == words_at(b, b_starts[at], sizes[at], k)
        good[at[~some]] = False
        k += 1
        at = at[some]
        at = at[sizes[at] > 8 * k]
    return good


# -------------------------------------------------------- one shard's function
def build(keys: list[bytes]) -> dict:
    """A minimal perfect hash of distinct keys: bits of all levels on end, level
    sizes, keys in slot order, and the number of keys at the end that have no
    bit of their own (equal hashes, or left after the last level)."""
    data = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    starts = np.cumsum(sizes) - sizes
    h = span_hashes(data, starts, sizes)
    _, where, times = np.unique(h, return_inverse=True, return_counts=True)
    left = np.flatnonzero(times[where] == 1)
    order, bits, widths = [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        width = int(GAMMA * len(left)) // 64 * 64 + 64
        at = below(level_hash(h[left], level), np.full(len(left), width))
        alone = np.bincount(at, minlength=width) == 1
        rests = alone[at]
        bits.append(alone)
        widths.append(width)
        order.append(left[rests][np.argsort(at[rests])])
        left = left[~rests]
    placed = np.concatenate(order) if order else np.zeros(0, np.int64)
    rest = np.setdiff1d(np.arange(len(keys)), placed)
    packed = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
    by_slot = [keys[i] for i in [*placed, *rest]]
    return {"bits": packed.tobytes(), "widths": widths, "n": len(keys), "n_rest": len(rest), "keys": b"".join(by_slot), "sizes": np.fromiter(map(len, by_slot), np.int32, len(by_slot)).tobytes()}


class Tables:
    """Shards of one language side by side, for finding the slots of many spans at once."""

    def __init__(self, shards: list[dict]):
        self.total = shards[0]["shards"]
        place = np.full(self.total, -1, np.int64)
        place[[s["shard"] for s in shards]] = np.arange(len(shards))
        self.place = place
        self.bits = np.frombuffer(b"".join(s["bits"] for s in shards), "<u8")
        ranks = np.bitwise_count(self.bits).astype(np.int64)
        self.ranks = np.cumsum(ranks) - ranks
        widths = np.zeros((LEVELS, len(shards)), np.int64)
        for i, s in enumerate(shards):
            widths[:len(s["widths"]), i] = s["widths"]
        begin = np.concatenate([[0], np.cumsum(widths.T.ravel())[:-1]]).reshape(len(shards), LEVELS).T if len(shards) else widths
        self.widths, self.begin = widths, begin
        first = begin[0] // 64
        self.first_rank = self.ranks[np.minimum(first, len(self.ranks) - 1)] if len(self.ranks) else np.zeros(len(shards), np.int64)
        self.count = np.array([s["n"] for s in shards], np.int64)
        self.first_slot = np.cumsum(self.count) - self.count
        self.ids = np.array([s["shard"] for s in shards], np.int64)
        self.n = int(self.count.sum())
        self.keys = np.frombuffer(b"".join(s["keys"] for s in shards) + bytes(8), np.uint8)
        self.sizes = np.frombuffer(b"".join(s["sizes"] for s in shards), np.int32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.listed = {}
        for i, s in enumerate(shards):
            for slot in range(int(self.first_slot[i]) + s["n"] - s["n_rest"], int(self.first_slot[i]) + s["n"]):
                self.listed[bytes(self.keys[self.starts[slot]:self.starts[slot] + self.sizes[slot]])] = slot

    def slots(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each span among all shards, -1 if it is no key."""
        out = np.full(len(h), -1, np.int64)
        shard = self.place[below(h, np.full(len(h), self.total))]
        at = np.flatnonzero(shard >= 0)
        for level in range(LEVELS):
            at = at[self.widths[level][shard[at]] > 0]
            if not len(at):
                break
            s = shard[at]
            bit = self.begin[level][s] + below(level_hash(h[at], level), self.widths[level][s])
            word, low = self.bits[bit >> 6], (bit & 63).astype(np.uint64)
            on = (word >> low) & np.uint64(1) == 1
            rank = self.ranks[bit[on] >> 6] + np.bitwise_count(word[on] & ((np.uint64(1) << low[on]) - np.uint64(1)))
            out[at[on]] = rank - self.first_rank[s[on]] + self.first_slot[s[on]]
            at = at[~on]
        found = np.flatnonzero(out >= 0)
        found_slots = out[found]
        fits = self.sizes[found_slots] == sizes[found]
        out[found[~fits]] = -1
        found, found_slots = found[fits], found_slots[fits]
        out[found[~same_spans(data, starts[found], self.keys, self.starts[found_slots], sizes[found])]] = -1
        if self.listed:
            for i in np.flatnonzero(out < 0):
                out[i] = self.listed.get(data[starts[i]:starts[i] + sizes[i]].tobytes(), -1)
        return out

    def shard_slots(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each slot, and its slot in there."""
        i = np.searchsorted(self.first_slot, slots, side="right") - 1
        return self.ids[i], slots - self.first_slot[i]


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the terms in lower-cased bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _IS_TERM[data], [False]])))
    return edges[0::2], edges[1::2] - edges[0::2]


# ------------------------------------------------------------------- passes
def frequencies(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term) of the terms that at least ``least`` rows of the language have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, terms in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64())], ["lang", "term", "n"])
            found.clear()

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                    found[lang].update(set(TERM.findall(text.lower())))
                    if sum(map(len, found.values())) > KEPT_TERMS:
                        yield from out()
        yield from out()

    return (rows.select("lang", "text").mapInArrow(run, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least).select("lang", "term"))


_SHARD = "lang string, shards int, shard int, n int, n_rest int, widths array<int>, bits binary, keys binary, sizes binary"


def shards(terms: DataFrame) -> DataFrame:
    """The perfect hash of every shard of ``terms(lang, shards, term)``: rows of ``_SHARD``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_pylist()
            sizes = np.fromiter(map(len, keys), np.int64, len(keys))
            h = span_hashes(np.frombuffer(b"".join(keys) + bytes(8), np.uint8), np.cumsum(sizes) - sizes, sizes)
            shard = below(h, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], ["lang", "shards", "term", "shard"])

    def make(table: pa.Table) -> pa.Table:
        made = build(sorted(as_bytes(table.column("term").combine_chunks())))
        row = {"lang": table.column("lang")[0].as_py(), "shards": table.column("shards")[0].as_py(), "shard": table.column("shard")[0].as_py()} | made
        return pa.Table.from_pylist([row], pa.schema([("lang", pa.string()), ("shards", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("n_rest", pa.int32()),
                                                      ("widths", pa.list_(pa.int32())), ("bits", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())]))

    return terms.mapInArrow(place, "lang string, shards int, term binary, shard int").groupBy("lang", "shard").applyInArrow(make, _SHARD)


def recount(rows: DataFrame, found: list[dict]) -> DataFrame:
    """(lang, source, shard, slot, count) of the terms in some shards; each task passes on what its dense counters hold."""
    sent = rows.sparkSession.sparkContext.broadcast(found)
    name = uuid.uuid4().hex

    def tables() -> dict[str, Tables]:
        by_lang = defaultdict(list)
        for s in sent.value:
            by_lang[s["lang"]].append(s)
        return {lang: Tables(some) for lang, some in by_lang.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang = kept(("divergence", name), tables)
        dense: dict[tuple[str, str], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                some = np.flatnonzero(counts)
                shard, slot = by_lang[lang].shard_slots(some)
                for at in range(0, len(some), 100_000):
                    use = slice(at, at + 100_000)
                    n = len(some[use])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(shard[use], pa.int32()), pa.array(slot[use], pa.int32()),
                                                      pa.array(counts[some[use]], pa.int64())], ["lang", "source", "shard", "slot", "count"])
            dense.clear()

        for batch in batches:
            texts, groups = as_bytes(batch.column(2)), list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            order = sorted(range(len(texts)), key=groups.__getitem__)
            at = 0
            while at < len(order):
                group, size, some = groups[order[at]], 0, []
                while at < len(order) and groups[order[at]] == group and (not some or size + len(texts[order[at]]) < SLICE_BYTES):
                    some.append(texts[order[at]])
                    size += len(some[-1]) + 1
                    at += 1
                if group[0] not in by_lang:
                    continue
                table = by_lang[group[0]]
                if group not in dense:
                    if (len(dense) + 1) * max(t.n for t in by_lang.values()) > DENSE:
                        yield from out()
                    dense[group] = np.zeros(table.n, np.int64)
                for piece in _pieces(b" ".join(some).lower()):
                    data = np.frombuffer(piece + bytes(8), np.uint8)
                    starts, sizes = spans(data)
                    slots = table.slots(data, starts, sizes, span_hashes(data, starts, sizes))
                    np.add.at(dense[group], slots[slots >= 0], 1)
        yield from out()

    return rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, shard int, slot int, count long")


def _pieces(text: bytes) -> Iterator[bytes]:
    """Long texts in parts that end between terms."""
    at = 0
    while len(text) - at > 2 * SLICE_BYTES:
        gap = re.compile(rb"[^a-z\x80-\xff]").search(text, at + SLICE_BYTES)
        if not gap:
            break
        yield text[at:gap.end()]
        at = gap.end()
    yield text[at:]


# ------------------------------------------------------------------- shares
def shares(counts: np.ndarray, n: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (n + terms)), by long division in steps of a thousand so that nothing overflows."""
    whole = n + terms
    left, out = counts + 1, np.zeros_like(counts)
    out, left = left // whole, left % whole
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return 1 + out


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_PART = "lang string, source string, part string, item string, value long"


def compared(rows: DataFrame, top: int) -> DataFrame:
    """Parts ``pair`` (summed over a shard's terms) and ``term`` (a shard's first ``top`` of each source).

    A shard's rows are its groups (source, total, terms), its counts (source,
    slot, count) and its keys. Only terms that one of two sources has are gone
    through one by one for the pair; all others have one value.
    """

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        groups, found, keys = (table.filter(pc.equal(table.column("kind"), k)) for k in range(3))
        numbers = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        names = np.array(groups.column("source").to_pylist(), dtype=object)
        totals, terms, lang_total = numbers(groups, "total"), groups.column("terms")[0].as_py(), groups.column("lang_total")[0].as_py()
        sizes = np.frombuffer(keys.column("sizes")[0].as_py(), np.int32).astype(np.int64)
        blob, starts, n = keys.column("keys")[0].as_py(), np.cumsum(sizes) - sizes, len(sizes)
        source = pc.index_in(found.column("source"), value_set=groups.column("source").combine_chunks()).to_numpy().astype(np.int64)
        slot, count = numbers(found, "slot"), numbers(found, "count")
        lang_counts = np.zeros(n, np.int64)
        np.add.at(lang_counts, slot, count)
        q = shares(lang_counts, np.int64(lang_total), terms)
        base = shares(np.zeros(len(names), np.int64), totals, terms)
        out: dict[str, list] = {k: [] for k in ("source", "part", "item", "value")}

        def dense(block: np.ndarray) -> np.ndarray:
            """Shares of some sources, a row each."""
            at = np.searchsorted(block, source)
            mine = (at < len(block)) & (block[np.minimum(at, len(block) - 1)] == source)
            grid = np.zeros((len(block), n), np.int64)
            grid[at[mine], slot[mine]] = count[mine]
            return shares(grid, totals[block][:, None], terms)

        for at in range(0, len(names), BLOCK):
            block = np.arange(at, min(at + BLOCK, len(names)))
            p = dense(block)
            has = p != base[block][:, None]
            for i, s in enumerate(block):
                gain = np.flatnonzero(np.isin(np.arange(n), slot[source == s]) & (p[i] > q))
                value = _distance(p[i][gain], q[gain])
                if len(gain) > top:
                    edge = np.partition(value, len(gain) - top)[len(gain) - top]
                    gain, value = gain[value >= edge], value[value >= edge]
                best = sorted(zip(-value, (blob[starts[g]:starts[g] + sizes[g]] for g in gain)))[:top]
                out["source"] += [names[s]] * len(best)
                out["part"] += ["term"] * len(best)
                out["item"] += [t.decode("utf-8", "replace") for _, t in best]
                out["value"] += [int(-v) for v, _ in best]
            for other_at in range(0, len(names), BLOCK):
                other = np.arange(other_at, min(other_at + BLOCK, len(names)))
                r = p if other_at == at else dense(other)
                any_ = (has if other_at == at else r != base[other][:, None]).any(axis=0)
                for i, s in enumerate(block):
                    use = np.flatnonzero(has[i] | any_)
                    none = _distance(base[s], base[other]) * (n - len(use))
                    value = none + (_distance(p[i], r) if len(use) == n else _distance(p[i][use], r[:, use])).sum(axis=1)
                    keep = other != s
                    out["source"] += [names[s]] * int(keep.sum())
                    out["part"] += ["pair"] * int(keep.sum())
                    out["item"] += list(names[other[keep]])
                    out["value"] += [int(v) for v in value[keep]]
        return pa.table({"lang": pa.array([lang] * len(out["source"]), pa.string()), "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()),
                         "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})

    return rows.groupBy("lang", "shard").applyInArrow(run, _PART)


def divergences(docs: DataFrame, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of all occurring (lang, source) groups.

    Null text, lang and source count as empty. Terms are runs of letters and
    characters beyond ASCII, with A-Z lower-cased; each language keeps those of
    at least ``least`` rows. Part ``pair`` compares the group with each other
    source of its language (every one; 0 without kept terms), part ``term``
    lists the ``top`` kept terms that the group has more often than its
    language. All arithmetic is in whole numbers. Ties are ranked by the item's
    bytes. Repeated rows count each. Empty tables give no rows; other columns
    are not read. The texts are read once for the frequencies and once for each
    ``broadcast_bytes`` of kept terms.
    """
    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    made_here = [Stage(rows.groupBy("lang", "source").agg(F.count("*").alias("rows"))), Stage(frequencies(rows, least))]
    groups, terms = made_here[0].df, made_here[1].df
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    made = Stage(shards(terms.join(sizes.select("lang", F.ceil(F.col("terms") / shard_keys).cast("int").alias("shards")), "lang").select("lang", "shards", "term")))
    made_here.append(made)
    counts = None
    for some in _batches(made.df, broadcast_bytes):
        part = Stage(recount(rows, [r.asDict() for r in some.collect()]).groupBy("lang", "source", "shard", "slot").agg(F.sum("count").alias("count")))
        made_here.append(part)
        counts = part.df if counts is None else counts.unionByName(part.df)
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    parts = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    if counts is not None:
        totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        totals = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms")
        totals = totals.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
        of_shards = made.df.select("lang", "shard").join(totals, "lang").withColumn("kind", F.lit(0))
        gathered = (of_shards.unionByName(counts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
                    .unionByName(made.df.select("lang", "shard", "keys", "sizes", F.lit(2).alias("kind")), allowMissingColumns=True))
        parts = parts.unionByName(compared(gathered, top))
    summed = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order)).unionByName(
        parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    out = stage(ranked.select("lang", "source", "part", "item", "value", "rank"))
    for each in made_here:
        each.drop()
    return out


def _batches(made: DataFrame, limit: int) -> Iterator[DataFrame]:
    """The rows of the perfect hashes in parts of about ``limit`` bytes.

    Shards are dealt by hash, so a part's size keeps close to its share; a shard
    by itself holds about ``SHARD_KEYS`` keys.
    """
    size = made.agg(F.sum(F.length("keys") + F.length("sizes") + F.length("bits"))).first()[0] or 0
    parts = -(-size // limit)
    for i in range(parts):
        yield made.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(parts)) == i)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(n) AS total FROM lc GROUP BY lang),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (gn.total + v.v) AS p
      FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT lc.lang, lc.term, 1 + CAST(1000000000 AS HUGEINT) * (lc.n + 1) // (ln.total + v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
pf AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pf ON pf.lang = a.lang AND pf.source = a.source AND pf.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
