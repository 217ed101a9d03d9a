"""Scores of texts by a log-bilinear language model trained with noise-contrastive estimation.

The model's symbols are the most frequent training words, one class for each
of ``CLASSES`` endings of all other words, and the end of a text. The next
symbol has the score ``(c1 * r[w1] + c2 * r[w2]) . q[w] + b[w]`` after the
symbols w1 and w2 (nearest first); its probability is normalised over all
symbols. A word of a class has a share of its class by its training count,
where one more type stands for every word not seen. So the probabilities of
the words after any two words add up to one.

Counts cover all rows and are exact. Every training token takes part in
training, once: replicas train in each partition on their own rows and are
averaged after each of four rounds, so that no task and no driver sees more
than its part. Words beyond a table of bounded size find their counts by a join.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, as_bytes, kept, slices, stage

#: Words with a symbol of their own, and classes of the others by their last two bytes.
HEAD, CLASSES = 960, 64
#: Words whose counts every worker holds; all others are joined.
TABLE = 1 << 18
#: Distinct words a task counts before it passes them on.
KEPT_WORDS = 300_000
DIM, NOISE, BATCH, RATE = 32, 32, 1024, 0.1
#: Sixteenths of the training rows after which replicas are averaged.
ROUNDS = (range(0, 1), range(1, 3), range(3, 7), range(7, 16))
#: Replicas one task averages.
FAN_IN = 64
LN10 = math.log(10.0)


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of other bytes than space and 0x09 to 0x0D, with A-Z lower-cased."""
    return (text or b"").lower().split()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n): occurrences in the rows that are not ``held_out`` and in all, of ``rows(held_out, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, other = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(seen) + [w for w in other if w not in seen]
            c = np.fromiter((seen.get(w, 0) for w in words), np.int64, len(words))
            n = c + np.fromiter((other.get(w, 0) for w in words), np.int64, len(words))
            seen.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], ["word", "c", "n"])

        for batch in batches:
            for part in slices(batch):
                for held, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                    (other if held else seen).update(words_of(text))
                    if len(seen) + len(other) > KEPT_WORDS:
                        yield out()
        yield out()

    return rows.select("held_out", "text").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Training counts in the form that tasks need; its size is bounded by its parameters."""

    words: list[bytes]        # the table, by falling training count; the first ``head`` have symbols
    counts: np.ndarray        # their training counts
    head: int
    class_total: np.ndarray   # training occurrences and distinct training words of the classes
    class_types: np.ndarray
    ends: int                 # training rows
    tokens: int               # N
    types: int                # V
    least: int                # words with fewer occurrences in all rows are not in the table
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def end(self) -> int:
        return self.head + CLASSES

    @property
    def symbols(self) -> int:
        return self.head + CLASSES + 1

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[:self.head], self.class_total, [self.ends]]).astype(float)

    def base_log(self) -> float:
        """log10 of the base formula's denominator."""
        return math.log10(self.tokens + 0.5 * (self.types + 1))

    def class_log(self) -> np.ndarray:
        return np.log10(self.class_total + 0.5 * (self.class_types + 1))


def lexicon(counts: DataFrame, ends: int, head: int = HEAD, table: int = TABLE) -> Lexicon:
    """The table holds the words of the most occurrences, whole steps of a quarter of a power of two of them, ``table`` words at most."""
    step = F.floor(F.log2("n") * 4)
    kind = F.crc32(F.expr("substring(word, -2, 2)")) % CLASSES
    rows = counts.groupBy(kind.alias("kind"), step.alias("step")).agg(F.count("*").alias("words"), F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("types"), F.min("n").alias("least")).collect()
    by_step = Counter()
    for r in rows:
        by_step[r["step"]] += r["words"]
    least, taken = 1 << 62, 0
    for s in sorted(by_step, reverse=True):
        taken += by_step[s]
        if taken > table:
            break
        least = min(r["least"] for r in rows if r["step"] == s)
    found = sorted(((-r["c"], bytes(r["word"])) for r in counts.where(F.col("n") >= least).select("word", "c").collect()))
    words, c = [w for _, w in found], -np.array([x for x, _ in found], dtype=np.int64)
    head = int(min(head, (c > 0).sum()))
    total, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in rows:
        total[r["kind"]] += r["c"]
        types[r["kind"]] += r["types"]
    tokens, distinct = int(total.sum()) + ends, int(types.sum()) + (ends > 0)
    for w, x in zip(words[:head], c):
        total[word_class(w)] -= x
        types[word_class(w)] -= 1
    return Lexicon(words, c, head, total, types, ends, tokens, distinct, least)


class Index(dict):
    """Place of a word in the table; of another word, ``size`` and its class, and the word is noted."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.size, self.noted = len(words), []

    def __missing__(self, word: bytes) -> int:
        self.noted.append(word)
        return self.size + word_class(word)


def encode(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Each of ``rows(doc_id, held_out, turn, text)`` with a key of its own, its
    symbols (16-bit, the end last), what the table says of its words, and the words beyond it."""
    shared = rows.sparkSession.sparkContext.broadcast(lex)
    columns = ["key", "doc_id", "held_out", "turn", "n_tokens", "n_known", "log_counts", "log_classes", "symbols", "beyond"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        index = kept(("lbl", lex.name), lambda: Index(lex.words))
        kinds = np.fromiter(map(word_class, lex.words), np.int64, len(lex.words))
        kinds[:lex.head] = -1
        symbol = np.concatenate([np.where(kinds < 0, np.arange(len(kinds)), lex.head + kinds), lex.head + np.arange(CLASSES)]).astype(np.uint16)
        log_count = np.concatenate([np.log10(lex.counts + 0.5), np.zeros(CLASSES)])
        is_known = np.concatenate([lex.counts > 0, np.zeros(CLASSES, bool)])
        in_class = np.concatenate([kinds >= 0, np.ones(CLASSES, bool)])
        classes = lex.class_log()
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 500):
                out = []
                for doc_id, held, turn, text in zip(*(part.column(i).to_pylist() for i in range(3)), as_bytes(part.column(3))):
                    index.noted = []
                    words = words_of(text)
                    places = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    own = symbol[places]
                    rest = places[in_class[places]]
                    logs = log_count[places]
                    out.append((at, doc_id, held, turn, len(words) + 1, int(is_known[places].sum()) + (lex.ends > 0),
                                (float(logs.sum()), float(log_count[rest].sum())), float(classes[symbol[rest] - lex.head].sum()),
                                np.append(own, np.uint16(lex.end)).tobytes(), index.noted))
                    at += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), part.column(0), part.column(1), part.column(2), pa.array([o[4] for o in out], pa.int64()), pa.array([o[5] for o in out], pa.int64()),
                    pa.array([o[6][0] for o in out], pa.float64()), pa.array([o[6][1] - o[7] for o in out], pa.float64()),
                    pa.array([o[8] for o in out], pa.binary()), pa.array([o[9] for o in out], pa.list_(pa.binary()))], columns)

    return rows.select("doc_id", "held_out", "turn", "text").mapInArrow(run, (
        "key long, doc_id long, held_out boolean, turn int, n_tokens long, n_known long, log_counts double, log_classes double, symbols binary, beyond array<binary>"))


# -------------------------------------------------------------------- model
@dataclass
class Model:
    """Parameters of the log-bilinear model; ``r`` has one more row, the start of a text."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray

    @staticmethod
    def begin(lex: Lexicon, dim: int = DIM, seed: int = 7) -> Model:
        """Small random vectors; the biases are log shares, so training starts from the unigram model."""
        rng = np.random.default_rng(seed)
        share = lex.symbol_counts() + 0.5
        return Model(rng.normal(0, 0.1, (lex.symbols + 1, dim)).astype(np.float32), rng.normal(0, 0.1, (lex.symbols, dim)).astype(np.float32),
                     np.log(share / share.sum()).astype(np.float32), np.ones((2, dim), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.c]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unpack(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at:at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*out)

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.c[0] * self.r[one] + self.c[1] * self.r[two]

    def log_sums(self, one: int) -> np.ndarray:
        """log of the sum of exp scores over all symbols, after ``one`` and each symbol before it."""
        h = self.c[0] * self.r[one] + self.c[1] * self.r
        s = h @ self.q.T + self.b
        top = s.max(axis=1)
        return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


def contexts(symbols: np.ndarray, begins: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each of some joined texts; before a text there is ``start``."""
    one = np.concatenate([[start], symbols[:-1]]).astype(np.int64)
    one[begins] = start
    two = np.concatenate([[start], one[:-1]]).astype(np.int64)
    two[begins] = start
    return one, two


def _added(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries of ``index`` and the sums of their values."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive steps with AdaGrad rates on one replica of the model."""

    def __init__(self, model: Model, sums: Model, noise: np.ndarray, rng: np.random.Generator):
        self.m, self.sums, self.rng = model, sums, rng
        self.edges = np.cumsum(noise)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)

    def move(self, name: str, rows, grad: np.ndarray) -> None:
        total, value = getattr(self.sums, name), getattr(self.m, name)
        total[rows] += grad * grad
        value[rows] -= RATE * grad / np.sqrt(total[rows] + 1e-6)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        m, n = self.m, len(target)
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE) * self.edges[-1], side="right"), len(self.edges) - 1)
        r1, r2, q, qn = m.r[one], m.r[two], m.q[target], m.q[drawn]
        h = m.c[0] * r1 + m.c[1] * r2
        # Is it the text's symbol or one of the noise symbols drawn for the batch? Errors of that guess:
        good = 1 / (1 + np.exp(self.log_noise[target] - (h * q).sum(axis=1) - m.b[target])) - 1
        bad = 1 / (1 + np.exp(self.log_noise[drawn] - h @ qn.T - m.b[drawn]))
        good, bad = (good / n).astype(np.float32), (bad / n).astype(np.float32)
        dh = good[:, None] * q + bad @ qn
        rows = np.concatenate([target, drawn])
        at, grad = _added(rows, np.concatenate([np.column_stack([good[:, None] * h, good]), np.column_stack([bad.T @ h, bad.sum(axis=0)])]))
        self.move("q", at, grad[:, :-1])
        self.move("b", at, grad[:, -1])
        at, grad = _added(np.concatenate([one, two]), np.concatenate([dh * m.c[0], dh * m.c[1]]))
        dc = np.stack([(dh * r1).sum(axis=0), (dh * r2).sum(axis=0)])
        self.move("r", at, grad)
        self.move("c", slice(None), dc)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of some texts on end, and where each begins."""
    sizes = np.fromiter((len(t) // 2 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint16).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def train(encoded: DataFrame, lex: Lexicon, seed: int = 7) -> Model:
    """The model after one pass over all rows of ``encoded`` that are not held out."""
    model = Model.begin(lex, seed=seed)
    sums = model.unpack(np.zeros_like(model.pack()))
    noise = lex.symbol_counts() + 0.5
    noise /= noise.sum()
    for turn, some in enumerate(ROUNDS):
        rows = encoded.where(~F.col("held_out") & F.col("turn").isin(list(some))).select("symbols")
        sent = rows.sparkSession.sparkContext.broadcast((model, sums, noise))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, totals, noise = sent.value
            part = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, turn, part])
            trainer, n = Trainer(own.unpack(own.pack()), own.unpack(totals.pack()), noise, rng), 0
            for batch in batches:
                for some in slices(batch, 500):
                    symbols, begins = _joined(some.column(0).to_pylist())
                    if not len(symbols):
                        continue
                    one, two = contexts(symbols, begins, lex_symbols)
                    order = rng.permutation(len(symbols))
                    for at in range(0, len(order), BATCH):
                        use = order[at:at + BATCH]
                        trainer.step(one[use], two[use], symbols[use])
                    n += len(symbols)
            if n:
                yield _replica(part, n, np.concatenate([trainer.m.pack(), trainer.sums.pack()]))

        lex_symbols = lex.symbols
        flat = _averaged(rows.mapInArrow(run, _REPLICA), rows.rdd.getNumPartitions())
        if flat is not None:
            half = len(flat) // 2
            model, sums = model.unpack(flat[:half]), model.unpack(flat[half:])
        sent.destroy()
    return model


_REPLICA = "part long, n double, flat binary"


def _replica(part: int, n: float, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(n)]), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], ["part", "n", "flat"])


def _mean(ns: list[float], flats: list[bytes]) -> np.ndarray:
    total = sum(ns)
    out = np.zeros(len(flats[0]) // 4)
    for n, flat in zip(ns, flats):
        out += np.frombuffer(flat, np.float32) * (n / total)
    return out


def _averaged(replicas: DataFrame, parts: int) -> np.ndarray | None:
    """The mean of the replicas, weighted by tokens: tasks average ``FAN_IN`` of
    them at a time until eight are left, so the driver takes a fixed amount."""

    def mean(table: pa.Table) -> pa.Table:
        ns = table.column("n").to_pylist()
        return pa.Table.from_batches([_replica(min(table.column("part").to_pylist()), sum(ns), _mean(ns, table.column("flat").to_pylist()))])

    while parts > 8:
        parts = -(-parts // FAN_IN)
        replicas = replicas.groupBy((F.col("part") % parts).alias("_g")).applyInArrow(mean, _REPLICA)
    rows = sorted(replicas.collect())
    return _mean([r["n"] for r in rows], [bytes(r["flat"]) for r in rows]) if rows else None


def log_sums(encoded: DataFrame, model: Model) -> np.ndarray:
    """``Model.log_sums`` of every symbol, a matrix product each, dealt to tasks; (symbols + 1)^2 numbers."""
    spark, n = encoded.sparkSession, len(model.r)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sent.value.log_sums(i).astype(np.float32).tobytes() for i in ids], pa.binary())], ["id", "sums"])

    rows = spark.range(0, n, 1, max(1, n // 64)).mapInArrow(run, "id long, sums binary").collect()
    return np.stack([np.frombuffer(r["sums"], np.float32) for r in sorted(rows)])


def symbol_scores(encoded: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """(key, model_log): the sum of log10 probabilities of each row's symbols."""
    sent = encoded.sparkSession.sparkContext.broadcast((model, log_sums(encoded, model)))
    start = lex.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = sent.value
        for batch in batches:
            for part in slices(batch, 200):
                symbols, begins = _joined(part.column(1).to_pylist())
                one, two = contexts(symbols, begins, start)
                logs = np.empty(len(symbols))
                for at in range(0, len(symbols), 1 << 16):
                    use = slice(at, at + (1 << 16))
                    s = np.einsum("ij,ij->i", model.context(one[use], two[use]), model.q[symbols[use]]) + model.b[symbols[use]]
                    logs[use] = s - sums[one[use], two[use]]
                total = np.add.reduceat(logs, begins) if len(begins) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total / LN10)], ["key", "model_log"])

    return encoded.select("key", "symbols").mapInArrow(run, "key long, model_log double")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 5 is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
           head: int = HEAD, table: int = TABLE, seed: int = 7) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    ``held_out`` says which rows nothing is learned from (``is_held_out`` of
    the id). Tokens are the words and one end. ``base_score`` is the smoothed
    unigram log10 probability, ``score`` that of the log-bilinear model. Null
    and empty texts have the end as only token. Repeated rows and ids are
    rows of their own; null ids stay null. Ties between words of one count are
    cut in byte order. Without training rows all words have the same share of
    their class. The model depends on how rows lie in partitions, but a task
    that runs again gives the same. Other columns are not read.
    """
    doc_id = docs[id_col].cast("long")
    hashed = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    rows = docs.select(doc_id.alias("doc_id"), (is_held_out(doc_id) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"),
                       F.floor(hashed / 5).cast("long").alias("turn"), docs[text_col].cast("string").alias("text")).withColumn("turn", (F.col("turn") % 16).cast("int"))
    counts = Stage(word_counts(rows))
    lex = lexicon(counts.df, rows.where("not held_out").count(), head, table)
    encoded = Stage(encode(rows, lex))
    model = train(encoded.df, lex, seed)
    beyond = (encoded.df.select("key", F.explode("beyond").alias("word")).join(counts.df.where(F.col("n") < lex.least), "word")
              .groupBy("key").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("more_log"), F.count(F.when(F.col("c") > 0, 1)).alias("more_known")))
    base_end = math.log10(lex.ends + 0.5)
    more = F.coalesce("more_log", F.lit(0.0))
    found = stage(encoded.df.drop("symbols", "beyond", "turn").join(symbol_scores(encoded.df, lex, model), "key").join(beyond, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + more + base_end - F.col("n_tokens") * lex.base_log()).alias("base_score"),
        (F.col("model_log") + F.col("log_classes") + more).alias("score")))
    encoded.drop()
    counts.drop()
    return found
