"""Operators that gather from the whole corpus: source divergence, language-model scores, spelling variants."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import divergence, lbl, variants
from cohortlab.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.helpers import clashing

# --- source divergence

GROUPED = "doc_id long, text string, lang string, source string, term binary, slot int, kind int, n long"


def brute_divergence(rows, least=3, top=200):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    rowed, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in texts:
        rowed[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in rowed:
        kept = [t for t, n in rowed[lang].items() if n >= least]
        groups = {s: c for (g, s), c in count.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:None if part == "pair" else top]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


def sample(seed, n=160):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abéZ漢") for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    return [(" ".join(rnd.choices(words, k=rnd.randint(0, 30))) + rnd.choice([".", "\n1", ""]), rnd.choice(["en", "de", None]), rnd.choice(["hot"] * 5 + ["b", "c", "", None])) for _ in range(n)]


@pytest.mark.parametrize("shard_keys, limit, dense", [(4096, 64 << 20, 12 << 20), (8, 1500, 100)])
def test_divergence_equals_brute_force(spark, monkeypatch, shard_keys, limit, dense):
    monkeypatch.setattr(divergence, "DENSE", dense)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "KEPT_TERMS", 50)
    rows = [*sample(1), (None, "xx", "alone"), ("rare words", "yy", "a"), ("others", "yy", "b"), ("long " * 50_000, "en", "hot")]
    df = spark.createDataFrame([(i, *r, b"t", 1, 2, 3) for i, r in enumerate(rows)], GROUPED).repartition(4)
    got = divergence.divergences(df, top=20, shard_keys=shard_keys, broadcast_bytes=limit)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, top=20)
    assert divergence.divergences(df.where("doc_id < 0")).collect() == []


def test_perfect_hash_is_minimal_and_verified():
    rnd = random.Random(5)
    keys = sorted({bytes(rnd.choices(b"abcdefgh\xc3\xa9", k=rnd.randint(1, 40))) for _ in range(3000)})
    made = divergence.build(keys) | {"shard": 0, "shards": 1}
    tables = divergence.Tables([made])
    strangers = [k + b"z" for k in keys[:500]]
    text = b" ".join([*keys, *strangers])
    data = np.frombuffer(text + bytes(8), np.uint8)
    sizes = np.array([len(k) for k in [*keys, *strangers]])
    starts = np.cumsum(sizes + 1) - sizes - 1
    slots = tables.slots(data, starts, sizes, divergence.span_hashes(data, starts, sizes))
    assert sorted(slots[:len(keys)]) == list(range(len(keys))) and (slots[len(keys):] == -1).all()


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that sends all keys of one size to the same value, every key is found by its bytes."""
    monkeypatch.setattr(divergence, "span_hashes", lambda data, starts, sizes: divergence.mixed(sizes.astype(np.uint64)))
    keys = [b"ab", b"cd", b"ef", b"xyz"]
    made = divergence.build(keys) | {"shard": 0, "shards": 1}
    assert made["n_rest"] == 3
    data = np.frombuffer(b"ab cd ef xyz gh uvw" + bytes(8), np.uint8)
    starts, sizes = np.array([0, 3, 6, 9, 13, 16]), np.array([2, 2, 2, 3, 2, 3])
    slots = divergence.Tables([made]).slots(data, starts, sizes, divergence.span_hashes(data, starts, sizes))
    assert sorted(slots[:4]) == [0, 1, 2, 3] and list(slots[4:]) == [-1, -1]


def test_shares_do_not_overflow():
    counts, n = np.array([0, 1, 9 * 10**14]), np.int64(10**15)
    assert list(divergence.shares(counts, n, 3)) == [1 + 10**9 * (int(c) + 1) // (10**15 + 3) for c in counts]


# --- language-model scores

def brute_base(rows):
    """(held_out, n_tokens, n_known, N, base) by row."""
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    c = Counter()
    for h, words in zip(held, tokens):
        if not h:
            c.update([*words, None])
    n, v = sum(c.values()), len(c)
    return [(h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])) for h, w in zip(held, tokens)]


LM_EDGES = [(-1, None), (-2, ""), (-3, " \n "), (None, "no id"), (-4, "same"), (-4, "same"), (-5, "long " * 30_000), (-6, "É漢 ÀB\x0b\x1cx")]


@pytest.mark.parametrize("head, size", [(lbl.HEAD, lbl.TABLE), (20, 100)])
def test_base_scores_equal_brute_force(spark, head, size):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "documents").where("doc_id < 60").select("doc_id", "text").collect()] + LM_EDGES
    got = lbl.scores(clashing(spark, rows).repartition(3), head=head, table=size).collect()
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    want = sorted(((d, *b[:4], b[4]) for (d, _), b in zip(rows, brute_base(rows))), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_model_probabilities_add_up_and_beat_the_base(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = lbl.scores(docs).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.max("score").alias("top")).first()
    assert got.score > got.base + 0.02 * abs(got.base) and got.top <= 0
    rows = docs.select("doc_id", lbl.is_held_out(F.col("doc_id")).alias("held_out"), F.lit(1).alias("turn"), "text")
    counts = lbl.word_counts(rows).cache()
    lex = lbl.lexicon(counts, rows.where("not held_out").count(), head=50, table=1000)
    model = lbl.train(lbl.encode(rows, lex).cache(), lex)
    share = np.exp((model.context(np.array([3]), np.array([lex.symbols])) @ model.q.T + model.b) - model.log_sums(3)[lex.symbols])
    assert share.sum() == pytest.approx(1, abs=1e-4) and len(share[0]) == lex.symbols
    # The words of a class and one more type share its probability.
    c = Counter({bytes(r.word): r.c for r in counts.collect() if r.c})
    for k in range(3):
        mine = [n for w, n in c.items() if w not in lex.words[:lex.head] and lbl.word_class(w) == k]
        assert sum((n + 0.5) / 10 ** lex.class_log()[k] for n in [*mine, 0]) == pytest.approx(1)


def test_scores_without_training_rows(spark):
    df = clashing(spark, [(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in lbl.scores(df, held_out=F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].base_score == 0 and got[1].n_known == 0 and got[1].n_tokens == 3 and got[2].n_tokens == 1
    assert lbl.scores(df.where("doc_id < 0")).collect() == []


# --- spelling variants

def brute_variants(rows, damage=31, shortest=7, least=2, times=10):
    c = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            c[run] += 1
    w = {x: n for x, n in c.items() if len(x) >= shortest and n >= least}
    near, wild = defaultdict(set), defaultdict(list)
    for x in w:
        for i in range(len(x)):
            wild[x[:i] + "\0" + x[i + 1:]].append(x)
            if (y := x[:i] + x[i + 1:]) in w:
                near[x].add(y)
                near[y].add(x)
    for g in wild.values():
        for a in g:
            near[a].update(b for b in g if b != a)
    form = {}
    for x, n in w.items():
        if near[x] and w[b := min(near[x], key=lambda y: (-w[y], y))] >= times * n:
            form[x] = b
    out = {}
    for x, n in w.items():
        root = x
        while root in form:
            root = form[root]
        out[x] = (x, form.get(x), root, n, len(near[x]), w[form[x]] if x in form else None)
    return out


def related(seed):
    """Words with many neighbours, chains of forms, and thousands that share a half."""
    rnd, out = random.Random(seed), []
    for base, n in (("tausendfach", 900), ("tausendfech", 60), ("tausenfech", 5), ("zürichsee", 40), ("zürichseé", 2), ("aaaaaaaa", 30), ("aaaaaaa", 3), ("aaaaaaaaa", 3)):
        out += [base] * n
    for _ in range(300):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(7, 9)))
        out += [w] * rnd.randint(1, 30)
    for _ in range(400):
        out += ["gemeinsam" + "".join(rnd.choice("xyz") for _ in range(rnd.randint(4, 9)))] * 2
    rnd.shuffle(out)
    return [(i, " ".join(out[i * 50:(i + 1) * 50]).title() if i % 2 else " ".join(out[i * 50:(i + 1) * 50])) for i in range(len(out) // 50 + 1)]


@pytest.mark.parametrize("damage, meet", [(31, variants.MEET), (0, 3)])
def test_variants_equal_brute_force(spark, damage, meet):
    rows = [*related(2), (1, None), (2, ""), (None, "ohnekennung ohnekennung"), (7, "wiederholt"), (7, "wiederholt"), (8, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 4999 + "y")]
    got = {r.word: tuple(r) for r in variants.variants(clashing(spark, rows).repartition(3), damage=damage, meet=meet).collect()}
    want = brute_variants(rows, damage)
    assert got == want
    assert any(v[2] != v[1] for v in want.values() if v[1]) if not damage else True
    assert variants.variants(clashing(spark, rows).where("doc_id < 0")).collect() == []


def test_variants_of_documents(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = {r.word: tuple(r) for r in variants.variants(docs).collect()}
    assert got == brute_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
