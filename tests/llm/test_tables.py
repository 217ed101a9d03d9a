"""Decontamination, URL filters, captures, pipeline and the registered queries."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
import corpus_pipeline
from cohortlab.llm import decontam, queries, urlfilter, warc
from cohortlab.llm.common import stage
from pyspark.sql import functions as F
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, clashing

ITEMS = "item_id long, text string"


def words(rnd, n):
    return [f"w{rnd.randint(0, 2000)}" for _ in range(n)]


def similarity(a, b, size=5):
    k = min(size, len(a))
    grams = lambda w: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    weight = lambda gs: sum(sum(map(len, g)) for g in gs)
    x, y = grams(a), grams(b)
    return weight(x & y) / weight(x | y) if x | y else 0


def brute_leaks(docs, items):
    out = {}
    for d, dw in docs:
        for i, iw in items:
            n = min(len(iw), len(dw))
            if n < min(5, len(iw)) or not iw:
                continue
            best = max(similarity(iw, dw[s:s + n]) for s in range(len(dw) - n + 1))
            if best >= 0.8:
                out[d, i] = best
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(1)
    items = [(i, words(rnd, rnd.choice([1, 2, 4, 5, 6, 20, 40]))) for i in range(30)]
    docs = []
    for d in range(150):
        w = words(rnd, rnd.randint(0, 150))
        if rnd.random() < 0.6:
            copy = list(rnd.choice(items)[1])
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = "changed"
            at = rnd.randint(0, len(w))
            w[at:at] = copy
        docs.append((d, w))
    want = brute_leaks(docs, items)
    got = decontam.leaks(clashing(spark, [(d, ", ".join(w).upper()) for d, w in docs]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS)).collect()
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert len(found) == len(got) and set(found) <= set(want)
    # The radius may miss windows near the threshold, and no others.
    assert all(abs(found[k] - s) < 1e-9 if k in found else s < 0.9 for k, s in want.items()) and len(found) >= 0.97 * len(want)


def test_leak_edges(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "x " + text), (3, "x " + text), (None, text + " y"), (4, "z " * 50_000 + text), (5, "short"), (6, "Short!"), (7, "clean words only")]
    items = spark.createDataFrame([(10, text), (10, text), (11, None), (12, ""), (None, "clean"), (13, "short")], ITEMS)
    df = clashing(spark, rows)
    got = Counter((r["doc_id"], r["item_id"], r["start"]) for r in decontam.leaks(df, items).collect())
    assert got == {(3, 10, 1): 1, (None, 10, 0): 1, (4, 10, 50_000): 1, (5, 13, 0): 1, (6, 13, 0): 1}
    kept = decontam.without_leaks(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 7]
    none = items.where("item_id < 0")
    assert decontam.leaks(df, none).collect() == [] and decontam.leaks(df.where("doc_id < 0"), items).collect() == []
    assert decontam.without_leaks(df, none).count() == len(rows)


def test_leaks_of_an_item_with_two_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(25)) for c in "ab")
    items = spark.createDataFrame([(1, one), (1, two), (2, one)], ITEMS)
    docs = clashing(spark, [(1, "x " + two), (2, one + " y " + two), (3, one), (3, "z " + one), (4, "a0 " * 40)])
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["hamming"], r["start"], r["n_windows"]) for r in decontam.leaks(docs, items).collect()}
    # Where both texts of a document hold the item, each place counts once.
    assert got == {(1, 1): (1, 0, 1, 1), (2, 1): (1, 0, 0, 2), (2, 2): (1, 0, 0, 1), (3, 1): (1, 0, 0, 2), (3, 2): (1, 0, 0, 2)}


def test_leaks_name_items_by_the_index(spark):
    """Without a radius only windows with the item's own fingerprint are found, whatever shingles they share."""
    rnd = random.Random(5)
    text = words(rnd, 120)
    docs = [(0, text), (1, text[:30] + ["changed"] + text[31:])]
    items = spark.createDataFrame([(1, " ".join(text))], ITEMS)
    frame = clashing(spark, [(d, " ".join(w)) for d, w in docs])
    assert [r["doc_id"] for r in decontam.leaks(frame, items, radius=0).collect()] == [0]
    assert sorted(r["doc_id"] for r in decontam.leaks(frame, items).collect()) == [0, 1]


def test_leaks_look_at_every_window(spark):
    """A copy with its halves exchanged has no shingle in the item's place; of a long item twice, each place counts once."""
    rnd = random.Random(11)
    item, noise = words(rnd, 60), words(rnd, 300)
    docs = [(1, noise[:37] + item[30:] + item[:30] + noise[37:]), (2, item[30:] + item[:30]), (3, noise[:9] + item + noise[9:200] + item[30:] + item[:30]), (4, noise)]
    items = [(7, item), (8, words(rnd, 60))]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(clashing(spark, [(d, " ".join(w)) for d, w in docs]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS)).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want) == {(1, 7), (2, 7), (3, 7)}
    assert all(abs(got[k]["similarity"] - s) < 1e-9 for k, s in want.items())
    assert [(got[d, 7]["start"], got[d, 7]["n_windows"]) for d in (1, 2, 3)] == [(37, 1), (0, 1), (9, 2)]


def test_leaks_without_broadcast(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    small = sorted(tuple(r) for r in decontam.leaks(docs, items).collect())
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert small and small == sorted(tuple(r) for r in decontam.leaks(docs, items).collect())


# --- URLs

def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def plain_rule(host, path):
    fits = []
    for v, rule in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, v))
    return max(fits)[1:] if fits else (None, None)


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://net/x?y", "http://anet/", "x://y://z/a", "http://EXAMPLE.NET/en/1", "http://sub.example.net/en", "http://example.net/en/?q",
            "http://example.com/de/1", "http://a.b.org/fr/", "http://É.org/fr/x#y", "http://h?x/://q", "http://h#/p", "http://spam-farm.example.com/de", "//x", "a\n://B\nC/d\ne?f"]
    rows = [(i, u, "<p>some words of a page spam farm</p>", "x") for i, u in enumerate(urls)] + [(None, "http://a.net/", None, "x"), (3, "http://", None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = urlfilter.judged(df).collect()
    assert len(got) == len(rows)
    urls = {i: u for i, u, *_ in rows}
    for r in got:
        host, path = plain_url(urls[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urlfilter.judged(df.where("page_id < 0")).collect() == []


def test_segmentation_is_the_most_probable(spark):
    counts = {"free": 50, "bets": 20, "be": 90, "bet": 30, "casino": 9, "win": 40, "in": 200, "cas": 3, "news": 60}
    model = spark.createDataFrame(list(counts.items()), "word string, n long")
    hosts = spark.createDataFrame([("freebets.com",), ("casinowin.zzz-news",), ("xq.org",), ("1.2.3",), ("free" * 200,)], "host string")
    got = {r["host"]: r["words"] for r in urlfilter.host_words(hosts, model).collect()}
    assert got["freebets.com"] == ["free", "bets", "com"] and got["casinowin.zzz-news"] == ["casino", "win", "zzz", "news"] and got["xq.org"] == ["xq", "org"]
    assert "1.2.3" not in got and got["free" * 200] == ["free"] * 200


def splits(run):
    """Every way to cut a run."""
    if not run:
        yield []
    for n in range(1, len(run) + 1):
        for rest in splits(run[n:]):
            yield [run[:n], *rest]


def test_viterbi_equals_enumeration():
    rnd, counts = random.Random(3), {}
    for _ in range(25):
        counts["".join(rnd.choice("ab") for _ in range(rnd.randint(2, 4)))] = rnd.randint(1, 40)
    total = sum(counts.values())
    value = lambda words: sum(math.log(counts[w] / total) if w in counts else len(w) * math.log(0.1 / total) for w in words)
    for _ in range(60):
        run = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        found = [(at, w, n) for w, n in counts.items() for at in range(len(run)) if run.startswith(w, at)]
        got = urlfilter.most_probable(run, found, total)
        assert "".join(got) == run and value(got) == pytest.approx(max(map(value, splits(run))))


def test_segmentation_ties_and_long_words(spark):
    assert urlfilter.most_probable("abab", [(0, "ab", 5), (2, "ab", 5), (0, "abab", 5)], 25) == ["abab"]
    assert urlfilter.most_probable("aaa", [(0, "aa", 5), (1, "aa", 5)], 10) == ["aa", "a"]  # of equal splits, the one with the shortest last piece
    long = "abcdefghijklmnopqrstuvwxyz"
    model = spark.createDataFrame([(long, 9), (long[:22], 9), ("zz", 3)], "word string, n long")
    hosts = spark.createDataFrame([(long + "zz",), (long[:22] + "zz",), (long[:21] + "zz",)], "host string")
    got = {r["host"]: r["words"] for r in urlfilter.host_words(hosts, model).collect()}
    assert got[long + "zz"] == [long, "zz"] and got[long[:22] + "zz"] == [long[:22], "zz"] and got[long[:21] + "zz"] == [long[:21], "zz"]


def test_naive_bayes_equals_plain(spark):
    """Scores recomputed from the hosts' words, over pages where one host holds half of all rows."""
    rnd = random.Random(8)
    rows = [(i, f"http://{'hot.example' if i % 2 else rnd.choice(['spamfarm.net', 'newsdesk.org', 'win.info', 'spam.io'])}/{rnd.choice(['a', 'b', '7', 'c-1'])}/{rnd.choice('xyz')}", "<p>spam farm news desk win</p>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in urlfilter.judged(df, rules=()).collect()}
    words = {"hot.example": ["hot", "example"], "spamfarm.net": ["spam", "farm", "net"], "newsdesk.org": ["news", "desk", "org"], "win.info": ["win", "info"], "spam.io": ["spam", "io"]}
    tokens, label = {}, {}
    for i, url, _ in rows:
        host, path = plain_url(url)
        tokens[i] = ["host " + w for w in words[host]] + ["path " + ("0" if t.isdigit() else t) for t in re.findall("[a-z0-9]+", path)]
        label[i] = "spam" in words[host]
    counts = {y: Counter(t for i in tokens if label[i] == y for t in tokens[i]) for y in (True, False)}
    used = len(set(counts[True]) | set(counts[False]))
    log = lambda t, y: math.log((counts[y][t] + 0.1) / (sum(counts[y].values()) + 0.1 * used))
    for i in tokens:
        want = math.log(sum(label.values()) / (len(rows) - sum(label.values()))) + sum(log(t, True) - log(t, False) for t in tokens[i])
        assert got[i]["score"] == pytest.approx(want, abs=2e-6) and got[i]["verdict"] == ("block" if want > 0 else "allow")


def test_unwanted_hosts_are_blocked(spark):
    got = queries.op4_url_filters(spark, "/root/testdata/sf0.01").where("rule is null").collect()
    assert {r["verdict"] for r in got if "casino-win" in r["host"] or "spam-farm" in r["host"]} == {"block"}
    assert sum(r["verdict"] == "block" for r in got) < 0.2 * len(got)


# --- captures

CAPTURES = "capture_id long, url string, ts long, status int, etag string, last_modified string, headers array<struct<name:string,value:string>>, payload string, r int"


def brute_resolve(rows, key):
    out = Counter()
    for c, url, ts, status, etag, modified, _, _, _ in rows:
        if status != 304:
            continue
        if key[url] is None or ts is None:
            out[c, None, "unplaced"] += 1
            continue
        earlier = [r for r in rows if r[3] == 200 and r[7] is not None and r[2] is not None and key[r[1]] == key[url] and r[2] < ts]
        if not earlier:
            out[c, None, "orphan"] += 1
            continue
        r = max(earlier, key=lambda r: (r[2], r[0]))
        strip = lambda t: t.removeprefix("W/")
        agree = strip(etag) == strip(r[4]) if etag and r[4] else modified == r[5] if modified and r[5] else None
        out[c, r[0], "unvalidated" if agree is None else "resolved" if agree else "mismatch"] += 1
    return out


def test_captures_equal_brute_force(spark):
    rnd = random.Random(6)
    urls = ["http://a.org/x", "https://www.A.org:443/x/?utm_source=q", "http://b.org", "http://b.org/?b=2&a=1&ref=z", "b.org", None]
    rows = []
    for c in range(900):
        url = urls[0] if rnd.random() < 0.5 else rnd.choice(urls)
        full = rnd.random() < 0.5
        rows.append((c, url, rnd.choice([None, *range(0, 20_000, 613)]), 200 if full else 304, rnd.choice([None, '"1"', 'W/"1"', '"2"']), rnd.choice([None, "d1", "d2"]),
                     [("Date", str(c)), ("X-A", "1")], rnd.choice(["body", "", None]) if full else None, 5))
    rows.append((9000, urls[0], 700, 404, None, None, None, "gone", 5))
    df = spark.createDataFrame(rows, CAPTURES)
    key = {r["url"]: r["k"] for r in df.select("url", warc.canonical(F.col("url")).alias("k")).distinct().collect()}
    assert key[urls[0]] == key[urls[1]] == "a.org/x" and key[urls[3]] == "b.org?a=1&b=2" and key["b.org"] is None
    for slot in (60, 3600, 10**9):
        got = Counter((r["capture_id"], r["response_id"], r["outcome"]) for r in warc.resolve(df, slot).collect())
        assert got == brute_resolve(rows, key)
    assert warc.resolve(df.where("ts < 0")).collect() == []


def test_merged_headers(spark):
    rows = [(1, "http://a/x", 10, 200, '"e"', None, [("Content-Type", "t"), ("Cache-Control", "old"), ("ETAG", '"e"'), ("Set-Cookie", "b"), ("set-cookie", "a")], "body", 0),
            (2, "http://a/x", 20, 304, 'W/"e"', None, [("cache-control", "new"), ("Content-Length", "0"), ("ETag", 'W/"e"')], None, 0),
            (2, "http://a/x", 20, 304, 'W/"e"', None, None, None, 0), (3, "http://a/x", 10, 304, '"e"', None, None, None, 0)]
    got = warc.resolve(spark.createDataFrame(rows, CAPTURES)).orderBy("capture_id", F.size("headers")).collect()
    assert [tuple(h) for h in got[1]["headers"]] + [got[1]["payload_length"]] == [("cache-control", "new"), ("content-type", "t"), ("etag", 'W/"e"'), ("set-cookie", "a"), ("set-cookie", "b"), 4] or \
        [tuple(h) for h in got[0]["headers"]] == [("cache-control", "new"), ("content-type", "t"), ("etag", 'W/"e"'), ("set-cookie", "a"), ("set-cookie", "b")]
    assert {r["outcome"] for r in got if r["capture_id"] == 2} == {"resolved"} and got[2]["outcome"] == "orphan"


# --- pipeline and registry

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before, sizes = docs, []
    for name, work in corpus_pipeline.STAGES[:-1]:
        after = stage(work(spark, before, SF_SMALL))
        assert after.columns == docs.columns and after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name
        sizes.append(after.count())
        before = after
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > 0.8 * docs.count()
    packed = corpus_pipeline.run(spark, SF_SMALL).collect()
    whole = defaultdict(int)
    for r in packed:
        whole[r["doc_id"]] += r["length"]
    assert set(whole) == {r["doc_id"] for r in before.collect()} and all(whole[r["doc_id"]] == r["doc_tokens"] for r in packed)


def test_pipeline_on_odd_rows(spark):
    rnd = random.Random(8)
    good = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(200))
    rows = [(1, good, None, None, None), (1, good, None, None, None), (None, good + " tail", None, "s", 3), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "x " * 10_000, "en", "s", 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, want in ((docs, {1, None}), (docs.where("doc_id < 0"), set())):
        for _, work in corpus_pipeline.STAGES:
            frame = stage(work(spark, frame, SF_SMALL))
        assert {r["doc_id"] for r in frame.collect()} == want


@pytest.mark.parametrize("number", range(1, 11))
def test_one_query_for_each_operator(spark, number):
    names = [n for n in E.queries() if n.startswith(f"op{number}_")]
    assert len(names) == 1
    table = "pages" if number in (4, 10) else "documents"
    df = E.queries()[names[0]](spark, SF_SMALL)
    rows = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()
    assert df.count() >= rows if number == 1 else df.count() == rows if number not in (3, 8) else df.count() > 0
    if number in (3, 8):  # asked for without Python
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
