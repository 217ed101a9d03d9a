"""URL filters: host word segmentation and naive Bayes, after fixed rules.

Hosts are written without spaces. Their runs of letters are split into words
by a unigram model (Viterbi over word probabilities learned from the pages'
own texts); multinomial naive Bayes over the host's words and the path's
tokens then tells wanted from unwanted URLs. Its training labels are weak: a
page is a positive example if its segmented host holds a seed word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .licenses import LOWER, UPPER

# Rules as (verdict, host/path), and words of hosts that are not wanted.
RULES: tuple[tuple[str, str], ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SEEDS: tuple[str, ...] = (
    "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "lottery", "malware", "nude", "phishing",
    "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx",
)

#: Letters by which longer words of the model are looked up.
PREFIX = 20
#: Lidstone's constant of naive Bayes.
ALPHA = 0.1
#: A host or token is hot if it has more than this share of all; so there are at most ``HOT`` hot ones, which are broadcast.
HOT = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null URL or one without ``://``."""
    after = F.substring_index(url, "://", 1)
    rest = F.when(url.contains("://"), url.substr(F.length(after) + 4, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for a null URL or one without ``://``."""
    after = F.substring_index(url, "://", 1)
    rest = F.when(url.contains("://"), url.substr(F.length(after) + 4, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its
    host and all subdomains where the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest ends up outermost
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, html_col: str, seeds: tuple[str, ...]) -> DataFrame:
    """(word, n): the unigram model, from the text of all pages, tags left out.

    Seed words count at least once, or they could not be found in a host.
    """
    text = F.lower(F.regexp_replace(F.regexp_replace(pages[html_col].cast("string"), r"<[^>]*>", " "), r"[^\p{L}]+", " "))
    words = pages.select(F.explode(F.split(text, " ")).alias("word")).where(F.length("word") >= 2)
    given = pages.sparkSession.createDataFrame([(s,) for s in seeds] or [("-",)], "word string").where("word <> '-'")
    return words.unionByName(given).groupBy("word").agg(F.count("*").alias("n"))


def most_probable(run: str, found: list[tuple[int, str, int]], total: int) -> list[str]:
    """Viterbi: the most probable words of a run, of ``found(place, word, n)``.

    A letter in no word costs a tenth of a word seen once; neighbours of that
    kind come out as one token. Of equally probable splits the one is taken
    whose last word is the shortest (a stray letter before any word), and so on
    towards the front.
    """
    unknown, ending = math.log(0.1 / total), {}
    for at, word, n in found:
        if run.startswith(word, at):
            ending.setdefault(at + len(word), []).append((len(word), math.log(n / total)))
    score, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        s, size = score[end - 1] + unknown, -1
        for n, p in sorted(ending.get(end, ())):
            if score[end - n] + p > s:
                s, size = score[end - n] + p, n
        score.append(s)
        back.append(size)
    words, end, stray = [], len(run), ""
    while end:
        size = back[end]
        if size < 0:
            stray = run[end - 1] + stray
            end -= 1
            continue
        if stray:
            words.append(stray)
            stray = ""
        words.append(run[end - size:end])
        end -= size
    return ([stray] if stray else []) + words[::-1]


def split_runs(runs: DataFrame, model: DataFrame) -> DataFrame:
    """(run, words): the most probable words of each distinct run of letters.

    All parts of 2 to ``PREFIX`` letters of a run are looked up in the model by
    a join; a longer word is found by its first ``PREFIX`` letters. So neither
    the model nor the runs need fit anywhere, and runs and words may have any
    length; a run gathers the words of the model that occur in it.
    """
    model = stage(model)
    total = model.agg(F.sum("n")).first()[0] or 1
    numbered = stage(runs.withColumn("id", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for first in range(0, len(run), 10_000):
                    parts = [(at, run[at:at + n]) for at in range(first, min(first + 10_000, len(run))) for n in range(2, min(PREFIX, len(run) - at) + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.string())], ["id", "at", "part"])

    parts = numbered.select("id", "run").mapInArrow(cut, "id long, at int, part string")
    keyed = model.withColumn("part", F.col("word").substr(1, PREFIX))
    found = parts.join(keyed, "part").groupBy("id").agg(F.collect_list(F.struct("at", "word", "n")).alias("found"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [most_probable(run, [(f["at"], f["word"], f["n"]) for f in some or []], total) for run, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["run", "words"])

    return numbered.join(found, "id", "left").select("run", "found").mapInArrow(best, "run string, words array<string>")


def host_words(hosts: DataFrame, model: DataFrame) -> DataFrame:
    """(host, words): the words of each distinct host, run of letters after run."""
    each = stage(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"(\p{L}+)"), 1)).alias("place", "run")))
    words = split_runs(each.select("run").distinct(), model)
    return (each.join(words, "run").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("x"))
            .select("host", F.flatten(F.col("x.words")).alias("words")))


def features(host_words_: Column, path: Column) -> Column:
    """Tokens of a URL: its host's words and the path's runs of letters and
    digits (A-Z lower-cased, numbers as one token), each kind by itself."""
    of_path = F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit(r"([\p{L}\p{N}]+)"), 1)
    marked = F.transform(of_path, lambda t: F.concat(F.lit("path "), F.when(t.rlike(r"^\p{N}+$"), F.lit("0")).otherwise(t)))
    return F.concat(F.transform(host_words_, lambda w: F.concat(F.lit("host "), w)), marked)


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS, id_col: str = "page_id",
           url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``.

    The verdict is the longest fitting rule's, else that of naive Bayes:
    ``block`` where the score, the log odds of a seed-like URL, is above 0. A
    null URL, or one without ``://``, has an empty host and path, fits no rule
    and has no tokens, so the prior alone speaks. Null ids and repeated rows
    come out as they came in; other columns are not read. Without any
    positive example (or any page) nothing is blocked but by rules.

    Everything is counted over all rows: words of the texts, distinct hosts,
    and tokens by label, each summed in the tasks before it is dealt out. A
    host is split once, however many pages it has. Hosts and tokens with more
    than one in ``HOT`` of all pages or tokens are joined by a broadcast, there
    are at most ``HOT`` of them; all others by a shuffle, in which no key is
    hot then. Weights are decimals, so their sums do not depend on the order.
    """
    url = pages[url_col].cast("string")
    urls = stage(pages.select(F.monotonically_increasing_id().alias("row"), pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")))
    model = word_counts(pages, html_col, seeds)
    of_host = stage(urls.groupBy("host").agg(F.count("*").alias("pages")))
    table = stage(host_words(of_host.select("host").where("host <> ''"), model))
    positive = F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds])) if seeds else F.lit(False)
    joined = _joined(urls, table.withColumn("positive", positive), of_host, "host", "pages")
    tokens = features(F.coalesce("words", F.array().cast("array<string>")), F.col("path"))
    joined = stage(joined.select("row", "page_id", "host", "path", F.coalesce("positive", F.lit(False)).alias("positive"), tokens.alias("tokens")))

    sizes = {r["positive"]: r["n"] for r in joined.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    each = joined.select("row", "positive", F.explode("tokens").alias("token"))
    counts = stage(each.groupBy("token").agg(F.count("*").alias("n"), F.count(F.when(F.col("positive"), 1)).alias("n_positive")))
    prior, weights = bayes(counts, sizes.get(False, 0), sizes.get(True, 0))
    sums = _joined(each.select("row", "token"), weights, counts.select("token", "n"), "token", "n").groupBy("row").agg(F.sum("weight").alias("total"))
    scored = joined.select("row", "page_id", "host", "path").join(sums, "row", "left").withColumn(
        "score", F.round(F.lit(prior) + F.coalesce(F.col("total").cast("double"), F.lit(0.0)), 6))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def _joined(rows: DataFrame, table: DataFrame, sizes: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` left joined with ``table`` on ``key``; ``sizes`` has the rows of each key."""
    total = sizes.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col(n) * HOT > total).select(key))
    return (rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
            .unionByName(rows.join(hot, key, "left_anti").join(table.join(hot, key, "left_anti"), key, "left")))


def bayes(counts: DataFrame, negatives: int, positives: int) -> tuple[float, DataFrame]:
    """Log prior odds and (token, weight) of every token of ``counts(token, n,
    n_positive)``; without examples of both kinds the prior is the surest allow
    and weights are 0."""
    if not negatives or not positives:
        return -50.0, counts.select("token", F.lit(0).cast("decimal(20,10)").alias("weight"))
    all_ = counts.agg(F.count("*").alias("used"), F.sum("n").alias("n"), F.sum("n_positive").alias("n_positive")).first()
    more = ALPHA * all_["used"]
    yes = (F.col("n_positive") + ALPHA) / ((all_["n_positive"] or 0) + more)
    no = (F.col("n") - F.col("n_positive") + ALPHA) / ((all_["n"] or 0) - (all_["n_positive"] or 0) + more)
    return math.log(positives / negatives), counts.select("token", F.log(yes / no).cast("decimal(20,10)").alias("weight"))
