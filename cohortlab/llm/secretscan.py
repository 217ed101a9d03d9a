"""Secret scans: keyword automaton, anchored expressions near hits, checksums.

One Aho-Corasick pass over the lower-cased bytes finds the keywords of every
kind; each hit is then tried with that kind's regular expression, anchored at
the keyword. Long hexadecimal runs have no keyword, so they are read in one
linear scan. Tokens of kinds that carry a checksum are only reported when it
is right. All expressions work on UTF-8 bytes with ASCII letters only; spans
are turned into code points for the few matches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

# The three base kinds, in order, and their expressions.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20

# Added kinds, with the prefixes their issuers document.
CRC_TOKEN = re.compile(rb"(?:gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
PEM_BEGIN = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----")
PEM_END = re.compile(rb"-----END ([A-Z ]*)PRIVATE KEY-----")
NOT_IN_PEM = re.compile(rb"[^A-Za-z0-9+/=\s:,-]")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "crc_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "pem": ("-----begin ",),
    "pem_end": ("-----end ",),
}
KINDS = (*BASE, "crc_token", "pem")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def checksum_ok(body: bytes, tail: bytes) -> bool:
    """Six base-62 digits that hold the CRC-32 of the body."""
    n = zlib.crc32(body)
    digits = bytearray()
    while n:
        n, r = divmod(n, 62)
        digits.append(BASE62[r])
    return bytes(reversed(digits)).rjust(6, b"0") == tail


def byte_spans(text: bytes, words: ahocorasick.Automaton) -> list[Span]:
    """All spans in bytes. Matches of a kind are leftmost and do not overlap:
    a hit inside an earlier match of its kind is skipped, also where that
    match was then dropped as too short or for its checksum. A key block runs
    from the last header of its name to the next end mark of that name, with
    nothing between them but what a block may hold; every header is tried once
    and bytes are looked through once, so the scan is linear in the text."""
    spans: list[Span] = [("hex", *m.span()) for m in HEX.finditer(text)]
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in words.iter(text.lower().decode("latin-1")))
    done = dict.fromkeys(KEYWORDS, 0)
    headers: dict[bytes, tuple[int, int]] = {}  # by name: where the last header begins, and the next byte no block may hold
    bad = -1
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                done[kind] = m.end()
                if len(m[2]) >= MIN_VALUE:
                    spans.append((kind, *m.span()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                done[kind] = m.end()
                if len(m[0]) >= MIN_ACCESS:
                    spans.append((kind, *m.span()))
        elif kind == "crc_token":
            if (m := CRC_TOKEN.match(text, start)) and checksum_ok(m[1], m[2]):
                done[kind] = m.end()
                spans.append((kind, *m.span()))
        elif kind == "pem":
            if m := PEM_BEGIN.match(text, start):
                if bad < m.end():
                    bad = stop.start() if (stop := NOT_IN_PEM.search(text, m.end())) else len(text)
                headers[m[1]] = start, bad
        elif (m := PEM_END.match(text, start)) and m[1] in headers:
            begin, stop_at = headers.pop(m[1])
            if stop_at >= start:
                done["pem"] = done["pem_end"] = m.end()
                headers.clear()
                spans.append(("pem", begin, m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def scan(text: bytes | None, words: ahocorasick.Automaton) -> list[Span]:
    """All spans in code points, by start, then by kind."""
    if not text:
        return []
    found = byte_spans(text, words)
    if not found or text.isascii():
        return found
    at, points, out = 0, 0, {}
    for p in sorted({x for _, s, e in found for x in (s, e)}):
        points += len(text[at:p].decode())
        at = p
        out[p] = points
    return [(k, out[s], out[e]) for k, s, e in found]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPANS = "array<struct<kind:string,start:long,stop:long>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``found`` (an array of kind, start, stop in code points,
    stop exclusive) for every row, no shuffle.

    A null text counts as empty and an empty one has no spans. Null ids and
    repeated rows come out as they came in; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            for part in slices(batch):
                found = [[{"kind": k, "start": s, "stop": e} for k, s, e in scan(t, words)] for t in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "found"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id long, found {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, from ``secrets``."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(text(base), 256).alias("base_sha256"), text("found").alias("spans"))


def redacted(text: bytes | None, words: ahocorasick.Automaton) -> bytes | None:
    """The text with each span replaced by its kind in square brackets; of
    spans that overlap, the earlier (then the earlier kind) names the whole."""
    if not text or not (found := byte_spans(text, words)):
        return text
    out, at = [], 0
    end = 0
    for kind, s, e in found:
        if s < end:
            end = max(end, e)
            at = end
            continue
        out += [text[at:s], b"[", kind.encode(), b"]"]
        at = end = e
    out.append(text[at:])
    return b"".join(out)


def clean(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets cut out of the text; ``length_col``, if there is
    such a column, follows the new text, all other columns stay.

    A null text stays null and keeps its length. No row is dropped.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = automaton()
        for t in texts:
            yield pa.array([redacted(x, words) for x in as_bytes(t)], pa.binary()).cast(pa.string())

    out = docs.withColumn(text_col, F.arrow_udf(run, "string")(docs[text_col].cast("string")))
    if length_col not in docs.columns:
        return out
    return out.withColumn(length_col, F.coalesce(F.length(text_col).cast("long"), F.col(length_col)))
