"""Packing: first-fit decreasing with a tournament tree, in random groups.

Texts are tokenised once into pieces of at most ``capacity`` ids. Every piece
gets a random group of bounded expected size; each group is packed on its own
by first-fit decreasing, so the work is spread whatever the ids or sources
are, and a group's loss is its last, partly filled sequence at most.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from .common import as_bytes, kept, slices, stage

CAPACITY = 4096
#: Pieces in a group, on average.
GROUP_PIECES = 4096
#: Words whose ids a worker keeps, and as many older ones; words that come again move to the new table.
KEPT_WORDS = 120_000
#: Longer words are not kept.
KEPT_BYTES = 48
#: Marks that are cut off the end of a word of letters.
MARKS = b".,;:!?%*#$&|()"
#: New words of letters that are tokenised in one text.
JOINED_WORDS = 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


class WordIds:
    """Ids of a text through ids of its words.

    The tokenizer drops white space before it merges and never merges a letter
    with a mark, so the ids of a text are those of its words (runs without
    ASCII white space) one after another, and those of a word of letters with
    marks after it are those of the two parts. Parts are looked up in a table;
    new words of letters are tokenised many at once, and the ids that end a
    word tell them apart; all else is tokenised alone.
    """

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        # To words of a-z the steps before merging do nothing but cut at spaces.
        self.plain = Tokenizer.from_file(file)
        self.plain.normalizer, self.plain.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def encoded(tokenizer: Tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Enter the ids of ``words``."""
        known, letters, alone, marked = self.known, set(), set(), []
        for w in words:
            core = w.rstrip(MARKS)
            if core.isalpha() or not core.isascii() and (x := core.decode()).isalpha() and x.lower().isalpha():
                if core not in known:
                    letters.add(core)
                if len(core) < len(w):
                    marked.append((w, core, tail := w[len(core):]))
                    if tail not in known:
                        alone.add(tail)
            else:
                alone.add(w)
        simple = [x for x in letters if x.isalpha() and x.islower()]
        alone = list(alone)
        for tokenizer, some in ((self.plain, simple), (self.tokenizer, list(letters.difference(simple)))):
            chunks = [some[at:at + JOINED_WORDS] for at in range(0, len(some), JOINED_WORDS)]
            for chunk, ids in zip(chunks, self.encoded(tokenizer, [b" ".join(c).decode() for c in chunks]), strict=True):
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(chunk):  # letters to Python, not to the tokenizer
                    alone += chunk
                    continue
                data, at = ids.tobytes(), 0
                for w, stop in zip(chunk, (stops * 4).tolist(), strict=True):
                    known[w] = data[at:stop]
                    at = stop
        for at in range(0, len(alone), 10_000):
            part = alone[at:at + 10_000]
            known.update(zip(part, (ids.tobytes() for ids in self.encoded(self.tokenizer, [w.decode() for w in part])), strict=True))
        for w, core, tail in marked:
            known[w] = known[core] + known[tail]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # The tokenizer lower-cases after composing; a combining mark or a special token must be seen first.
        split = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set()
        for w in set().union(*split):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.add(w)
        self.learn(new)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > KEPT_BYTES:
                del known[w]
        return out


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, salt); salt is random by task and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        ids = kept(("word ids", tokenizer_file), lambda: WordIds(tokenizer_file))
        end = np.asarray([end_id], "<u4").tobytes()
        made, seed = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, 500):
                out: list[tuple] = []
                for d, data in zip(part.column(0).to_pylist(), ids([t or b"" for t in as_bytes(part.column(1))]), strict=True):
                    data += end
                    n = len(data) // 4
                    for s in range(0, n, capacity):
                        m = min(capacity, n - s)
                        salt = int.from_bytes(hashlib.blake2b(f"{seed}:{made}".encode(), digest_size=8).digest(), "little") >> 1
                        out.append((d, s, m, zlib.crc32(memoryview(data)[4 * s:4 * (s + m)]), n, salt))
                        made += 1
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given.

    Longest first, ties by position; each goes to the first bin with room. A
    tournament tree holds the largest room below each node, so the first such
    bin is found on one way from the root to a leaf.
    """
    n = len(lengths)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - width, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts with their sequence and offset, see ``PACKED``.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut
    at its multiples, every id lies in exactly one piece, and a sequence holds
    at most ``capacity`` ids without gaps. A null or empty text is ``end_id``
    alone. Each row is a document of its own, so repeated rows give their
    pieces again, and null ids stay null. An empty table gives no rows.

    The pieces are written to the shared folder before they are grouped: the
    salt of a row is thus fixed, also when tasks run again.
    """
    cut = stage(pieces(docs, tokenizer_file, end_id, capacity, id_col, text_col))
    groups = max(1, -(-cut.count() // group_pieces))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("salt")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array(rows["grp"].to_numpy() * (1 << 24) + bins))
        return rows.append_column("offset", pa.array(offsets)).select([x.split()[0] for x in PACKED.split(", ")])

    return cut.withColumn("grp", F.col("salt") % groups).groupBy("grp").applyInArrow(one, PACKED)
