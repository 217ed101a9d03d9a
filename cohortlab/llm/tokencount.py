"""Token counts by linear greedy longest match.

The vocabulary is a trie over bytes. Each node has a failure link and the
number of tokens that are popped on following it, both worked out once, so a
word is read byte by byte, never backwards, and its count is a sum of
precomputed numbers: no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, slices

KEPT_WORDS = 300_000
KEPT_BYTES = 64


def ranked_vocabulary(file: str) -> list[bytes]:
    """Tokens of a vocabulary file with a base-64 token and its rank a line."""
    with open(file, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links and popped-token counts.

    ``step`` maps node * 256 + byte to the child, ``fail`` a node to where
    matching goes on when no child fits, ``pops`` to the tokens given out on
    the way. Every single byte must be a token, so that any text has a match.
    """

    def __init__(self, tokens: Iterable[bytes]):
        self.step: dict[int, int] = {}
        whole = [False]
        for t in tokens:
            node = 0
            for c in t:
                at = node << 8 | c
                if at not in self.step:
                    self.step[at] = len(whole)
                    whole.append(False)
                node = self.step[at]
            whole[node] = bool(t)
        missing = [c for c in range(256) if c not in self.step or not whole[self.step[c]]]
        if missing:
            raise ValueError(f"bytes without a token of their own: {missing}")
        children: list[list[tuple[int, int]]] = [[] for _ in whole]
        for at, child in self.step.items():
            children[at >> 8].append((at & 255, child))
        self.fail, self.pops = [0] * len(whole), [0] * len(whole)
        waiting = deque([0])
        while waiting:
            node = waiting.popleft()
            for c, child in children[node]:
                waiting.append(child)
                if whole[child]:
                    self.pops[child] = 1  # the token itself, then from the root
                    continue
                back, popped = self.fail[node], self.pops[node]
                while (back << 8 | c) not in self.step:
                    popped += self.pops[back]
                    back = self.fail[back]
                self.fail[child], self.pops[child] = self.step[back << 8 | c], popped

    def count(self, text: bytes, node: int = 0) -> int:
        """Tokens of greedy longest match over ``text``, begun at a node."""
        step, fail, pops, n = self.step, self.fail, self.pops, 0
        for c in text:
            child = step.get(node << 8 | c)
            while child is None:
                n += pops[node]
                node = fail[node]
                child = step.get(node << 8 | c)
            node = child
        while node:
            n += pops[node]
            node = fail[node]
        return n


class WordCounts(dict):
    """Tokens of a space and a word, by word; long words are not kept."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.after_space = automaton.step[0x20]

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word, self.after_space)
        if len(word) <= KEPT_BYTES:
            self[word] = n
        return n


def token_counts(docs: DataFrame, tokens: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, longest_word_tokens) of every row, no shuffle.

    Words are runs of other bytes than space and 0x09 to 0x0D; each is matched
    with one space before it, from its start, and tokens never reach over
    words. Null and empty texts have no words (all counts 0). Null ids and
    repeated rows come out as they came in; other columns are not read. Counts
    of common words are kept in a table of bounded size in each task.
    """
    automaton = Automaton(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(automaton)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in as_bytes(part.column(1)):
                    each = list(map(counts.__getitem__, (text or b"").split()))
                    rows.append((len(each), sum(each), max(each, default=0)))
                    if len(counts) > KEPT_WORDS:
                        counts.clear()
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    return (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_tokens long, longest_word_tokens long"))
