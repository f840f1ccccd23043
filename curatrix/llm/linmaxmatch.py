"""Token counts by a linear longest-match automaton.

The vocabulary is a trie: pieces that begin a word and, under a root of their own, pieces that continue one. Each node
has a failure link and the number of pieces that following it pops off, both computed once. A word's greedy
longest-match piece count is then the sum of popped counts on one walk over its characters; no piece is built and no
character is read twice.

Words are split at white space; each punctuation mark is a word. A word that the vocabulary cannot spell is one unknown
token. Words of any length are walked, unless ``longest`` is given: then a longer one is unknown too, as in libraries
that have such a limit.

Defined cases: null and empty texts have no words and no tokens; repeated rows get equal results; an empty table gives
no rows; very long texts are counted whole; columns named like the outputs are replaced, other columns do not matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curatrix.llm.common import bound_batches, resident, row_chunks

#: Characters of a word up to which its count is remembered.
CACHED_WORD = 100
CACHE_WORDS = 1_000_000
NONE = -1


def word_pieces(pieces: list[str]) -> tuple[set[str], set[str]]:
    """Word-beginning and continuing pieces of a vocabulary that marks a word's beginning with U+2581."""
    mark = "▁"
    begin = {p[1:] for p in pieces if p.startswith(mark) and len(p) > 1 and mark not in p[1:]}
    return begin, {p for p in pieces if p and mark not in p}


def read_pieces(path: str) -> list[str]:
    """Normal pieces of a sentencepiece model file (no control, unknown or byte pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not special(i)]


class Automaton:
    """Failure links and popped-piece counts over the trie of both kinds of pieces."""

    def __init__(self, begin: set[str], inside: set[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # 0: a word's root, 1: the root of continuing pieces
        whole = [False, False]
        for root, words in ((0, begin), (1, inside)):
            for w in sorted(words):
                at = root
                for c in w:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    at = to
                whole[at] = True
        self.link, self.pops = [NONE] * len(whole), [0] * len(whole)
        todo = deque((r, c, v) for r in (0, 1) for c, v in self.next[r].items())
        while todo:
            parent, c, v = todo.popleft()
            if whole[v]:
                self.link[v], self.pops[v] = 1, 1
            else:
                at, popped = self.link[parent], self.pops[parent]
                while at != NONE and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at != NONE:
                    self.link[v], self.pops[v] = self.next[at][c], popped
            todo.extend((v, d, to) for d, to in self.next[v].items())

    def count(self, word: str) -> int:
        """Greedy pieces of a word; 0 if the vocabulary cannot spell it."""
        nxt, link, pops = self.next, self.link, self.pops
        at = n = 0
        for c in word:
            while (to := nxt[at].get(c)) is None:
                n += pops[at]
                at = link[at]
                if at == NONE:
                    return 0
            at = to
        while at != 1:
            n += pops[at]
            at = link[at]
            if at == NONE:
                return 0
        return n


def _punctuation() -> str:
    own = lambda c: c < 128 and not chr(c).isalnum() and 32 < c < 127 or unicodedata.category(chr(c))[0] == "P"
    return "".join(re.escape(chr(c)) if c < 128 else f"\\U{c:08x}" for c in range(0x110000) if own(c))


#: Fixed value: Unicode white space, as a character class.
SPACE = r"\t-\r \x85\xa0  -     　"
_split: list = []


def split_words(text: str) -> list[str]:
    if not _split:
        p = _punctuation()
        low = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalnum())
        _split.extend([re.compile(f"[^{SPACE}{low}]+|[{low}]").findall, re.compile(f"[^{SPACE}{p}]+|[{p}]").findall])
    return _split[0 if text.isascii() else 1](text)


class Counter:
    """Counts whole texts, each distinct word once while it is in the cache."""

    def __init__(self, automaton: Automaton, longest: int | None = None) -> None:
        self.automaton, self.longest, self.cache = automaton, longest, {}

    def counts(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown words."""
        if not text:
            return 0, 0, 0
        cache, words = self.cache, split_words(text)
        new = set(words).difference(cache)
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = set(words)
        long = {}
        for w in new:
            (cache if len(w) <= CACHED_WORD else long)[w] = self.automaton.count(w) if self.longest is None or len(w) <= self.longest else 0
        look = cache | long if long else cache
        each = [look[w] for w in words]
        unknown = each.count(0)
        return len(words), sum(each) + unknown, unknown


def count_tokens(df: DataFrame, pieces: list[str], text: str = "text", keep: list[str] | None = None, longest: int | None = None) -> DataFrame:
    """``keep`` columns with n_words, n_tokens and n_unknown of each whole text. The vocabulary's size is fixed."""
    outputs = ["n_words", "n_tokens", "n_unknown"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    shared = df.sparkSession.sparkContext.broadcast(sorted(pieces))
    name = hash((tuple(sorted(pieces)), longest))
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(("pieces", name), lambda: Counter(Automaton(*word_pieces(shared.value)), longest))
        for b in row_chunks(batches, text):
            got = [counter.counts(t) for t in b.column(text).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *outputs])

    return bound_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, schema)
