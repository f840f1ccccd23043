"""Harmonic packing of token sequences.

A document's whole sequences are cut off first. What is left, its length n under the capacity C, falls into the
reciprocal-capacity class k = C div n: it is longer than C / (k + 1) and at most C / k. Each bin of class k takes k
documents, a fixed count, whole. A bin that has its count, but not C tokens yet, waits: a later document that fits what
it has left goes in whole (the tightest such bin takes it), and where WAITING bins wait, a document that fits none is
cut to fill the one with most room. When the input ends, what is in unfinished bins fills the waiting ones; the rest is
laid end to end in full sequences, and the last remainder in sequences of power-of-two lengths. So no sequence is
padded.

Every task is a worker that fills bins of its own; nothing is shuffled. A sequence's id is the task's number and a count.

Defined cases: a null or empty text is its end token alone; an empty table gives no rows; repeated rows and rows with a
null or the same id are packed each on its own, in the order in which they are read; a very long text gives whole
sequences and one rest; only the key and the text are read, whatever the names of other columns.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curatrix.llm.common import bound_batches, resident, row_chunks, trimmed
from curatrix.llm.trie_bpe import CACHE_WORDS, WordBpe

#: Bins of a task that wait for what fits their rest; with more, documents are cut.
WAITING = 256


class Piece(NamedTuple):
    """Some of a document's ids (little-endian unsigned 32-bit)."""

    key: Any
    doc_tokens: int
    start: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and the rest."""
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])


class Packer:
    """One worker's bins. ``take`` gives the pieces that were placed since: (piece, sequence, offset)."""

    def __init__(self, capacity: int, first: int = 0, waiting: int = WAITING) -> None:
        if capacity < 1:
            raise ValueError("the capacity must be at least 1")
        self.capacity, self.next, self.most = capacity, first, waiting
        self.open: dict[int, list[Piece]] = {}  # of each class, the bin that is being filled
        self.waiting: list[tuple[int, int]] = []  # room and number of bins with their count of documents
        self.bins: dict[int, list[Piece]] = {}
        self.closed = 0
        self.placed: list[tuple[Piece, int, int]] = []

    def take(self) -> list[tuple[Piece, int, int]]:
        out, self.placed = self.placed, []
        return out

    def add(self, key: Any, ids: bytes) -> None:
        """One document."""
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            self._place([Piece(key, n, at, ids[4 * at : 4 * (at + self.capacity)])])
            at += self.capacity
        if at < n:
            self._rest(Piece(key, n, at, ids[4 * at :]))

    def _place(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.placed.append((p, self.next, at))
            at += p.length
        self.next += 1

    def _wait(self, number: int, room: int) -> None:
        if room:
            insort(self.waiting, (room, number))
        else:
            self._place(self.bins.pop(number))

    def _fill(self, at: int, piece: Piece) -> None:
        room, number = self.waiting.pop(at)
        self.bins[number].append(piece)
        self._wait(number, room - piece.length)

    def _rest(self, piece: Piece) -> None:
        """A piece of less than the capacity."""
        at = bisect_left(self.waiting, (piece.length, -1))
        if at < len(self.waiting):
            self._fill(at, piece)
            return
        if len(self.waiting) >= self.most:
            some, piece = piece.cut(self.waiting[-1][0])
            self._fill(len(self.waiting) - 1, some)
        kind = self.capacity // piece.length
        held = self.open.setdefault(kind, [])
        held.append(piece)
        if len(held) == kind:
            self.closed += 1
            self.bins[self.closed] = self.open.pop(kind)
            self._wait(self.closed, self.capacity - sum(p.length for p in held))

    def finish(self) -> None:
        """Places what is left."""
        left = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open = {}
        rest = []
        for p in left:
            at = bisect_left(self.waiting, (p.length, -1))
            if at < len(self.waiting):
                self._fill(at, p)
            else:
                rest.append(p)
        rest.reverse()
        while rest and self.waiting:
            some, more = rest[-1].cut(min(rest[-1].length, self.waiting[-1][0]))
            rest.pop()
            if more.length:
                rest.append(more)
            self._fill(len(self.waiting) - 1, some)
        rest.reverse()
        rest += [p for _, number in self.waiting for p in self.bins.pop(number)]
        self.waiting = []
        total = sum(p.length for p in rest)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> b & 1]
        rest.reverse()
        for size in sizes:
            pieces: list[Piece] = []
            while size:
                some, more = rest[-1].cut(min(rest[-1].length, size))
                rest.pop()
                if more.length:
                    rest.append(more)
                pieces.append(some)
                size -= some.length
            self._place(pieces)


class LibraryWords(WordBpe):
    """Text to ids with the tokenizers library encoding each distinct word once."""

    def __init__(self, content: bytes, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        super().__init__(content)
        self.cache_words = cache_words
        self.library = Tokenizer.from_str(content.decode())
        self.library.no_padding()
        self.library.no_truncation()

    def _prepare(self, merges: list) -> None:
        """The library has what it needs."""

    def fill(self, words: list[str]) -> None:
        for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.cache[w] = self.pack(e.ids)


def load(content: bytes, cache_words: int = CACHE_WORDS) -> LibraryWords:
    return resident(("library", hashlib.sha256(content).digest(), cache_words), lambda: LibraryWords(content, cache_words))


#: Sequences that one task can number.
TASK_BITS = 40


def harmonic_pack(docs: DataFrame, content: bytes, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Cuts and packs all documents; one row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``cache_words`` trades a worker's memory for time.
    """
    Packer(capacity)
    shared = docs.sparkSession.sparkContext.broadcast(content)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [docs.schema[key], *(T.StructField(n, T.LongType()) for n in names)]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = Packer(capacity, TaskContext.get().partitionId() << TASK_BITS), None

        def placed() -> pa.RecordBatch:
            took = packer.take()
            rows = [(p.key, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, s, at) for p, s, at in took]
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            out = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])]
            if with_ids:
                out.append(pa.array([np.frombuffer(p.ids, dtype="<i4") for p, _, _ in took], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, [key, *names, *(["ids"] if with_ids else [])])

        bpe = None
        for b in row_chunks(batches, text, 4_000_000):
            bpe, kind = bpe or load(shared.value, cache_words), b.schema.field(key).type
            for k, ids in zip(b.column(key).to_pylist(), bpe.encode_texts(b.column(text).to_pylist()), strict=True):
                packer.add(k, ids + end)
            yield placed()
        if kind is not None:
            packer.finish()
            yield placed()

    return bound_batches(docs.select(key, text)).mapInArrow(trimmed(run), schema)


def vocabulary(path: str) -> bytes:
    """A tokenizer file's content; checked to be one with byte-level words."""
    with open(path, "rb") as f:
        content = f.read()
    if json.loads(content)["model"]["type"] != "BPE":
        raise ValueError("a BPE tokenizer file is needed")
    return content
