"""Blocks of postings, which a task makes of its records before anything is shuffled.

A task inverts its records chunk by chunk: the occurrences of a chunk are sorted by token and field, and each token and field
becomes one row for every ``most`` occurrences, with the ids and positions side by side. What is shuffled and sorted later
are these rows, a tenth of the occurrences or fewer; as none is long, a token of any number of occurrences is many rows.

``docs`` says how many ids a block is the first to hold, among its chunk's blocks of this stem and field. Where each id is in
one chunk only, the sum is the number of the ids that have the stem in the field.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.stem import porter_stem

#: Occurrences of a block at most; bytes of a chunk's texts and postings of a chunk, about.
BLOCK, CHUNK_BYTES, CHUNK_POSTINGS = 32, 16_000_000, 2_000_000
#: Stems that a worker remembers.
_stem = lru_cache(1 << 17)(porter_stem)


def _schema(kind: str) -> str:
    return f"token string, stem string, field string, first {kind}, n int, docs int, ids array<{kind}>, pos array<int>"


def _inverted(tokens: pa.Array, field: np.ndarray, names: list[str], ids: pa.Array, row: np.ndarray, pos: np.ndarray, most: int) -> pa.RecordBatch:
    """Blocks of occurrences; in each field they come by record (``row`` of ``ids``) and position, records by id."""
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    stems = pa.array([_stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    key = code * len(names) + field
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    at = np.arange(len(key))
    new = np.append(True, key[1:] != key[:-1])
    starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % most == 0)
    # Each id counts where its stem comes first in the field; no id (null) counts nowhere.
    who = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy().astype(np.int64)[row]
    same = stems.dictionary_encode().indices.to_numpy().astype(np.int64)[code[order]] * len(names) + field[order]
    first = np.zeros(len(key), dtype=np.int32)
    first[np.unique(same * (len(ids) + 1) + who + 1, return_index=True)[1]] = 1
    first[who < 0] = 0
    edges = pa.array(np.append(starts, len(key)), pa.int32())
    token = pa.array(code[order][starts])
    cols = [coded.dictionary.take(token), stems.take(token), pa.array(names, pa.string()).take(pa.array(field[order][starts]))]
    cols += [ids.take(pa.array(row[starts])), pa.array(np.diff(np.append(starts, len(key))), pa.int32()), pa.array(np.add.reduceat(first, starts), pa.int32())]
    cols += [pa.ListArray.from_arrays(edges, v) for v in (ids.take(pa.array(row)), pa.array(pos[order], pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, ["token", "stem", "field", "first", "n", "docs", "ids", "pos"])


def _chunks(batches: Iterator[pa.RecordBatch], texts: list[str], size: int) -> Iterator[pa.Table]:
    """The batches in tables of about ``size`` rows and bytes of texts; a longer record stands alone."""
    held: list[pa.RecordBatch] = []
    have = 0
    for b in batches:
        sizes = sum((pc.fill_null(pc.binary_length(b.column(f)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in texts), np.ones(b.num_rows, dtype=np.int64))
        total = np.append(0, np.cumsum(sizes))
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(total, total[at] + size - have, "right")) - 1
            if end <= at and held:
                yield pa.Table.from_batches(held)
                held, have = [], 0
                continue
            end = max(end, at + 1)
            held.append(b.slice(at, end - at))
            have += int(total[end] - total[at])
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _whole(table: pa.Table, column: str) -> pa.Array:
    found = table.column(column).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts with single spaces between them, with each one's row and place."""
    lists = pc.split_pattern(texts, " ")
    sizes = np.where(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0)
    row = np.repeat(np.arange(len(texts)), sizes)
    words = lists.flatten()
    if len(words) > len(row):  # an empty text has one word, which is none
        words = words.filter(pc.not_equal(words, ""))
    return words, row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def of_records(texts: DataFrame, id: str, fields: list[str], most: int = BLOCK) -> DataFrame:
    """Blocks of records (id, and the words of each field, single spaces between them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, fields, CHUNK_BYTES):
            t = t.take(pc.sort_indices(t, [(id, "ascending")]))
            tokens, row, pos = zip(*(_words(_whole(t, f)) for f in fields), strict=True)
            if sum(map(len, tokens)):
                field = np.repeat(np.arange(len(fields)), [len(x) for x in tokens])
                yield _inverted(pa.concat_arrays(tokens), field, fields, _whole(t, id), np.concatenate(row), np.concatenate(pos), most)

    return texts.select(id, *fields).mapInArrow(run, _schema(texts.schema[id].dataType.simpleString()))


def of_occurrences(found: DataFrame, id: str, most: int = BLOCK) -> DataFrame:
    """Blocks of postings (token, field, id, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, [], CHUNK_POSTINGS):
            t = t.take(pc.sort_indices(t, [(id, "ascending"), ("pos", "ascending")]))
            field = _whole(t, "field").dictionary_encode()
            yield _inverted(_whole(t, "token"), field.indices.to_numpy().astype(np.int64), field.dictionary.to_pylist(), _whole(t, id), np.arange(t.num_rows), _whole(t, "pos").to_numpy(), most)

    return found.select("token", "field", id, "pos").mapInArrow(run, _schema(found.schema[id].dataType.simpleString()))


def occurrences(blocks: DataFrame, id: str, keep: list[str]) -> DataFrame:
    """One row per occurrence: ``keep`` columns, id, pos."""
    return blocks.select(*keep, F.inline(F.arrays_zip(F.col("ids").alias(id), "pos")).alias(id, "pos"))


def hits(blocks: DataFrame, id: str, keep: list[str]) -> DataFrame:
    """How often each record is in each block: ``keep`` columns, id, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ids, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            who = pc.fill_null(ids.dictionary_encode().indices, -1).to_numpy()
            # A block's ids are in order.
            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (who[1:] != who[:-1]))) if len(row) else row
            cols = [*(b.column(c).take(pa.array(row[starts])) for c in keep), ids.take(pa.array(starts)), pa.array(np.diff(np.append(starts, len(row))), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, id, "n"])

    kinds = [(c, blocks.schema[c].dataType.simpleString()) for c in keep] + [(id, blocks.schema["ids"].dataType.elementType.simpleString()), ("n", "bigint")]
    return blocks.select(*keep, "ids").mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds))
