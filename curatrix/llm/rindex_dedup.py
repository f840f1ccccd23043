"""Repeated passages by a run-length index.

A passage is repeated where a string of ``length`` bytes also starts anywhere else, in another text or the same one.
Every byte under such a string is a repeated byte.

1. Each window of ``length`` bytes has an anchor, the leftmost of the ``anchor`` bytes long strings in it with the least
   hash. Windows that follow each other with one anchor in one place are a stretch. Equal windows have equal anchors at
   equal distances, so only stretches of one anchor's group can share windows, and none shares one with itself. Groups
   with a single stretch hold no repeat.
2. The bytes of the stretches in such groups are cut out and counted, equal ones together, before they meet: a digest
   names them, and the bytes beside it tell stretches with one digest apart.
3. Groups of different stretches go, with the bytes of each different stretch once and the number of its copies, into
   run-length indexes: the Burrows-Wheeler transform of the stretches, its runs, and the text positions sampled at the
   runs' ends. The length of the longest match with the neighbour in suffix order is computed at the sampled positions
   only; walking through the text, it falls by one per byte until the next sample. Positions whose match reaches
   ``length`` are repeats. In the transform of all copies, those of one stretch stand side by side and match to its
   end; so their runs need not be made, and where a group has no other stretch, the index is the number of copies.
4. A group with more than ``hot`` different stretches would not fit one index. Its stretches get anchors again, longer
   ones with another hash (`anchors`), and fall apart into groups of their own, from step 2 on. A stretch makes a few
   shorter ones, of which only those with company go on. The last anchor is a whole window, where step 2 decides.

Defined cases: a null text is empty and has no repeats; texts shorter than ``length`` have none; all copies of a
repeated passage count, the first one too; equal texts of at least ``length`` bytes are repeated throughout; U+0000 is a
byte as any other; texts of any length are worked on in pieces of bounded size; an empty table gives no rows; repeated
rows, also with a null key, give equal results; extra columns, whatever their names, are kept and do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Scratch, bound_batches, release, row_chunks, trimmed

LENGTH = 400
ANCHOR = 128
#: Different stretches of one anchor that are gathered in one index; larger groups get longer anchors first.
HOT = 1024
#: By how much each round of anchors shortens what a stretch can hold.
NARROWER = 4
#: Bytes of stretches in one index; whole anchor groups, so one group may go beyond it.
INDEX_BYTES = 1_500_000

U = np.uint64
#: Bits for a place in the bytes that are hashed at once, and the bytes of a longer text that are hashed at once.
PLACE = U(28)
PIECE_BYTES = 1 << 23
#: Letters of the index: bytes from 1 on, 0 between stretches. So many of them make a word of 64 bits.
LETTER_BITS, LETTERS = 9, 7
_powers: list[np.ndarray] = []
_BASE, _INVERSE = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=U)
            t[0] = U(1)
            made.append(np.multiply.accumulate(t))
        _powers[:] = made
    return _powers


def anchors(length: int, anchor: int) -> list[int]:
    """Anchor lengths of the rounds; the last is a whole window."""
    out = [min(anchor, length)]
    while out[-1] < length:
        out.append(length - (length - out[-1] + 1) // NARROWER + 1 if length - out[-1] + 1 >= 2 * NARROWER else length)
    return out


def stretches(texts: list[bytes], length: int, anchor: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, number of windows and anchor of each stretch of the texts."""
    if all(len(t) <= PIECE_BYTES for t in texts):
        return _stretches(texts, length, anchor, seed)
    # A long text in pieces; together they have all its windows, each once.
    out = []
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), PIECE_BYTES):
            _, start, count, key = _stretches([t[lo : lo + PIECE_BYTES + length - 1]], length, anchor, seed)
            out.append((np.full(len(start), i), start + lo, count, key))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _stretches(texts: list[bytes], length: int, anchor: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    if n < length:
        return none, none, none, none
    power, inverse = _tables(n)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * power[:n], out=total[1:])
    grams = _mix((total[anchor:] - total[:-anchor]) * inverse[: n - anchor + 1] + U(seed))
    # Sliding minimum over blocks: least of a block's tail and of the next block's head. Places below the hashes' upper
    # bits make the leftmost of equal ones the least.
    width = length - anchor + 1
    fill = -len(grams) % width
    placed = ((grams >> PLACE) << PLACE) | np.arange(len(grams), dtype=U)
    blocks = np.concatenate([placed, np.full(fill, ~U(0))]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = (np.minimum(tail[:windows], head[width - 1 : width - 1 + windows]) & ((U(1) << PLACE) - U(1))).astype(np.int64)
    edges = np.cumsum([0, *(len(t) for t in texts)])
    # A stretch begins where the anchor's place changes or a text does; windows that leave their text are cut off.
    new = np.empty(windows, dtype=bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[edges[(edges > 0) & (edges < windows)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], windows)
    text = np.searchsorted(edges, start, "right") - 1
    end = np.minimum(end, edges[text + 1] - length + 1)
    ok = end > start
    start, end, text = start[ok], end[ok], text[ok]
    return text, start - edges[text], end - start, grams[least[start]].view(np.int64)


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of letters by prefix doubling, and the LETTERS letters at each position as a number."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(LETTERS, dtype=data.dtype)])
    word = np.zeros(n, dtype=U)
    for j in range(LETTERS):
        word = (word << U(LETTER_BITS)) | padded[j : j + n]
    order = np.argsort(word)
    by = word[order]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(by[1:], by[:-1], out=new[1:])
    rank = np.zeros(2 * n + 2 * LETTERS, dtype=np.int64)  # 0: past the end
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first + 1
    last = np.append(new[1:], True)
    open_ = np.flatnonzero(~(new & last))
    step = LETTERS
    while len(open_):
        p = order[open_]
        pair = (rank[p] << 32) | rank[np.minimum(p + step, n)]
        sort = np.argsort(pair)
        p, pair = p[sort], pair[sort]
        order[open_] = p
        new = np.empty(len(p), dtype=bool)
        new[0] = True
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
        rank[p] = open_[begin] + 1
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return order, word


def _common(word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b, a pair at a time in step."""
    n = len(word)
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        d = word[x] ^ word[y]
        same = d == 0
        part, differ = live[~same], d[~same]
        got = np.zeros(len(part), dtype=np.int64)
        for j in range(1, LETTERS):
            got += (differ >> U(j * LETTER_BITS)) == 0
        out[part] += got
        live = live[same]
        out[live] += LETTERS
    return np.minimum(out, n - np.maximum(a, b))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of letters with text positions sampled at both ends of each run."""

    def __init__(self, data: np.ndarray) -> None:
        order, word = suffix_array(data)
        self.n = len(data)
        before = np.where(order > 0, data[order - 1].astype(np.int32), -1)
        head = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
        self.letters, self.starts = before[head], head
        self.head_sample = order[head]
        self.tail_sample = order[np.append(head[1:], self.n) - 1]
        # Match lengths across each border between two runs: of a run's first suffix with the one before it.
        self.border = _common(word, self.tail_sample[:-1], self.head_sample[1:])

    def _walk(self, samples: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = np.zeros(self.n, dtype=np.int64)
        sampled = np.zeros(self.n, dtype=bool)
        at[samples], sampled[samples] = lengths, True
        last = np.maximum.accumulate(np.where(sampled, np.arange(self.n), 0))
        return at[last] - (np.arange(self.n) - last)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of its longest match with a string that starts anywhere else in the text."""
        down = self._walk(self.head_sample, np.concatenate([[0], self.border]))
        up = self._walk(self.tail_sample, np.append(self.border, 0))
        return np.maximum(down, up)


def letters(parts: list[bytes]) -> np.ndarray:
    """The parts with a letter that no byte is between them."""
    out = np.zeros(sum(len(p) + 1 for p in parts), dtype=np.uint16)
    at = 0
    for p in parts:
        out[at : at + len(p)] = np.frombuffer(p, dtype=np.uint8)
        out[at : at + len(p)] += 1
        at += len(p) + 1
    return out


def repeated_windows(parts: list[bytes], length: int, copies: list[int] | None = None) -> list[np.ndarray]:
    """For each part, whether its window at each place also starts anywhere else in the parts, of which there may be copies.

    A window has no separator in it, so none of its matches crosses one.
    """
    matches = RunIndex(letters(parts)).matching_statistics()
    edges = np.cumsum([0, *(len(p) + 1 for p in parts)])
    found = [matches[e : e + len(p) - length + 1] >= length for e, p in zip(edges[:-1], parts, strict=True)]
    return [f | (n > 1) for f, n in zip(found, copies or [1] * len(parts), strict=True)]


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and length of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True)


def identity(text: Column) -> list[Column]:
    """A wide digest of a text, in two halves."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("text"), F.octet_length(t), t).alias("t2")]


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


#: Names the bytes of a stretch; what it says is checked against the bytes.
digest = xxhash.xxh3_128_digest
STRETCH = "key long, c1 long, c2 long, copies long, t1 long, t2 long, start long, windows long, part binary"


def _stretch_rows(key: np.ndarray, cut: list[bytes], copies: pa.Array, t1: pa.Array, t2: pa.Array, start: pa.Array, windows: pa.Array) -> pa.RecordBatch:
    wide = np.frombuffer(b"".join(digest(x) for x in cut), dtype=np.int64).reshape(-1, 2)
    cols = [pa.array(key), *(pa.array(wide[:, i].copy()) for i in (0, 1)), copies, t1, t2, start, windows, pa.array(cut, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, [f.split(" ")[0] for f in STRETCH.split(", ")])


def _occurrences(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """Stretches of all rows (t1, t2, rid, text): anchor, place and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in row_chunks(batches, "text", 500_000):
            row, start, count, key = stretches(_bytes_of(b.column("text")), length, anchor)
            take = pa.array(row)
            cols = [pa.array(key), *(b.column(x).take(take) for x in ("t1", "t2", "rid")), pa.array(start.astype(np.int64)), pa.array(count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "t1", "t2", "rid", "start", "windows"])

    return rows.select("t1", "t2", "rid", "text").mapInArrow(trimmed(run), "key long, t1 long, t2 long, rid long, start long, windows long")


def _cut_out(joined: DataFrame, length: int) -> DataFrame:
    """Stretches with their bytes: rows of a text with its wanted list of (key, start, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in row_chunks(batches, "text", 500_000):
            texts, wanted = _bytes_of(b.column("text")), b.column("wanted")
            row = pa.array(np.repeat(np.arange(len(texts)), pc.list_value_length(wanted).to_numpy(zero_copy_only=False)))
            flat = wanted.flatten()
            key, start, windows = (flat.field(n) for n in ("key", "start", "windows"))
            cut = [texts[r][s : s + c + length - 1] for r, s, c in zip(row.to_pylist(), start.to_pylist(), windows.to_pylist(), strict=True)]
            yield _stretch_rows(key.to_numpy(), cut, pa.array(np.ones(len(cut), dtype=np.int64)), b.column("t1").take(row), b.column("t2").take(row), start, windows)

    return joined.mapInArrow(trimmed(run), STRETCH)


def _by_index(parts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of single stretches in groups of several: (t1, t2, start, windows)."""
    columns = ["key", "copies", "c1", "c2", "start", "t1", "t2", "part"]
    dealt = parts.select(*columns).repartition("key").sortWithinPartitions("key")

    def found(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        distinct = {g[:1] + g[2:4]: g for g in group}  # rows that share an id and a text come more than once
        rows = list(distinct.values())
        out = []
        for g, flags in zip(rows, repeated_windows([g[7] for g in rows], length, [g[1] for g in rows]), strict=True):
            if g[1] == 1:
                out += [(g[5], g[6], g[4] + s, c) for s, c in _runs(flags)]
        cols = zip(*out, strict=True) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["t1", "t2", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        group: list[tuple] = []
        size = 0
        for b in row_chunks(batches, "part", 1_000_000):
            for g in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if size >= INDEX_BYTES and g[0] != group[-1][0]:
                    yield from found(group)
                    group, size = [], 0
                if not group or g[:4] != group[-1][:4]:
                    group.append(g)
                    size += len(g[7])
        if group:
            yield from found(group)

    return dealt.mapInArrow(trimmed(run), "t1 long, t2 long, start long, windows long")


def _again(parts: DataFrame, length: int, anchor: int) -> DataFrame:
    """The stretches of ``parts`` (copies, start, t1, t2, part) for longer anchors, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in row_chunks(batches, "part", 250_000):
            texts = b.column("part").to_pylist()
            row, start, count, key = stretches(texts, length, anchor, anchor)
            cut = [texts[r][s : s + c + length - 1] for r, s, c in zip(row.tolist(), start.tolist(), count.tolist(), strict=True)]
            take = pa.array(row)
            begin = pc.add(b.column("start").take(take), pa.array(start.astype(np.int64)))
            yield _stretch_rows(key, cut, *(b.column(x).take(take) for x in ("copies", "t1", "t2")), begin, pa.array(count.astype(np.int64)))

    return parts.select("copies", "start", "t1", "t2", "part").mapInArrow(trimmed(run), STRETCH)


def _contents(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``found`` (STRETCH) and its different stretches (key, c1, c2, copies, t1, t2, start, windows, part), one place each.

    Different bytes have different names (key, c1, c2) in both.
    """
    place = F.struct("t1", "t2", "start", "windows")
    names = ["key", "c1", "c2"]

    def counted(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*names, "part").agg(F.sum("copies").alias("copies"), F.min(place).alias("at"))
        return scratch.keep(out.select(*names, "copies", "at.*", "part"), "contents")

    contents = counted(found)
    same = scratch.keep(contents.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*names), "same-names")
    if same.isEmpty():
        return found, contents
    own = scratch.keep(contents.join(same, names, "left_semi").select(*names, "part").withColumn("own", F.monotonically_increasing_id()), "own-names")
    renamed = found.join(own, [*names, "part"], "left")
    renamed = renamed.withColumn("c2", F.when(F.col("own").isNull(), F.col("c2")).otherwise(F.lit(-1))).withColumn("c1", F.coalesce("own", "c1")).select(*found.columns)
    renamed = scratch.keep(renamed, "renamed")
    scratch.drop(found, contents)
    return renamed, counted(renamed)


def _decide(found: DataFrame, length: int, hot: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """Repeated windows (t1, t2, start, windows) of the stretches ``found`` (STRETCH), and the stretches of hot groups.

    The windows are kept as tables; those with the stretches' bytes, ``found`` too, go as soon as nothing reads them.
    """
    found, contents = _contents(found, scratch)
    copied = contents.filter("copies > 1").select("key", "c1", "c2")
    copied = found.filter("copies = 1").join(copied, ["key", "c1", "c2"], "left_semi").select("t1", "t2", "start", "windows")
    out = [scratch.keep(copied, "copied")]
    # Anchors of several different stretches, some of them without a copy.
    groups = contents.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("copies").alias("fewest")).filter("m > 1 and fewest = 1")
    mixed = contents.join(groups.select("key", (F.col("m") > hot).alias("hot")), "key").withColumn("copies", F.least("copies", F.lit(2).cast("long")))
    mixed = scratch.keep(mixed, "mixed")
    scratch.drop(found, contents)
    out.append(scratch.keep(_by_index(mixed.filter("not hot"), length), "indexed"))
    large = mixed.filter("hot")
    large = None if large.isEmpty() else scratch.keep(large, "large")
    scratch.drop(mixed)
    return out, large


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(t1, t2, spans): for each text with repeats, by its identity, the starts and numbers of repeated windows."""
    scratch = Scratch(docs.sparkSession, "rindex")
    anchor, *longer = anchors(length, anchor)
    rows = docs.select(*identity(F.col(text)), F.xxhash64(key).alias("rid"), F.coalesce(text, F.lit("")).alias("text")).filter(F.octet_length("text") >= length)
    rows = bound_batches(rows)
    found = scratch.keep(_occurrences(rows, length, anchor), "stretches")
    # Kept as a table, so that the join below is between two plain exchanges, whose hot partitions Spark can split.
    several = scratch.keep(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "several")
    wanted = found.join(several, "key", "left_semi").groupBy("t1", "t2", "rid").agg(F.collect_set(F.struct("key", "start", "windows")).alias("wanted"))
    # Kept, too: rows that repeat with their ids are one key of the join with it.
    wanted = scratch.keep(wanted, "wanted")
    scratch.drop(found, several)
    parts = scratch.keep(_cut_out(rows.join(wanted, ["t1", "t2", "rid"]).select("t1", "t2", "text", "wanted"), length), "parts")
    scratch.drop(wanted)
    spans, large = _decide(parts, length, hot, scratch)
    for anchor in longer:
        if large is None:
            break
        # With a whole window as the anchor, a stretch is one window, and equal bytes have decided.
        again = scratch.keep(_again(large, length, anchor), "again")
        scratch.drop(large)
        more, large = _decide(again, length, hot, scratch)
        spans += more
    out = reduce(DataFrame.unionByName, spans).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    return scratch.keep(out, "spans")


def byte_ranges(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal ranges of bytes under repeated windows."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["start"] + s["windows"] - 1 + length) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_parts(data: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
    edges = [0, *(x for r in ranges for x in r), len(data)]
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def whole_characters(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges cut back so that no character loses only some of its bytes."""
    out = []
    for a, b in ranges:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


#: Scripts without spaces between words: of the first, each letter is a word; of the others, up to three letters with their marks are.
IDEOGRAPHS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}"
SYLLABLES = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
_unspaced = regex.compile(rf"[{IDEOGRAPHS}]|(?:(?=[{SYLLABLES}])\p{{L}}\p{{M}}*){{1,3}}")


def count_words(data: bytes) -> int:
    """Words of a text: what white space of ASCII separates, and each word of a script without spaces for itself."""
    if data.isascii():
        return len(data.split())
    rest, found = _unspaced.subn(" ", data.decode("utf-8", "ignore"))
    # Beside such words, marks and punctuation alone are none.
    words = rest.encode().split()
    return found + (sum(1 for w in words if regex.search(r"[\p{L}\p{N}]", w.decode())) if found else len(words))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, whole: bool = False, anchor: int = ANCHOR, words: int = 0) -> DataFrame:
    """``keep`` columns, kept (binary: what is left), kept_text (the same as text, without characters that lost some of
    their bytes), removed (array of start and end) of every row.

    With ``whole``, no character is split: kept is then valid UTF-8. Repeats of fewer than ``words`` words, by
    `count_words`, stay.
    """
    outputs = ["kept", "kept_text", "removed"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    spans = repeated_spans(docs, length, key, text, anchor)
    rows = docs.select(*dict.fromkeys([*keep, text])).withColumnsRenamed({c: f"_in_{c}" for c in ("t1", "t2", "spans") if c in docs.columns})
    renamed = [f"_in_{c}" if c in ("t1", "t2", "spans") else c for c in keep]
    said = f"_in_{text}" if text in ("t1", "t2", "spans") else text
    ids = identity(F.col(said))
    joined = rows.withColumns({"t1": ids[0], "t2": ids[1]}).join(spans, ["t1", "t2"], "left").select(*rows.columns, "spans")
    fields = ", ".join(f"`{k}` {rows.schema[r].dataType.simpleString()}" for k, r in zip(keep, renamed, strict=True))
    schema = (fields + ", " if fields else "") + "kept binary, kept_text string, removed array<struct<start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in row_chunks(batches, said, 2_000_000):
            left, said_left, gone = [], [], []
            for data, found in zip(_bytes_of(b.column(said)), b.column("spans").to_pylist(), strict=True):
                ranges = byte_ranges(found, length)
                ranges = whole_characters(data, ranges) if whole else ranges
                ranges = [(a, e) for a, e in ranges if count_words(data[a:e]) >= words] if words else ranges
                parts = kept_parts(data, ranges)
                left.append(b"".join(parts) if ranges else data)
                said_left.append("".join(p.decode("utf-8", "ignore") for p in parts))
                gone.append([{"start": a, "end": e} for a, e in ranges])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in renamed), pa.array(left, pa.binary()), pa.array(said_left, pa.string()), pa.array(gone, kind)], [*keep, *outputs])

    return joined.mapInArrow(trimmed(run), schema)
