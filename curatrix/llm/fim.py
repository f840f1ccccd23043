"""Fill-in-middle transformation by a table-driven byte automaton.

One scan of the UTF-8 bytes drives a table over (state, byte). A state is how far a sentinel has been matched and whether
the last byte was a letter; the table gives the next state and what the transition says: a unit begins, a code point
begins, a sentinel ends here. Continuation bytes begin nothing. Texts stand one after the other with a byte between them
that UTF-8 never has, which puts the automaton back to its start. It forgets all but the last bytes, as many as the
longest sentinel has, so a buffer is scanned in lanes side by side, each of which first rereads the end of the lane before.
Transitions are counted by text and by block; a second pass finds a cut's block by the counts and the cut inside it.

Units are runs of letters A-Z, a-z and all other code points one by one. A text is cut into prefix, middle and suffix at
two drawn unit counts and written as it is (plain), as prefix, suffix, middle (psm) or as suffix, prefix, middle (spm),
with a sentinel before each part. Sentinels differ and have no end of one that begins another, so parts that hold none are found again.

Defined cases: a null or empty text is plain and empty; a text that holds a sentinel is plain; parts may be empty; very
long texts are scanned whole, alone in their batch; repeated rows give repeated results; a null id is drawn for as an
empty one; an empty table gives no rows; outputs replace columns of their names, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import bound_batches, resident, row_chunks

#: Prefix, suffix and middle are marked by these.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that stay plain, and of the others those with the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
UNIT, CHAR, FOUND = 1, 2, 4
#: Between two texts; never a byte of UTF-8.
GAP = 0xFF
LANES, BLOCK = 8192, 4096


class Automaton:
    """Table of (state, byte) to the next state and what the transition says."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS) -> None:
        words = [s.encode() for s in sentinels]
        overlap = any(a.endswith(b[:k]) for a in words for b in words for k in range(1, len(b) + (a != b)) if (a, k) != (b, len(b)))
        if not all(words) or len(set(words)) < len(words) or overlap:
            raise ValueError("sentinels must be different texts, none of which begins with the end of one")
        self.memory = max(map(len, words))
        heads = sorted({w[:k] for w in words for k in range(len(w) + 1)})
        number = {h: i for i, h in enumerate(heads)}
        table = np.zeros((2 * len(heads), 256), dtype=np.uint32)
        for head, i in number.items():
            for byte in range(256):
                seen = head + bytes([byte])
                node = next(number[seen[k:]] for k in range(len(seen) + 1) if seen[k:] in number)
                letter = bytes([byte]).isalpha()
                starts = byte & 0xC0 != 0x80 and byte != GAP
                for was in (0, 1):
                    said = CHAR * starts | UNIT * (starts and not (letter and was)) | FOUND * any(seen.endswith(w) for w in words)
                    table[2 * i + was, byte] = (2 * node + letter) << 8 | said
        self.start = np.uint32(2 * number[b""] << 8)
        self.table = table.ravel()

    def scan(self, data: np.ndarray) -> np.ndarray:
        """What each byte's transition says."""
        n = len(data)
        lanes = max(1, min(LANES, n // max(64, self.memory)))
        steps = -(-n // lanes)
        padded = np.full(lanes * steps, GAP, dtype=np.uint8)
        padded[:n] = data
        columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        state = np.full(lanes, self.start)
        back = np.full((self.memory, lanes), GAP, dtype=np.uint8)
        back[:, 1:] = columns[-self.memory :, :-1] if steps >= self.memory else GAP
        said = np.empty((steps, lanes), dtype=np.uint8)
        at, got = np.empty(lanes, dtype=np.uint32), np.empty(lanes, dtype=np.uint32)
        for k in range(-self.memory, steps):
            np.bitwise_or(state, columns[k] if k >= 0 else back[k], out=at)
            np.take(self.table, at, out=got, mode="clip")
            if k >= 0:
                said[k] = got
            np.bitwise_and(got, np.uint32(0xFFFFFF00), out=state)
        return said.T.reshape(-1)[:n]


class Scanned:
    """Texts in one buffer with their transitions; counts by text and by block, cuts by a second pass."""

    def __init__(self, automaton: Automaton, texts: list[bytes]) -> None:
        gap = bytes([GAP])
        data = np.frombuffer(gap.join(texts) + gap, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.end = self.start + sizes
        self.said = automaton.scan(data)
        unit = self.said & UNIT
        self.units = np.add.reduceat(unit, self.start, dtype=np.int64)
        self.found = np.bitwise_or.reduceat(self.said, self.start) & FOUND != 0
        blocks = np.add.reduceat(unit, np.arange(0, len(unit), BLOCK), dtype=np.int64)
        self.before_block = np.concatenate([[0], np.cumsum(blocks)])
        self.before_text = np.concatenate([[0], np.cumsum(self.units)[:-1]])

    def cut(self, i: int, units: int) -> int:
        """Where in the buffer the first ``units`` units of text ``i`` end."""
        if units >= self.units[i]:
            return int(self.end[i])
        rank = self.before_text[i] + units
        block = int(np.searchsorted(self.before_block, rank, side="right")) - 1
        inside = np.flatnonzero(self.said[block * BLOCK : (block + 1) * BLOCK] & UNIT)
        return block * BLOCK + int(inside[rank - self.before_block[block]])

    def chars(self, a: int, b: int) -> int:
        return int(np.count_nonzero(self.said[a:b] & CHAR))


def draws(seed: str, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight digits of sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, numbers: list[Column], text: str = "text", keep: list[str] | None = None, sentinels: tuple[str, ...] = SENTINELS, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """``keep`` columns with n (units), form, prefix_chars, middle_chars (null where plain) and output of each whole text.

    ``numbers`` (see `draws`) choose by their remainders: two cuts among 0 to n units, plain or not, suffix first or not.
    """
    outputs = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, k) for c, k in zip(outputs, kinds, strict=True))])
    # Columns go by position to the task, so no name of the input's clashes.
    given = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(text, F.lit("")).alias("text"), *(c.alias(f"h{i}") for i, c in enumerate(numbers)))
    marks = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = resident(("fim", sentinels), lambda: Automaton(sentinels))
        for b in row_chunks(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            scanned = Scanned(automaton, texts)
            h = [b.column(f"h{i}").to_pylist() for i in range(4)]
            rows = []
            for i, t in enumerate(texts):
                n = int(scanned.units[i])
                if not n or scanned.found[i] or h[2][i] % 100 >= 100 - plain:
                    rows.append((n, "plain", None, None, t))
                    continue
                low, high = sorted((h[0][i] % (n + 1), h[1][i] % (n + 1)))
                a, c, d = int(scanned.start[i]), scanned.cut(i, low), scanned.cut(i, high)
                prefix, middle, suffix = t[: c - a], t[c - a : d - a], t[d - a :]
                first = h[3][i] % 100 < spm
                order = (marks[1], suffix, marks[0], prefix) if first else (marks[0], prefix, marks[1], suffix)
                rows.append((n, "spm" if first else "psm", scanned.chars(a, c), scanned.chars(c, d), b"".join([*order, marks[2], middle])))
            made = [pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            made[4] = made[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f"k{i}") for i in range(len(keep))), *made], [*keep, *outputs])

    return bound_batches(given).mapInArrow(run, schema)


def restore(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that was transformed, from its output and form."""
    p, s, m = sentinels
    tail = lambda text, mark: F.substring(text, F.instr(text, mark) + F.lit(len(mark)), F.char_length(text))
    head = lambda text, mark: F.substring(text, F.lit(1), F.instr(text, mark) - F.lit(1))
    last = tail(output, m)
    psm = F.concat(head(tail(output, p), s), last, head(tail(output, s), m))
    spm = F.concat(head(tail(output, p), m), last, head(tail(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
