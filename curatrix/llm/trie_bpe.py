"""BPE encoding and decoding of a word-level BPE vocabulary by prefix-sharing trie traversal.

The distinct words of a batch, in sorted order, are the depth-first order of their trie. Every trie node holds the
last token of the encoding of its prefix; a child's state follows from its ancestors' states alone, so the encoding of
a prefix that many words share is computed once. The candidates for a node's last token are the vocabulary's tokens
that end there (an Aho-Corasick automaton gives them), and a candidate is right when it may follow the last token of
the prefix before it. Two tokens may follow each other exactly when no merge across their border comes before the
merges that build them.

Defined cases: null and empty texts have no tokens; null ids decode to the empty text; repeated rows get equal results;
an empty table gives no rows; texts of any length are encoded whole, and memory is bounded by text chunks and a bounded
word cache; columns named like the outputs are replaced, other columns do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curatrix.llm.common import bound_batches, resident, row_chunks, trimmed

#: Fixed value: Unicode white space, as a character class.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Words kept with their encodings in a generation of a worker's cache; there are two generations.
CACHE_WORDS = 400_000
#: Pairs of tokens whose check is remembered in a worker.
ALLOWED_PAIRS = 400_000
LATIN = 0x250
NEVER = 1 << 60
#: Writers of so many ids.
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte (the public GPT-2 rule)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _class(kind: str, top: int = 0x110000) -> str:
    """Ranges of a character class: the characters below ``top`` whose general category starts with ``kind``."""
    held = [unicodedata.category(chr(c))[0] == kind for c in range(top)]
    edges = [c for c in range(top + 1) if (c < top and held[c]) != (c > 0 and held[c - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def token_texts(spec: dict) -> list[str]:
    """The text of each id of a tokenizer file."""
    ids = {**spec["model"]["vocab"], **{x["content"]: x["id"] for x in spec["added_tokens"]}}
    out = [""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        out[i] = t
    return out


class WordBpe:
    """Encoder and decoder for a tokenizer file with byte-level letters and a word-end suffix."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = token_texts(spec)
        size = len(self.tokens)
        # Symbols: a byte is chr(byte), a byte that ends a word is chr(256 + byte).
        back = {x: b for b, x in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            s = "".join(chr(back[c]) for c in (token[: -len(suffix)] if ends else token))
            return s[:-1] + chr(256 + ord(s[-1])) if ends else s

        self.form = [""] * size
        for t, i in self.vocab.items():
            self.form[i] = symbols(t)
        self._prepare(model["merges"])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_words: int | None = None
        specials = "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.specials = re.compile(f"({specials})") if specials else None
        # Texts in Latin letters take a pattern with short classes; the long one is made when a text needs it.
        self.latin = self.pattern(LATIN)
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN - 1)}]").search

    @functools.cached_property
    def split(self):
        return self.pattern(0x110000)

    @staticmethod
    def pattern(top: int):
        letters, digits = _class("L", top), _class("N", top)
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACE}{letters}{digits}]+").findall

    def _prepare(self, merges: list) -> None:
        """What the trie walk needs: merges, outermost parts of tokens, the automaton."""
        #: rank of a merge by its parts; of a token: its parts and rank
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = self.vocab[a], self.vocab[b], self.vocab.get(a + b)
            if z is not None:
                self.rank[x << 20 | y] = r
                self.parts.setdefault(z, (x, y, r))
        self._spines()
        self._automaton()
        self.allowed: dict[int, bool] = {}

    def _spines(self) -> None:
        """For each token, its outermost parts from the single symbol upwards, each with the rank of the merge that ends it."""
        self.left: list[list[tuple[int, int]]] = [[]] * len(self.tokens)
        self.right: list[list[tuple[int, int]]] = [[]] * len(self.tokens)
        for i in self.vocab.values():
            for spines, side in ((self.left, 0), (self.right, 1)):
                path, t, end = [], i, NEVER
                while True:
                    path.append((t, end))
                    if t not in self.parts:
                        break
                    end, t = self.parts[t][2], self.parts[t][side]
                spines[i] = path[::-1]

    def _automaton(self) -> None:
        """Aho-Corasick over the tokens' symbols; ends[s]: tokens (id, length) that end in state s, longest first."""
        goto: list[dict[str, int]] = [{}]
        token: list[int] = [-1]
        for i, s in enumerate(self.form):
            if not s:
                continue
            at = 0
            for c in s:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    token.append(-1)
                at = goto[at][c]
            token[at] = i
        fail, order = [0] * len(goto), deque(goto[0].values())
        ends: list[tuple] = [()] * len(goto)
        while order:
            at = order.popleft()
            own = ((token[at], len(self.form[token[at]])),) if token[at] >= 0 else ()
            ends[at] = own + ends[fail[at]]
            for c, to in goto[at].items():
                f = fail[at]
                while f and c not in goto[f]:
                    f = fail[f]
                fail[to] = goto[f].get(c, 0)
                order.append(to)
        self.goto, self.fail, self.ends = goto, fail, ends

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b together is encoded as just these two."""
        right, left = self.right[a], self.left[b]
        i = j = 0
        while True:
            x, x_end = right[i]
            y, y_end = left[j]
            r = self.rank.get(x << 20 | y, NEVER)
            if r < x_end and r <= y_end and r < NEVER:
                return False
            if x_end == NEVER and y_end == NEVER:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        """Token ids of distinct words given in the order of their symbols: a depth-first walk of their trie."""
        goto, fail, ends, allowed, may_follow = self.goto, self.fail, self.ends, self.allowed, self.may_follow
        state, last, start = [0], [-1], [0]  # of each node on the path from the root; start: where its last token begins
        before = ""
        for w in words:
            d, most = 0, min(len(w), len(before))
            while d < most and w[d] == before[d]:
                d += 1
            del state[d + 1 :], last[d + 1 :], start[d + 1 :]
            for d in range(d, len(w)):  # noqa: B020
                c, s = w[d], state[d]
                while s and c not in goto[s]:
                    s = fail[s]
                s = goto[s].get(c, 0)
                for t, n in ends[s]:
                    at = d + 1 - n
                    if at:
                        pair = last[at] << 20 | t
                        ok = allowed.get(pair)
                        if ok is None:
                            ok = allowed[pair] = may_follow(last[at], t)
                        if not ok:
                            continue
                    break
                state.append(s)
                last.append(t)
                start.append(at)
            before = w
            ids, d = [], len(w)
            while d:
                ids.append(last[d])
                d = start[d]
            ids.reverse()
            yield ids
        if len(allowed) > ALLOWED_PAIRS:
            allowed.clear()

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower looks at a sigma's surroundings; the vocabulary's rule does not
                text = text.replace("Σ", "σ")
        text = text.lower()
        return (self.latin if text.isascii() or not self.beyond(text) else self.split)(text)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return PACK[len(ids)](*ids) if len(ids) < 16 else np.array(ids, dtype="<u4").tobytes()

    def fill(self, words: list[str]) -> None:
        """Puts the encodings of distinct words into the cache."""
        forms = {}
        for w in words:
            s = w.encode("utf-8", "surrogatepass").decode("latin-1")
            forms[s[:-1] + chr(256 + ord(s[-1]))] = w
        order = sorted(forms)
        for s, ids in zip(order, self.encode_words(order), strict=True):
            self.cache[forms[s]] = self.pack(ids)

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cache, special = self.cache, {}
        found: list[list[str]] = []
        for text in texts:
            if not text:
                found.append([])
            elif self.specials and "<" in text and self.specials.search(text):
                ws: list[str] = []
                for k, part in enumerate(self.specials.split(text)):
                    if k % 2:
                        special[part + " "] = np.array([self.added[part]], dtype="<u4").tobytes()
                        ws.append(part + " ")  # no word has a space
                    else:
                        ws += self.words(part)
                found.append(ws)
            else:
                found.append(self.words(text))
        if len(cache) > (self.cache_words or CACHE_WORDS):  # the generation before stays; what is used again moves into the new one
            self.old, self.cache = cache, {}
            cache = self.cache
        new = set().union(*found).difference(cache).difference(special)
        if old := self.old:
            again = new.intersection(old)
            cache.update({w: old[w] for w in again})
            new -= again
        self.fill(list(new))
        look = cache | special if special else cache
        return [b"".join([look[w] for w in ws]) for ws in found]


def load(content: bytes) -> WordBpe:
    """The worker's encoder for a tokenizer file, built once."""
    return resident(("trie", hashlib.sha256(content).digest()), lambda: WordBpe(content))


def ids_array(packed: list[bytes]) -> pa.Array:
    """Packed ids as a list<int32> array."""
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def decode_lists(lists: pa.Array, tokens: pa.Array) -> pa.Array:
    """Texts of lists of ids: tokens with their word ends, joined by one space."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    said = pa.LargeListArray.from_arrays(pa.array(offsets), tokens.take(lists.flatten()))
    return pc.binary_join(said, pa.scalar(" ", pa.large_string())).cast(pa.string())


def bpe_encode(df: DataFrame, content: bytes, text: str = "text", ids: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """``keep`` columns (default: all) of ``df`` and the token ids of the whole text as array<int>.

    ``decoded`` names a column for the text decoded from these ids by the same worker. ``content`` is the tokenizer
    file, read once on the driver; its size is fixed, so it is broadcast.
    """
    extra = [ids, *([decoded] if decoded else [])]
    keep = [c for c in (df.columns if keep is None else keep) if c not in extra]
    shared = df.sparkSession.sparkContext.broadcast(content)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value)
        tokens = pa.array(bpe.tokens, pa.large_string())
        for b in row_chunks(batches, text):
            out = [ids_array(bpe.encode_texts(b.column(text).to_pylist()))]
            if decoded:
                out.append(decode_lists(out[0], tokens))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], [*keep, *extra])

    return bound_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(trimmed(run), schema)


def bpe_decode(df: DataFrame, content: bytes, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the text of the ids, special tokens too; null ids decode to the empty text."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    shared = df.sparkSession.sparkContext.broadcast(content)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(token_texts(json.loads(shared.value)), pa.large_string())
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), decode_lists(b.column(ids), tokens)], [*keep, out])

    return bound_batches(df.select(*dict.fromkeys([*keep, ids]))).mapInArrow(trimmed(run), schema)
