"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue (operator 12).

The rank file (its path is a parameter) is read once on the driver and broadcast.
A text is cut by the public split pattern; every match (pre-token) is encoded by itself:

1. a pre-token that is a token as a whole is that token;
2. otherwise its bytes form a linked list, and every adjacent pair that can merge
   is filed under the rank of its merge.  The queue keeps one bucket of list
   positions a rank and a bitmap of two levels over the ranks (256 ranks a word,
   one bit a word on top): find-first-set on both levels names the lowest rank in
   constant time, whatever the length of the list;
3. a popped position whose pair has changed since is stale and skipped;
   otherwise the pair is merged in the list and its two new neighbour pairs are filed.

A pre-token above ``SHORT`` bytes is a list of its own (``merge``): n bytes cost O(n) pushes and
pops, so one that is megabytes long costs no more a byte than a short one.  The
new short pre-tokens of many texts share one list with gaps between them
(``merge_all``): a bucket then holds the places of one rank in all of them, and the first
place of every pre-token is merged at once with NumPy; its later places go back
into the bucket, as a merge may make a pair of lower rank that comes first.

Encodings of short pre-tokens are kept in a bounded cache of the task (two halves; when the younger
one is full it replaces the older one).  Nothing is shuffled.  Decoding joins the bytes of the ids.

Defined cases: a null or empty text has no tokens and decodes to no bytes;
special-token strings are ordinary text; a null ``doc_id`` and repeated rows are encoded like any
other; extra columns pass through (a column of the name ``_bytes`` must not exist already); empty tables
give empty results.  Letters and numbers are those of the ``regex`` module: code points younger than the
Unicode version of another library's build may be cut differently there.
"""

from __future__ import annotations

import base64
import re
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, with_column_schema

CACHE_WORDS = 1 << 17          # pre-tokens in one half of a task's cache
SHORT = 64                     # bytes of a pre-token that shares a list and is kept
SLICE, LEARN = 4 << 20, 4_000_000   # bytes of a slice, characters of texts learned at once
WORD_BITS = 8                  # ranks a bitmap word, as a power of two

#: the split pattern by plain sets, for texts of ASCII and of Latin-1 alone
_SHAPE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def _plain(letters: str, numbers: str, blanks: str) -> re.Pattern:
    return re.compile(_SHAPE.replace("{L}", letters).replace("{N}", numbers).replace("{S}", blanks))


_ASCII = _plain("A-Za-z", "0-9", r"\t-\r ")
_LATIN = _plain("A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0")


class ByteBpe:
    """Encoder for a rank file (lines of base64 token and rank; a rank is the token's id)."""

    def __init__(self, ranks: bytes, pattern: str):
        self.source = (ranks, pattern)
        self.token = {int(r): base64.b64decode(t) for t, r in map(bytes.split, ranks.splitlines())}
        self.whole = {t: r for r, t in self.token.items()}
        if any(bytes([b]) not in self.whole for b in range(256)):
            raise ValueError("the rank file must hold every single byte")
        self.single = [self.whole[bytes([b])] for b in range(256)]
        self.size = max(self.token) + 1
        self.pairs: dict[int, int] = {}
        for t, r in self.whole.items():
            for cut in range(1, len(t)):
                a, b = self.whole.get(t[:cut]), self.whole.get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a * self.size + b] = r
        self.pattern = regex.compile(pattern)
        # the fast forms stand for the public pattern only
        self.fast = pattern == public_pattern()
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.pair_keys, self.pair_made = keys, np.array([self.pairs[k] for k in keys.tolist()], dtype=np.int64)
        # the queue: it is empty between two calls
        self.bits = [0] * ((self.size >> WORD_BITS) + 1)
        self.bucket: list[list[int] | None] = [None] * self.size
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def __getstate__(self):
        return {"source": self.source}

    def __setstate__(self, state):
        self.__init__(*state["source"])

    def merge(self, raw: bytes) -> list[int]:
        """BPE of one pre-token: always the lowest rank, leftmost first."""
        n, size, pair = len(raw), self.size, self.pairs.get
        make = list if n < 1 << 16 else lambda x: array("q", x)    # boxed integers are faster, but take four times the room
        tok = make([self.single[b] for b in raw])
        after, before = make(range(1, n + 1)), make(range(-1, n - 1))
        bits, bucket, top, mask = self.bits, self.bucket, 0, (1 << WORD_BITS) - 1
        for i in range(n - 1):
            r = pair(tok[i] * size + tok[i + 1])
            if r is not None:
                if bucket[r] is None:
                    bucket[r] = [i]
                    bits[r >> WORD_BITS] |= 1 << (r & mask)
                    top |= 1 << (r >> WORD_BITS)
                else:
                    bucket[r].append(i)          # ascending positions form a heap already
        while top:
            word = (top & -top).bit_length() - 1
            b = bits[word]
            r = word << WORD_BITS | (b & -b).bit_length() - 1
            held = bucket[r]
            i = heappop(held)
            if not held:
                bucket[r] = None
                bits[word] = b = b & (b - 1)
                if not b:
                    top &= top - 1
            j = after[i]
            if tok[i] < 0 or j >= n or pair(tok[i] * size + tok[j]) != r:
                continue                         # stale: merged away, or its pair has changed
            tok[i], tok[j] = r, -1
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
            for x, y in ((before[i], i), (i, nxt)):
                if x < 0 or y >= n:
                    continue
                m = pair(tok[x] * size + tok[y])
                if m is None:
                    continue
                if bucket[m] is None:
                    bucket[m] = [x]
                    bits[m >> WORD_BITS] |= 1 << (m & mask)
                    top |= 1 << (m >> WORD_BITS)
                else:
                    heappush(bucket[m], x)
        return [t for t in tok if t >= 0]

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token made from each pair; ``size`` when the pair never merges."""
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_made[i], self.size)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """BPE of many short pre-tokens in one list with a gap after each."""
        raw = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        owner = np.repeat(np.arange(len(words), dtype=np.int32), length)
        gap = np.cumsum(length) - 1
        n, none = len(raw), self.size
        tok = np.array(self.single, dtype=np.int64)[raw]
        tok[gap] = -1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        # at[i]: rank of the pair that starts at i, as it is now (the gaps and the ends have none)
        at = np.full(n, none, dtype=np.int64)
        inner = np.flatnonzero((tok[:-1] >= 0) & (tok[1:] >= 0))
        at[inner] = self.made(tok[inner], tok[inner + 1])
        bits, bucket, top, mask = self.bits, self.bucket, 0, (1 << WORD_BITS) - 1
        order = np.argsort(at, kind="stable")[:int((at < none).sum())]
        rank, start = np.unique(at[order], return_index=True)
        for r, part in zip(rank.tolist(), np.split(order, start[1:])):
            bucket[r] = part.tolist()
            bits[r >> WORD_BITS] |= 1 << (r & mask)
            top |= 1 << (r >> WORD_BITS)
        while top:
            word = (top & -top).bit_length() - 1
            b = bits[word]
            r = word << WORD_BITS | (b & -b).bit_length() - 1
            here = np.array(bucket[r])
            bucket[r] = None
            bits[word] = b = b & (b - 1)
            if not b:
                top &= top - 1
            here = here[at[here] == r]                     # the others are stale
            if not len(here):
                continue
            push_at, push_rank = [], []
            if len(here) > 1:
                here.sort()
                own = owner[here]
                later = np.zeros(len(here), dtype=bool)
                later[1:] = own[1:] == own[:-1]
                if later.any():
                    push_at, push_rank = here[later].tolist(), [r] * int(later.sum())
                    here = here[~later]
            right = after[here]
            nxt, prev = after[right], before[here]
            tok[here], tok[right], at[right] = r, -1, none
            after[here], before[nxt] = nxt, here           # a gap follows every pre-token, so nxt is in the list
            x, y = tok[nxt], tok[prev]                     # -1 at gaps (prev of the first place is the last gap)
            new = self.made(np.concatenate([np.full(len(here), r), y]), np.concatenate([x, np.full(len(here), r)]))
            both = np.concatenate([here, prev])
            new[np.concatenate([x, y]) < 0] = none
            at[both] = new
            some = new < none
            for p, m in zip(push_at + both[some].tolist(), push_rank + new[some].tolist()):
                if bucket[m] is None:
                    bucket[m] = [p]
                    bits[m >> WORD_BITS] |= 1 << (m & mask)
                    top |= 1 << (m >> WORD_BITS)
                else:
                    bucket[m].append(p)
        live = tok >= 0
        ids, cut = tok[live].tolist(), np.cumsum(np.bincount(owner[live], minlength=len(words))).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *cut], cut)]

    def learn(self, words: list[str]) -> dict[str, tuple[int, str, bytes]]:
        """The encodings of distinct pre-tokens: number of tokens, decimal ids joined by commas, decoded bytes."""
        raw = [w.encode("utf-8", "replace") for w in words]
        got = [self.whole.get(b) for b in raw]
        got = [None if t is None else [t] for t in got]
        short = [i for i, g in enumerate(got) if g is None and len(raw[i]) <= SHORT]
        if short:
            for i, ids in zip(short, self.merge_all([raw[i] for i in short])):
                got[i] = ids
        return {w: (len(g), ",".join(map(str, g)), self.decode(g))
                for w, g in zip(words, (self.merge(b) if g is None else g for b, g in zip(raw, got)))}

    def split(self, text: str) -> list[str]:
        if self.fast:
            if text.isascii():
                return _ASCII.findall(text)
            try:
                text.encode("latin-1")
                return _LATIN.findall(text)
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def decode(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])

    def encode_texts(self, texts) -> tuple[list[int], list[str], list[bytes]]:
        """Per text: number of tokens, decimal ids joined by commas, decoded bytes.

        New pre-tokens are learned for several texts at once (``LEARN`` characters).
        """
        n, ids, back = [], [], []
        held: list[list[str]] = []
        size = 0

        def flush() -> None:
            words = set().union(*held)
            known = {}
            for half in (self.young, self.old):
                known.update((w, half[w]) for w in words & half.keys())
            known.update(self.learn(list(words - known.keys())))
            for ws in held:
                got = [known[w] for w in ws]
                n.append(sum([g[0] for g in got]))
                ids.append(",".join([g[1] for g in got]))
                back.append(b"".join([g[2] for g in got]))
            if len(self.young) + len(known) > CACHE_WORDS:
                self.old, self.young = self.young, {}
            room = CACHE_WORDS
            for w, g in known.items():
                if len(w) <= SHORT and room > 0:
                    self.young[w] = g
                    room -= 1
            held.clear()

        for t in texts:
            held.append(self.split(t or ""))
            size += len(t or "")
            if size >= LEARN:
                flush()
                size = 0
        flush()
        return n, ids, back


def public_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def rank_file() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def encode_bytes(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``_bytes`` (struct: ``n_tokens``, ``ids`` as decimal
    numbers joined by commas, ``decoded`` bytes)."""
    with open(path or rank_file(), "rb") as f:
        codec = docs.sparkSession.sparkContext.broadcast(ByteBpe(f.read(), pattern or public_pattern()))

    kind = pa.struct([("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary())])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches, SLICE):
            n, ids, back = codec.value.encode_texts(b.column(at).to_pylist())
            new = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(back, pa.binary())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, new], schema=b.schema.append(pa.field("_bytes", kind)))

    return docs.mapInArrow(run, with_column_schema(
        docs, "_bytes", "struct<n_tokens:long,ids:string,decoded:binary>"))
