"""BPE encoding and decoding: speculate with longest matches, verify, merge only what fails (operator 6).

The vocabulary file (its path is a parameter) is read once on the driver and
broadcast.  Inside a task, the distinct new words of a slice of texts are encoded
together:

1. speculate: greedy longest-match tokens;
2. verify: a token sequence is the BPE encoding exactly when every token encodes
   to itself and every adjacent pair stays apart when merged on its own.  All
   adjacent pairs of all words are tested at once with NumPy: the merges of
   both tokens are undone from the highest rank down, looking for a merge
   across the border that would have come first;
3. words with a failing pair go through exact merging: many short words in
   step (NumPy), a long one with a priority queue.

Decoding maps ids to token strings joined by one space (the vocabulary
names no decoder).  Nothing is shuffled; a task's word cache is bounded and holds
numbers only: the strings of both columns are joined by Arrow, a slice at a time.

Defined cases: null or empty text has no tokens and decodes to the empty
text; special-token strings in a text become their ids; a null ``doc_id`` and
repeated rows are encoded like any other; extra columns pass through.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import slices, with_column_schema

CACHE_WORDS = 1 << 18
SLICE, SLICE_CHARS = 1 << 20, 300_000   # bytes of a slice, characters learned at once: they bound a worker's memory
MERGE_CELLS = 1 << 17                   # bytes of words merged in step, with their padding
SHORT = 48
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: letters and numbers of Latin-1, lower case (texts within Latin-1 are in NFC already)
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ \t-\r\x85\xa0{_LETTER}{_NUMBER}]+")
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")


def byte_alphabet() -> dict[str, int]:
    """The usual printable stand-in of each byte: itself when printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """Encoder for a word-end BPE vocabulary (JSON text of a ``tokenizers`` file)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        self.spec = spec
        model, alphabet = d["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        size = max(self.names) + 1
        self.left = np.arange(size, dtype=np.int64)      # parts of a merged token; an atom is its own part
        self.right = np.arange(size, dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab["".join(m)] for m in merges]
        if any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError("token ids must follow the merge order")
        self.ranks = {}
        for (a, b), c in zip(merges, made):
            self.left[c], self.right[c] = vocab[a], vocab[b]
            self.ranks[vocab[a], vocab[b]] = c
        pairs = sorted((a * size + b, c) for (a, b), c in self.ranks.items())
        self.size, self.pair_keys, self.pair_made = size, np.array([p for p, _ in pairs]), np.array([c for _, c in pairs])
        self.mid: dict[bytes, int] = {}
        self.end: dict[bytes, int] = {}
        self.atom_mid, self.atom_end = [0] * 256, [0] * 256
        for t, i in vocab.items():
            last = t.endswith(end) and len(t) > len(end)
            raw = bytes(alphabet[c] for c in (t[:-len(end)] if last else t))
            (self.end if last else self.mid)[raw] = i
            if len(raw) == 1:
                (self.atom_end if last else self.atom_mid)[raw[0]] = i
        # only tokens that encode to themselves may be proposed
        for table, last in ((self.mid, False), (self.end, True)):
            for raw, i in list(table.items()):
                if len(raw) > 1 and self.merge(raw, last) != [i]:
                    del table[raw]
        self.longest = max(map(len, [*self.mid, *self.end]))
        self.id_text, self.name_text = pa.array([str(i) for i in range(size)]), pa.array([self.names.get(i, "") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        """Empty the cache: a word's number, and for all words their tokens and where they end."""
        self.cache: dict[str, int] = {}
        self.tokens, self.ends = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def atoms(self, raw: bytes, last: bool = True) -> list[int]:
        out = [self.atom_mid[b] for b in raw]
        if last and raw:
            out[-1] = self.atom_end[raw[-1]]
        return out

    def merge(self, raw: bytes, last: bool = True) -> list[int]:
        """Exact BPE: always the lowest-ranked pair, leftmost first."""
        tok = self.atoms(raw, last)
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i, tok[i], tok[i + 1]) for i in range(n - 1) if (c := self.ranks.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            c, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = c, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.ranks.get((tok[x], tok[y]))) is not None:
                    heapq.heappush(heap, (m, x, tok[x], tok[y]))
        return [t for t in tok if t >= 0]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token made from each pair; ``size`` when the pair never merges (also beside padding, -1)."""
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[i] == key) & (a >= 0) & (b >= 0), self.pair_made[i], self.size)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words in step: each round does one merge in every unfinished word."""
        n = max(map(len, words))
        tok = np.full((len(words), n + 1), -1, dtype=np.int64)
        for i, w in enumerate(words):
            tok[i, :len(w)] = self.atoms(w)
        made = self.rank(tok[:, :-1], tok[:, 1:])
        out, row, cols = [None] * len(words), np.arange(len(words)), np.arange(n + 1)
        while len(row):
            at = made.argmin(axis=1)                # the leftmost of the lowest rank
            low = made[np.arange(len(row)), at]
            done = low == self.size
            for r, t in zip(row[done].tolist(), tok[done].tolist()):
                out[r] = [x for x in t if x >= 0]
            row, at, low, tok, made = row[~done], at[~done], low[~done], tok[~done], made[~done]
            if not len(row):
                break
            here = np.arange(len(row))
            width = tok.shape[1]
            skip = cols[None, :width - 1] + (cols[None, :width - 1] > at[:, None])
            tok[here, at] = low
            tok = np.take_along_axis(tok, skip, axis=1)
            tok = np.concatenate([tok, np.full((len(row), 1), -1)], axis=1) if width == 2 else tok
            made = np.take_along_axis(made, skip[:, :-1], axis=1) if width > 2 else np.full((len(row), 1), self.size)
            k = np.minimum(at, tok.shape[1] - 2)
            made[here, k] = self.rank(tok[here, k], tok[here, k + 1])
            k = np.maximum(at - 1, 0)
            made[here, k] = self.rank(tok[here, k], tok[here, k + 1])
        return out

    def propose(self, raw: bytes) -> list[int]:
        """Greedy longest match; the last token is a word-end token."""
        out, at, n = [], 0, len(raw)
        while at < n:
            if n - at <= self.longest and (t := self.end.get(raw[at:])) is not None:
                out.append(t)
                break
            for to in range(min(n - 1, at + self.longest), at, -1):
                if (t := self.mid.get(raw[at:to])) is not None:
                    out.append(t)
                    at = to
                    break
            else:                                   # one byte left: always in the end table
                out.append(self.atom_end[raw[at]])
                break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge ever crosses the border of each adjacent token pair."""
        ok = np.ones(len(a), dtype=bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(a), self.size + 1, dtype=np.int64)    # a crossing merge must rank below this
        while len(at):
            key = x * self.size + y
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[i] == key) & (self.pair_made[i] < bound)
            ok[at[crossed]] = False
            # undo the latest merge next to the border: the right part of x, or the left part of y
            x_atom, y_atom = self.right[x] == x, self.left[y] == y
            undo_x = ~x_atom & ((x > y) | y_atom)
            undo_y = ~y_atom & ~undo_x
            # a crossing merge of equal rank comes first only when it starts further left
            bound = np.where(undo_x, x, np.where(undo_y, y + 1, bound))
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            go = ~crossed & (undo_x | undo_y)
            at, x, y, bound = at[go], x[go], y[go], bound[go]
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        got = [self.propose(w) for w in words]
        n = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        flat = np.fromiter((t for g in got for t in g), dtype=np.int64, count=int(n.sum()))
        owner = np.repeat(np.arange(len(got)), n)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.empty(0, dtype=np.int64)
        pair, where = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        ok = self.compatible(pair // self.size, pair % self.size)
        fail = np.unique(owner[inner[~ok[where]]])
        size = np.array([len(words[i]) for i in fail])
        for lo, hi in ((0, 8), (8, 16), (16, SHORT)):
            some = fail[(size > lo) & (size <= hi)] if len(fail) else fail
            for at in range(0, len(some), MERGE_CELLS // hi):
                part = some[at:at + MERGE_CELLS // hi]
                for i, t in zip(part.tolist(), self.merge_all([words[i] for i in part])):
                    got[i] = t
        for i in fail[size > SHORT] if len(fail) else []:
            got[i] = self.merge(words[i])
        return got

    def split(self, text: str) -> list[str]:
        """Words of a text; special-token strings stand for themselves."""
        if "<|" not in text:
            return self._words(text)
        out = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text.lower())
        try:
            text.encode("latin-1")
            return _LATIN.findall(text.lower())
        except UnicodeEncodeError:
            pass
        return _ANY.findall(self.normalizer.normalize_str(text))

    @property
    def normalizer(self):
        if not hasattr(self, "_normalizer"):
            from tokenizers import Tokenizer
            self._normalizer = Tokenizer.from_str(self.spec).normalizer
        return self._normalizer

    def __getstate__(self):
        return {"spec": self.spec}

    def __setstate__(self, state):
        self.__init__(state["spec"])

    def learn(self, words: set[str]) -> None:
        """Put the encodings of ``words`` into the cache."""
        plain = [w for w in words if w not in self.special]
        special = [w for w in words if w in self.special]
        got = [*self.encode_words([w.encode() for w in plain]), *([self.special[w]] for w in special)]
        self.cache.update(zip(chain(plain, special), range(len(self.cache), len(self.cache) + len(got))))
        n = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        self.tokens = np.append(self.tokens, np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(n.sum())))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(n))

    def encode_texts(self, texts) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Per text: number of tokens, decimal ids joined by a space, decoded text.

        Distinct words are learned for several texts at once (``SLICE_CHARS``).
        """
        parts: list[tuple[pa.Array, pa.Array, pa.Array]] = []
        held: list[list[str]] = []
        size = 0

        def flush() -> None:
            words = set().union(*held)
            new = words.difference(self.cache)
            if new:
                if len(self.cache) + len(new) > CACHE_WORDS:   # then words known now may go: learn all of them anew
                    self.forget()
                    new = words
                self.learn(new)
            many = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
            word = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(held)), dtype=np.int64, count=int(many.sum()))
            held.clear()
            first = self.ends[word]
            n = self.ends[word + 1] - first
            end = np.append(0, np.cumsum(n))                   # of each word's tokens among all
            ids = pa.array(self.tokens[np.arange(end[-1]) + np.repeat(first - end[:-1], n)])
            bounds = end[np.append(0, np.cumsum(many))]        # of each text's tokens
            of_text = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), t.take(ids)) for t in (self.id_text, self.name_text)]
            parts.append((pa.array(np.diff(bounds)), *(pc.binary_join(t, " ") for t in of_text)))

        for t in texts:
            held.append(self.split(t or ""))
            size += len(t or "")
            if size >= SLICE_CHARS:
                flush()
                size = 0
        flush()
        return tuple(pa.concat_arrays(x) for x in zip(*parts))


def word_bpe_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", before: tuple[Callable, StructType] | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``_bpe`` (struct: ``n_tokens``, ``ids`` as decimal
    numbers joined by a space, ``decoded``).

    ``before``: a step over Arrow batches and its schema, run first in the same worker
    (as a ``mapInArrow`` of its own it would hold a second worker a core).
    """
    with open(path or word_bpe_path(), encoding="utf-8") as f:
        codec = docs.sparkSession.sparkContext.broadcast(WordBpe(f.read()))

    kind = pa.struct([("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
    step, schema = before or (iter, docs.schema)
    at = schema.names.index(text_col)

    def run(batches):
        for b in slices(step(batches), SLICE):
            new = pa.StructArray.from_arrays(codec.value.encode_texts(b.column(at).to_pylist()), fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, new], schema=b.schema.append(pa.field("_bpe", kind)))

    return docs.mapInArrow(run, with_column_schema(
        schema, "_bpe", "struct<n_tokens:long,ids:string,decoded:string>"))
