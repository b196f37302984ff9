"""License scan with a generalised suffix automaton over license tokens (operator 8).

The automaton of all template texts and base phrases (a few hundred states) is
built on the driver and broadcast.  Texts stream through it: at every word it
gives the matching statistic, the longest word sequence ending there that
occurs in some template.  Words outside the template vocabulary reset it, so only
runs of known words are streamed.  Right-maximal matches of ``MIN_MATCH`` words
or more are chained per template (same order in text and template, small gaps);
a chain that covers ``MIN_COVER`` of a template and all of its distinguishing
words (version, noncommercial, sharealike and the like, in brackets below) gives
its span and label.  Of spans at one place the one with the most covered words
stays.  Base
phrases are found by the same pass: a phrase ends wherever its state is the
current state or one of its suffix ancestors.  Nothing is shuffled.

Defined cases: null or empty text has no words, no spans, empty labels and
score 0; a null ``doc_id`` and repeated rows are scanned like any other; extra
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, with_column_schema

#: fixed values: base phrases, as text after lower-casing, and their labels
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
_CC = "this work is licensed under a creative commons attribution"
_GNU = "this work is licensed under the gnu"
_FREE = "this program is free software you can redistribute it and or modify it under the terms of the"
_FSF = "as published by the free software foundation"
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution ")
_BSD_END = ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including "
            "but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
            "event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
            "consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
            "profits or business interruption however caused and on any theory of liability whether in contract strict liability or "
            "tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
            "possibility of such damage")
#: notices and short whole texts of common licenses (template text, label); bracketed words must be matched
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
     "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
     "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
     "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
     "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
     "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
     "other dealings in the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
     "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
     "any kind either express or implied see the license for the specific language governing permissions and limitations under "
     "the license", "apache-2"),
    *[(f"licensed under cc {kind} 4 0", "cc-" + name) for kind, name in [
        ("by", "by"), ("by [sa]", "by-sa"), ("by [nd]", "by-nd"), ("by [nc]", "by-nc"), ("by [nc] [sa]", "by-nc-sa"), ("by [nc] [nd]", "by-nc-nd")]],
    *[(f"{_CC} {kind}4 0 international license", "cc-" + name) for kind, name in [
        ("", "by"), ("[sharealike] ", "by-sa"), ("[noderivatives] ", "by-nd"), ("[noncommercial] ", "by-nc"),
        ("[noncommercial] [sharealike] ", "by-nc-sa"), ("[noncommercial] [noderivatives] ", "by-nc-nd")]],
    ("released under the creative commons [cc0] 1 0 universal", "cc0"),
    ("this work is dedicated to the public domain under creative commons [cc0] 1 0", "cc0"),
    ("to the extent possible under law the author has [waived] all copyright and related or neighboring rights to this work", "cc0"),
    *[(f"{_GNU} {kind} public license version {v}", name) for kind, v, name in [
        ("general", "[2]", "gpl-2"), ("general", "[3]", "gpl-3"), ("[lesser] general", "[2] [1]", "lgpl-2.1"),
        ("[lesser] general", "[3]", "lgpl-3"), ("[affero] general", "[3]", "agpl-3")]],
    *[(f"gnu {kind} public license version {v} {month} {year}", name) for kind, v, month, year, name in [
        ("general", "[2]", "june", "1991", "gpl-2"), ("general", "[3]", "29 june", "2007", "gpl-3"),
        ("[lesser] general", "[2] [1]", "february", "1999", "lgpl-2.1"), ("[lesser] general", "[3]", "29 june", "2007", "lgpl-3"),
        ("[affero] general", "[3]", "19 november", "2007", "agpl-3")]],
    (f"{_FREE} gnu general public license {_FSF}", "gpl"),
    *[(f"{_FREE} gnu {kind} public license {_FSF} either version {v} of the license or at your option any later version", name)
      for kind, v, name in [
        ("general", "[2]", "gpl-2"), ("general", "[3]", "gpl-3"), ("[lesser] general", "[2] [1]", "lgpl-2.1"),
        ("[lesser] general", "[3]", "lgpl-3"), ("[affero] general", "[3]", "agpl-3")]],
    ("this source code form is subject to the terms of the [mozilla] public license v 2 0 if a copy of the mpl was not distributed "
     "with this file you can obtain one at http mozilla org mpl 2 0", "mpl-2"),
    ("licensed under the [mozilla] public license version 2 0", "mpl-2"),
    ("released under the [isc] license", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted [provided] "
     "that the above copyright notice and this permission notice appear in all copies", "isc"),
    (_BSD + _BSD_END, "bsd"),
    (_BSD + "neither the name of the copyright holder nor the names of its contributors may be used to [endorse] or promote products "
     "derived from this software without specific prior written permission " + _BSD_END, "bsd"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
]
MIN_MATCH = 3
MAX_GAP = 8
MIN_COVER = 0.75
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word-id sequences."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        texts = [words_of(t) for t, _ in [*templates, *base]]
        self.need = [{i for i, w in enumerate(t.split()) if w[0] == "["} for t, _ in templates]
        self.labels = [label for _, label in [*templates, *base]]
        self.n_templates, self.sizes = len(templates), [len(t) for t in texts]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, t in enumerate(texts):
            last = 0
            for pos, w in enumerate(t):
                last = self._add(last, self.ids.setdefault(w, len(self.ids)), ends)
                ends[last].add((k, pos))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            ends[self.link[s]] |= ends[s]                     # a suffix ends wherever its extension does
        self.ends = [sorted(e) for e in ends]
        whole = {}                                            # phrase -> its state
        for k in range(self.n_templates, len(texts)):
            s = 0
            for w in texts[k]:
                s = self.next[s][self.ids[w]]
            whole[s] = [*whole.get(s, []), k]
        self.phrases: list[list[tuple[int, int]]] = []        # per state: (phrase, words needed)
        for s in range(len(self.len)):
            got, at = [], s
            while at > 0:
                got += [(k, self.sizes[k]) for k in whole.get(at, [])]
                at = self.link[at]
            self.phrases.append(got)

    def _add(self, last: int, c: int, ends: list) -> int:
        q = self.next[last].get(c)
        if q is not None and self.len[q] == self.len[last] + 1:
            return q
        if q is not None:
            return self._clone(last, c, q, ends)
        new = self._state(self.len[last] + 1, {}, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q, ends)
        return new

    def _state(self, size: int, follow: dict[int, int], ends: list) -> int:
        self.len.append(size)
        self.next.append(follow)
        self.link.append(0)
        ends.append(set())
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int, ends: list) -> int:
        k = self._state(self.len[p] + 1, dict(self.next[q]), ends)
        self.link[k], self.link[q] = self.link[q], k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def stream(self, ids: list[int]):
        """(state, matched length) after each word of a run of known words."""
        s, n = 0, 0
        for c in ids:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            yield s, n

    def scan(self, words: list[bytes]) -> dict:
        """Base places [(start, end, label)], chained spans [(start, end, label, cover)] in words."""
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        base, matches = [], []
        for lo, hi in zip(known[::2].tolist(), known[1::2].tolist()):
            if hi - lo < MIN_MATCH:
                continue
            run = list(self.stream(ids[lo:hi].tolist()))
            for i, (s, n) in enumerate(run):
                at = lo + i
                base += [(at - m + 1, at + 1, self.labels[k]) for k, m in self.phrases[s] if n >= m]
                if n >= MIN_MATCH and (i + 1 == len(run) or run[i + 1][1] <= n):
                    matches += [(k, at - n + 1, at + 1, e - n + 1) for k, e in self.ends[s] if k < self.n_templates]
        return {"base": sorted(base), "spans": self._chain(matches)}

    def _chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Best chain per place: matches of one template, in order in text and template, gaps of MAX_GAP at most."""
        spans = []
        by: dict[int, list] = {}
        for k, lo, hi, t in matches:
            by.setdefault(k, []).append((lo, hi, t, t + hi - lo))
        for k, ms in by.items():
            ms = sorted(set(ms))
            best: list[tuple[int, int, frozenset]] = []      # (covered template words, start, needed words met) of the chain ending here
            first = 0
            for i, (lo, hi, t0, t1) in enumerate(ms):
                own = frozenset(n for n in self.need[k] if t0 <= n < t1)
                cover, start, met = t1 - t0, lo, own
                while ms[first][1] + MAX_GAP < lo and first < i and ms[first][0] + self.sizes[k] + MAX_GAP < lo:
                    first += 1
                for j in range(first, i):
                    jlo, jhi, j0, j1 = ms[j]
                    if jlo < lo and jhi < hi and lo - jhi <= MAX_GAP and j0 < t0 and j1 < t1 and t0 - j1 <= MAX_GAP:
                        got, with_j = best[j][0] + min(t1 - t0, t1 - j1), best[j][2] | own
                        if (len(with_j), got) > (len(met), cover):
                            cover, start, met = got, best[j][1], with_j
                best.append((cover, start, met))
                if cover >= MIN_COVER * self.sizes[k] and len(met) == len(self.need[k]):
                    spans.append((cover, cover / self.sizes[k], start, hi, self.labels[k]))
        kept: list[tuple[int, int, str, float]] = []
        for _, share, lo, hi, label in sorted(set(spans), key=lambda x: (-x[0], -x[1], *x[2:])):
            if all(2 * (min(hi, b) - max(lo, a)) <= min(hi - lo, b - a) for a, b, *_ in kept):
                kept.append((lo, hi, label, share))
        return sorted(kept)


def scan_licenses(docs: DataFrame, text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """All columns of ``docs`` plus ``_license`` (struct: ``n_words``; ``base`` places and
    ``spans`` as arrays of structs in words, end exclusive)."""
    auto = docs.sparkSession.sparkContext.broadcast(Automaton(base, templates))
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    span = pa.struct([*place, pa.field("cover", pa.float64())])
    kind = pa.struct([("n_words", pa.int64()), ("base", pa.list_(place)), ("spans", pa.list_(span))])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            out = []
            for t in b.column(at).to_pylist():
                ws = words_of(t)
                got = auto.value.scan(ws)
                out.append({"n_words": len(ws), "base": [dict(zip(("start", "end", "label"), x)) for x in got["base"]],
                            "spans": [dict(zip(("start", "end", "label", "cover"), x)) for x in got["spans"]]})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], schema=b.schema.append(pa.field("_license", kind)))

    return docs.mapInArrow(run, with_column_schema(
        docs, "_license", "struct<n_words:long,base:array<struct<start:long,end:long,label:string>>,"
                    "spans:array<struct<start:long,end:long,label:string,cover:double>>>"))
