"""License scan by ordered signature rules.

Base phrases are words that stand consecutively. On top, the three hundred
hand-written patterns of ``signatures`` look for identifiers, sentences of license
texts, links, names and notices. A rule runs only on texts that contain its keyword,
and no rule on texts without any keyword, which is decided for a whole slice of
texts by substring search. Where detections overlap, rules go by priority, then
length, then order: one that lies inside an accepted one is dropped, and so is
one of lower priority that overlaps an accepted one.

Everything is decided within a text, so there is no shuffle.

Defined cases: null or empty text has no words, no labels (empty strings), null
first and last word and score 0; repeated rows keep a row each; null doc_id is
kept; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import _text as X
from tarn.llm import signatures

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

EDGES = rb"(?<![a-z0-9\x80-\xff])", rb"(?![a-z0-9\x80-\xff])"
BLANKS = r"[\x09-\x0d\x20]"


@dataclass(frozen=True)
class Rule:
    """A signature: less priority is stronger; ``word``, the longest of its keyword, must occur for the pattern to be tried."""

    priority: int
    label: str
    word: bytes
    pattern: re.Pattern


def rules() -> list[Rule]:
    """The signatures by priority, then in their order."""
    out = []
    for priority, label, keyword, text in signatures.lines():
        text = text.replace("[- ]", "(?:-| )").replace(" ?", f"{BLANKS}*").replace(" ", f"{BLANKS}+")
        pattern = re.compile(EDGES[0] + b"(?:" + text.encode("latin-1") + b")" + EDGES[1], re.S)
        out.append(Rule(priority, label, max(keyword.split(), key=len).encode("latin-1"), pattern))
    return sorted(out, key=lambda r: r.priority)


class Scanner:
    """Detections in lower-cased UTF-8 texts."""

    def __init__(self):
        self.rules = rules()
        # every rule and phrase on "mit" has the word license too: the word alone is German
        self.keywords = sorted(({r.word for r in self.rules} | {b"gnu", b"apache", b"cc", b"licen"}) - {b"mit"})
        self.base = [(p.encode().split(), label) for p, label in BASE.items()]

    def gated(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        """The documents that contain any keyword."""
        hit = np.zeros(len(offs) - 1, bool)
        for key in self.keywords:
            at = raw.find(key)
            while at >= 0:
                doc = int(np.searchsorted(offs, at, "right")) - 1
                hit[doc] = True
                at = raw.find(key, max(at + 1, int(offs[doc + 1]) - len(key) + 1))
        return np.flatnonzero(hit)

    def detections(self, text: bytes) -> list[tuple[int, int, str, int]]:
        """(start byte, end byte, label, priority) after resolving overlaps, by start."""
        has = {w: w in text for w in {r.word for r in self.rules}}
        found = []
        for i, r in enumerate(self.rules):
            if has[r.word]:
                found += [(r.priority, m.start() - m.end(), i, m.start(), m.end(), r.label) for m in r.pattern.finditer(text)]
        kept: list[tuple[int, int, str, int]] = []  # disjoint, sorted by start
        for priority, _, _, a, b, label in sorted(found):
            k = bisect_left(kept, (b,))
            if k == 0 or kept[k - 1][1] <= a:
                kept.insert(k, (a, b, label, priority))
        return kept

    def places(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, number of words, label) of every place of a base phrase."""
        out = []
        for phrase, label in self.base:
            i = -1
            while True:
                try:
                    i = words.index(phrase[0], i + 1)
                except ValueError:
                    break
                if words[i : i + len(phrase)] == phrase:
                    out.append((i, len(phrase), label))
        return sorted(out)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first_word:long,last_word:long,label:string,priority:int>>"
_DETECTION = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
_scanner: list[Scanner] = []


def _scan(batches: Iterator[pa.RecordBatch]):
    if not _scanner:
        _scanner.append(Scanner())
    scanner = _scanner[0]
    for batch in batches:
        buf, offs = X.column(batch, "text")
        for a, b in X.slices(offs):
            low = X.LOWER[buf[offs[a] : offs[b]]]
            own = offs[a : b + 1] - offs[a]
            starts, ends, bounds = X.words(low, own, X.NAME)
            n_words = np.diff(bounds)
            rows = [(0, None, None, "", "", 0.0, [])] * (b - a)
            raw = low.tobytes()
            for d in scanner.gated(raw, own).tolist():
                x, y = bounds[d], bounds[d + 1]
                if x == y:
                    continue
                s, e = starts[x:y], ends[x:y]
                base = scanner.places([raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)])
                found = []
                for i, j, label, priority in scanner.detections(raw[own[d] : own[d + 1]]):
                    i, j = i + own[d], j + own[d]
                    found.append({"first_word": int(np.searchsorted(s, i)), "last_word": int(np.searchsorted(s, j)) - 1, "label": label, "priority": priority})
                cover = np.zeros(len(s), bool)
                for i, n, _ in base:
                    cover[i : i + n] = True
                for f in found:
                    cover[f["first_word"] : f["last_word"] + 1] = True
                own_labels = {label for _, _, label in base}
                every = own_labels | {f["label"] for f in found}
                rows[d] = (len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own_labels)), ",".join(sorted(every)), float(cover.mean()), found)
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _DETECTION)
            names = ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n_words, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", *names])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and labels of base phrases, all labels, the share of words covered, and the detections as word spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {SCHEMA}")


def brute_force(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels by testing each phrase at each word."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for i in range(len(w)) for p, label in BASE.items() if w[i : i + len(p.split())] == p.split()]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
