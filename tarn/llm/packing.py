"""Packing of tokenized documents into fixed-length sequences by minimum bin slack.

1. Documents are tokenized where they lie: words go through a bounded per-worker
   cache to the tokenizer's own model, and texts beyond plain Latin-1 through the
   whole tokenizer. Documents longer than a sequence are cut into pieces.
2. Pieces are interchangeable but for their length, so only the histogram of
   lengths (a row per length, at most ``capacity``) reaches the driver. There,
   for one bin at a time, the largest length left is set and a bitset subset-sum
   over the lengths left finds the fullest completion. The combination found is
   taken as often as the lengths allow, so the work does not grow with the rows.
3. Each piece's rank among pieces of its length - counts per task before it plus
   its place in the task - looks up its sequence and offset in that plan.

Defined cases: null or empty text is the end token alone; repeated rows and ids
are packed like others; null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._store import cut

CAPACITY, END = 4096, 1
CACHE_WORDS = 300_000
BATCH_ROWS = 2048


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Token ids, as little-endian 32-bit bytes, just as the whole tokenizer gives them.

    The word path is for tokenizers that lower-case, split at white space and then
    into letter runs, single numerals and other runs, as word_bpe_49k does. It
    takes texts whose characters it knows to be handled alike; any other goes
    through the tokenizer itself.
    """

    _KNOWN = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])
    _LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
    _PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r{_LETTERS}{_NUMBERS}]+")

    class _Words(dict):
        def __init__(self, make):
            self.make = make

        def __missing__(self, word: str) -> bytes:
            got = self.make(word)
            if len(self) < CACHE_WORDS:
                self[word] = got
            return got

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letter = _byte_letters()
        self.words = self._Words(self._word)  # and their pieces, which are words too

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()):
            piece = "".join([self.letter[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isalpha()):
            pieces = self._PIECES.findall(word)
            if pieces != [word]:
                return b"".join([self.words[p] for p in pieces])
        return self._piece(word)

    def ids(self, text: str) -> bytes:
        try:
            plain = "<|" not in text and not text.encode("latin-1").translate(None, self._KNOWN)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int):
    enc, task = encoder(path), TaskContext.get().partitionId()
    before = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
    tail = end.to_bytes(4, "little")
    names = ["piece", "start", "length", "ids_crc32", "task", "rank"]
    for batch in batches:
        for a in range(0, len(batch), BATCH_ROWS):
            part = batch.slice(a, BATCH_ROWS)
            row, cols = [], [[] for _ in names]
            for i, text in enumerate(part.column("text").to_pylist()):
                raw = enc.ids(text or "") + tail
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    n = len(own) // 4
                    row.append(i)
                    for c, v in zip(cols, (k, at // 4, n, zlib.crc32(own), task, before[n]), strict=True):
                        c.append(v)
                    before[n] += 1
            ids = part.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", *names])


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies to take of each length for the largest sum of at most ``room``: a bitset subset-sum.

    Bit s of the set says that sum s can be made. Larger lengths come first, so
    that the small ones are kept for the bins to come.
    """
    mask = (1 << (room + 1)) - 1
    can, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            new = (can | can << (part * length)) & mask
            if new != can:
                steps.append((can, length, part))
                can = new
                if can >> room & 1:
                    break
            left -= part
            part *= 2
        if can >> room & 1:
            break
    total, take = can.bit_length() - 1, {}
    for was, length, part in reversed(steps):
        if not was >> total & 1:
            take[length] = take.get(length, 0) + part
            total -= part * length
    return take


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many, copies of each length in one), every counted piece in one of them."""
    counts = {n: c for n, c in counts.items() if c}
    bins = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        take = fullest(counts, capacity - largest)
        counts[largest] += 1
        take[largest] = take.get(largest, 0) + 1
        times = min(counts[n] // m for n, m in take.items())
        bins.append((times, take))
        for n, m in take.items():
            counts[n] -= times * m
            if not counts[n]:
                del counts[n]
    return bins


def _plan(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset of the first), by length and rank."""
    rows, used, sequence = [], {}, 0
    for times, take in bins:
        offset = 0
        for n in sorted(take, reverse=True):
            rows.append((n, used.get(n, 0), sequence, take[n], offset))
            used[n] = used.get(n, 0) + times * take[n]
            offset += n * take[n]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(batches: Iterator[pa.RecordBatch], plan: np.ndarray):
    key = (plan[:, 0] << 48) | plan[:, 1]
    for batch in batches:
        n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        p = plan[np.searchsorted(key, (n << 48) | rank, "right") - 1] if len(n) else plan[:0]
        nth = rank - p[:, 1]
        out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        out |= {"sequence_id": pa.array(p[:, 2] + nth // p[:, 3]), "offset": pa.array(p[:, 4] + nth % p[:, 3] * n)}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end), f"{schema}, task long, rank long"))
    each = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    plan = spark.sparkContext.broadcast(_plan(minimum_bin_slack(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select(F.col("length").alias("l"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.drop("l", "t", "task", "base").mapInArrow(lambda it: _placed(it, plan.value), f"{schema}, sequence_id long, offset long")
