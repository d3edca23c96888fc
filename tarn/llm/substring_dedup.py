"""Removal of word windows that occur more than once in a corpus.

A window is ``WINDOW`` consecutive words of one document. Every word covered by
a window whose word sequence also starts anywhere else is removed.

1. *Count-min prefilter.* Each window is represented by its anchor: of the
   ``ANCHOR``-word sequences inside the window, the one of smallest hash. Equal
   windows have equal anchors at equal places, so an anchor occurs at least as
   often as any of its windows, and a count-min sketch of anchor places
   overestimates window counts. Only one place in ten is an anchor, so the
   sketch stays small. Each task sketches its own rows; counters saturate at two
   and are added up by segment.
2. *Exact second pass.* Windows whose estimate reaches two are grouped by 96 bits
   of two rolling hashes. Both are made of the words' 64-bit hashes, so two windows
   are taken for equal if those agree word by word (words that collide in 64 bits
   would be mistaken for each other) or by a chance of 2**-96 a pair of windows.
   A task sends each distinct fingerprint of a flush once,
   with a mark if it occurs more than once there, so a window that a third of
   all rows share is one entry per flush and never a hot key.
3. Hits go back to the flush that sent them and from there to their documents.

What grows with the corpus is only shuffled. Up to 2**``max_bits`` cells a row, which
do for some 30 GB of text, the driver holds the merged sketch, as bits, and broadcasts
it. A larger sketch stays where it is merged, dealt out by ranges of cells: each flush
sends its cells there, is told which of them were met twice, and the anchors that pass
go to their documents in a join. The rows of the sketch grow with the corpus either
way, so the prefilter doesn't fill up. Groups of the second pass grow in number with
the corpus, so no task grows with it.

Defined cases: null or empty text has no words and loses none; texts shorter
than a window lose none; repeated rows, also of one doc_id, count as occurrences
of their own; null doc_id is kept as it is; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarn.llm import _store
from tarn.llm import _text as X

WINDOW, ANCHOR = 35, 18
ROWS = 4
SALT_ANCHOR, SALT_A, SALT_B = 101, 202, 303
FLUSH_ANCHORS, FLUSH_WINDOWS = 1 << 21, 1 << 21
U64 = np.uint64


def sketch_bits(n_bytes: int, least: int = 18) -> int:
    """log2 of a row's cells: about 2.5 per expected anchor (an anchor a 60 bytes)."""
    return int(max(least, np.ceil(np.log2(max(1, n_bytes) / 60 * 2.5))))


def segments(bits: int) -> int:
    """Parts of a row that are merged apart: 64 K cells each, four at least."""
    return 1 << max(2, bits - 16)


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (X.mix(anchors, 1000 + row) >> U64(64 - bits)).astype(np.uint32 if bits <= 32 else U64)


def _places(buf: np.ndarray, offs: np.ndarray, window: int, anchor: int):
    """Word hashes, document bounds in words, whether a window starts at each word, its anchor."""
    starts, ends, bounds = X.words(buf, offs)
    h = X.word_hashes(buf, starts, ends)
    n = len(h)
    if n < window:
        return h, bounds, np.zeros(0, bool), np.zeros(0, U64), np.zeros(0, U64)
    stop = np.repeat(bounds[1:], np.diff(bounds))
    m = n - window + 1
    valid = np.arange(window, n + 1) <= stop[:m]
    g = X.rolling(h, anchor, SALT_ANCHOR) | U64(1)
    return h, bounds, valid, X.sliding_min(g, window - anchor + 1)[:m], g


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int):
    """Of each slice of a batch: (batch, first row, last, its anchors' hashes, their places in words, document bounds in words)."""
    width = window - anchor + 1
    for batch in batches:
        buf, offs = X.column(batch, "text")
        for a, b in X.slices(offs):
            _, bounds, valid, least, g = _places(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], window, anchor)
            if not valid.any():
                continue
            top = np.zeros(len(g) + width - 1, U64)  # top[p + width - 1 - j]: window p - j
            top[width - 1 : width - 1 + len(valid)] = np.where(valid, least, U64(0))
            chosen = np.flatnonzero(X.sliding_max(top, width)[: len(g)] == g)
            yield batch, a, b, g[chosen], chosen, bounds


def _dealt(items: np.ndarray, row: int, bits: int, n_seg: int):
    """(segment, cells within it, which of those occur more than once) of a row of the sketch, by segment."""
    seg_bits = bits - (n_seg.bit_length() - 1)
    c = np.sort(_cells(items, row, bits))
    first = np.ones(len(c), bool)
    first[1:] = c[1:] != c[:-1]
    again = np.zeros(len(c), bool)
    again[:-1] = ~first[1:]
    u, dup = c[first], again[first]
    number = u.dtype.type
    at = np.searchsorted(u >> number(seg_bits), np.arange(n_seg + 1, dtype=number))
    low = (u & number((1 << seg_bits) - 1)).astype(np.uint16 if seg_bits <= 16 else np.uint32)
    for s in np.flatnonzero(np.diff(at)):
        i, j = at[s], at[s + 1]
        yield row * n_seg + int(s), low[i:j], dup[i:j]


def _sketch(batches: Iterator[pa.RecordBatch], window: int, anchor: int, bits: int):
    held, count = [], 0

    def flush():
        items = np.concatenate(held)
        held.clear()
        rows = [(s, low.tobytes(), low[dup].tobytes()) for row in range(ROWS) for s, low, dup in _dealt(items, row, bits, segments(bits))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["seg", "ones", "twos"])

    for _, _, _, own, _, _ in _anchors(batches, window, anchor):
        held.append(own)
        count += len(own)
        if count >= FLUSH_ANCHORS:
            yield flush()
            count = 0
    if held:
        yield flush()


def ranges(bits: int) -> int:
    """Parts of a row that stay apart: up to 64 M cells each, four at least."""
    return 1 << max(2, bits - 26)


def _asking(batches: Iterator[pa.RecordBatch], window: int, anchor: int, bits: int):
    """Rows (seg, flush, kind, a, b). kind 0: cells for a range, and which of them the flush has twice. kind 1: the flush's own documents and anchors."""
    task, flushes, n_seg = TaskContext.get().partitionId(), 0, ranges(bits)
    docs, hashes, counts, held, size = [], [], [], [], 0

    def flush():
        nonlocal flushes
        me = (task << 32) + flushes
        flushes += 1
        items = np.concatenate(held)
        rows = [(s, me, 0, low.astype(np.uint32).tobytes(), np.packbits(dup, bitorder="little").tobytes()) for row in range(ROWS) for s, low, dup in _dealt(items, row, bits, n_seg)]
        every = ROWS * n_seg
        rows.append((every + (me * 2654435761 >> 8) % every, me, 1, _directory(docs, hashes, counts), items.tobytes()))
        for x in (docs, hashes, counts, held):
            x.clear()
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["seg", "flush", "kind", "a", "b"])

    for batch, a, _, own, place, bounds in _anchors(batches, window, anchor):
        here, n = np.unique(np.searchsorted(bounds, place, "right") - 1, return_counts=True)
        docs.append(batch.column("d").take(pa.array(here + a)))
        hashes.append(batch.column("t").to_numpy(zero_copy_only=False)[here + a])
        counts.append(n)
        held.append(own)
        size += len(own)
        if size >= FLUSH_ANCHORS:
            yield flush()
            size = 0
    if size:
        yield flush()


def _directory(docs: list, hashes: list, counts: list) -> bytes:
    """Documents of a flush, with how many entries each has."""
    dirs = pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(counts))], ["d", "t", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, dirs.schema) as out:
        out.write_batch(dirs)
    return sink.getvalue().to_pybytes()


def _answers(key, pdf, bits: int):
    """Of one range: to each flush, which of its cells were met twice or more."""
    import pandas as pd

    rows = list(pdf[pdf["kind"] == 1][["flush", "kind", "seg", "a", "b"]].itertuples(index=False, name=None))
    got = pdf[pdf["kind"] == 0]
    if len(got):
        total = np.zeros((1 << bits) // ranges(bits), np.uint8)
        cells = [np.frombuffer(a, np.uint32) for a in got["a"]]
        for c, b in zip(cells, got["b"], strict=True):
            n = 1 + np.unpackbits(np.frombuffer(b, np.uint8), count=len(c), bitorder="little")
            total[c] = np.minimum(2, total[c] + n)
        rows += [(f, 0, key[0], np.packbits(total[c] >= 2, bitorder="little").tobytes(), b"") for f, c in zip(got["flush"], cells, strict=True)]
    return pd.DataFrame(rows, columns=["flush", "kind", "seg", "a", "b"])


def _passing(pdf, bits: int):
    """Of one flush: per document, its anchors whose cells were all met twice."""
    import pandas as pd

    own = pdf[pdf["kind"] == 1].iloc[0]
    items = np.frombuffer(own["b"], U64)
    said = dict(pdf[pdf["kind"] == 0][["seg", "a"]].itertuples(index=False, name=None))
    n_seg, hit = ranges(bits), np.ones(len(items), bool)
    seg_bits = bits - (n_seg.bit_length() - 1)
    for row in range(ROWS):
        cells, twice = [], []
        for s, low, _ in _dealt(items, row, bits, n_seg):
            cells.append((U64(s - row * n_seg) << U64(seg_bits)) | low.astype(U64))
            twice.append(np.unpackbits(np.frombuffer(said[s], np.uint8), count=len(low), bitorder="little"))
        hit &= np.concatenate(twice)[np.searchsorted(np.concatenate(cells), _cells(items, row, bits).astype(U64))] == 1
    with pa.ipc.open_stream(own["a"]) as got:
        dirs = got.read_all()
    ends = np.cumsum(dirs["n"].to_numpy())
    rows = [(d, t, np.unique(items[i:j][hit[i:j]]).tobytes()) for d, t, i, j in zip(dirs["d"].to_pylist(), dirs["t"].to_pylist(), ends - dirs["n"].to_numpy(), ends, strict=True) if hit[i:j].any()]
    return pd.DataFrame(rows, columns=["d", "t", "hot"])


def repeated_anchors(rows: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    """(d, t, hot): of each document of rows (d, t, text) the anchors that the sketch estimates to occur twice; the sketch stays distributed."""
    kind = rows.schema["d"].dataType.simpleString()
    asked = rows.mapInArrow(lambda it: _asking(it, window, anchor, bits), "seg int, flush long, kind int, a binary, b binary")
    told = asked.groupBy("seg").applyInPandas(lambda key, pdf: _answers(key, pdf, bits), "flush long, kind int, seg int, a binary, b binary")
    hot = told.groupBy("flush").applyInPandas(lambda pdf: _passing(pdf, bits), f"d {kind}, t long, hot binary")
    return hot.groupBy("d", "t").agg(F.max("hot").alias("hot"))  # rows alike in id and text have the same


def _merge(key, pdf, bits: int, part: bool = False):
    """Counts of a segment's cells, saturated at two: as bits, or (``part``) in the form of the sketches."""
    import pandas as pd

    seg_bits = bits - (segments(bits).bit_length() - 1)
    kind = np.uint16 if seg_bits <= 16 else np.uint32
    total = np.zeros(1 << seg_bits, np.uint8)
    for ones, twos in zip(pdf["ones"], pdf["twos"], strict=True):
        i, j = np.frombuffer(ones, kind), np.frombuffer(twos, kind)
        total[i] += total[i] < 2
        total[j] = 2
    if part:
        return pd.DataFrame({"seg": [key[0]], "ones": [np.flatnonzero(total).astype(kind).tobytes()], "twos": [np.flatnonzero(total == 2).astype(kind).tobytes()]})
    return pd.DataFrame({"seg": [key[0]], "bits": [np.packbits(total >= 2, bitorder="little").tobytes()]})


def repeated_bits(docs: DataFrame, window: int, anchor: int, bits: int, shares: int = 1) -> np.ndarray:
    """ROWS x 2**bits bits: whether the merged count of a cell is two or more. A few MB, whatever the corpus.

    ``shares``: into how many parts the flushes of a segment are dealt before those are merged.
    """
    parts = docs.select("text").mapInArrow(lambda it: _sketch(it, window, anchor, bits), "seg int, ones binary, twos binary")
    if shares > 1:
        some = parts.groupBy("seg", F.pmod(F.xxhash64("ones", "twos"), F.lit(shares)).alias("share"))
        parts = some.applyInPandas(lambda key, pdf: _merge(key, pdf, bits, True), "seg int, ones binary, twos binary")
    merged = parts.groupBy("seg").applyInPandas(lambda key, pdf: _merge(key, pdf, bits), "seg int, bits binary")
    out = np.zeros((ROWS * segments(bits), (1 << bits) // segments(bits) // 8), np.uint8)
    for seg, data in merged.collect():
        out[seg] = np.frombuffer(data, np.uint8)
    return out.reshape(ROWS, -1)


def _candidates(batches: Iterator[pa.RecordBatch], window: int, anchor: int, bits: int, plane: np.ndarray | None, parts: int):
    """Without a plane, the anchors that pass are in the column ``hot``.

    Rows (r, flush, kind, a, b, w). kind 0: fingerprints for group r. kind 1: a flush's own directory."""
    task, flushes = TaskContext.get().partitionId(), 0
    names = ["r", "flush", "kind", "a", "b", "w"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    ha, hb, docs, hashes, counts, place = [], [], [], [], [], []
    size = 0

    def flush():
        nonlocal flushes
        me = (task << 32) + flushes
        flushes += 1
        a, b = np.concatenate(ha), np.concatenate(hb)
        n = len(a)
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        first = np.ones(n, bool)
        first[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        run = np.cumsum(first) - 1
        many = (np.bincount(run) > 1)[run]
        keep = np.sort(order[first])
        known = np.zeros(n, bool)
        known[order[many]] = True
        r = ((a[keep] >> U64(40)) % U64(parts)).astype(np.int64)
        by = np.argsort(r, kind="stable")
        at = np.searchsorted(r[by], np.arange(parts + 1))
        keep = keep[by]
        # w: the place in this flush, the lowest bit set if it occurs here more than once
        w = (keep.astype(np.uint32) << np.uint32(1)) | known[keep].astype(np.uint32)
        ka, kb = a[keep], b[keep].astype(np.uint32)
        rows = [(int(p), me, 0, ka[i:j].tobytes(), kb[i:j].tobytes(), np.diff(w[i:j], prepend=np.uint32(0)).tobytes()) for p, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
        rows.append((parts + (me * 2654435761 >> 8) % parts, me, 1, _directory(docs, hashes, counts), np.concatenate(place).astype(np.uint32).tobytes(), np.packbits(known, bitorder="little").tobytes()))
        for x in (ha, hb, docs, hashes, counts, place):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        buf, offs = X.column(batch, "text")
        ids, th = batch.column("d"), batch.column("t").to_numpy(zero_copy_only=False)
        for x, y in X.slices(offs):
            h, bounds, valid, least, _ = _places(buf[offs[x] : offs[y]], offs[x : y + 1] - offs[x], window, anchor)
            if not valid.any():
                continue
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            heads = least[new]
            hit = np.ones(len(heads), bool)
            if plane is None:  # a flush's anchors are estimated for all its documents
                hot = np.unique(np.frombuffer(b"".join(v.as_buffer() for v in batch.column("hot").slice(x, y - x)), U64))
                hit = hot[np.minimum(np.searchsorted(hot, heads), len(hot) - 1)] == heads
            for row in range(ROWS if plane is not None else 0):
                c = _cells(heads, row, bits)
                hit &= (plane[row][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(valid & hit[np.cumsum(new) - 1])
            if not len(at):
                continue
            doc = np.searchsorted(bounds, at, "right") - 1
            here, n = np.unique(doc, return_counts=True)
            ha.append(X.rolling(h, window, SALT_A)[at])
            hb.append(X.rolling(h, window, SALT_B)[at] & U64(0xFFFFFFFF))
            docs.append(ids.take(pa.array(here + x)))
            hashes.append(th[here + x])
            counts.append(n)
            place.append(at - bounds[doc])
            size += len(at)
            if size >= FLUSH_WINDOWS:
                yield flush()
                size = 0
    if size:
        yield flush()


def _exact(pdf):
    """Of one group of fingerprints: the places, by flush, of those that occur more than once."""
    import pandas as pd

    own = pdf[pdf["kind"] == 1]
    out = [own[["flush", "kind", "a", "b", "w"]]]
    got = pdf[pdf["kind"] == 0]
    if len(got):
        a = np.concatenate([np.frombuffer(x, U64) for x in got["a"]])
        b = np.concatenate([np.frombuffer(x, np.uint32) for x in got["b"]])
        w = np.concatenate([np.cumsum(np.frombuffer(x, np.uint32), dtype=np.uint32) for x in got["w"]])
        n = np.array([len(x) // 4 for x in got["w"]])
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        run = np.cumsum(first) - 1
        hit = np.zeros(len(a), bool)
        hit[order] = (np.bincount(run) > 1)[run]
        hit &= w & np.uint32(1) == 0  # the others are known to their flush
        ends = np.cumsum(n)
        rows = []
        for flush, i, j in zip(got["flush"], ends - n, ends, strict=True):
            if (x := w[i:j][hit[i:j]] >> np.uint32(1)).size:
                rows.append((flush, 0, b"", b"", np.diff(x, prepend=np.uint32(0)).tobytes()))
        out.append(pd.DataFrame(rows, columns=["flush", "kind", "a", "b", "w"]))
    return pd.concat(out)


def _returned(pdf):
    """Of one flush: per document, the starts of its repeated windows."""
    import pandas as pd

    own = pdf[pdf["kind"] == 1].iloc[0]
    with pa.ipc.open_stream(own["a"]) as got:
        dirs = got.read_all()
    place = np.frombuffer(own["b"], np.uint32)
    known = np.unpackbits(np.frombuffer(own["w"], np.uint8), count=len(place), bitorder="little").astype(bool)
    for x in pdf[pdf["kind"] == 0]["w"]:
        known[np.cumsum(np.frombuffer(x, np.uint32))] = True
    ends = np.cumsum(dirs["n"].to_numpy())
    rows = []
    for d, t, i, j in zip(dirs["d"].to_pylist(), dirs["t"].to_pylist(), ends - dirs["n"].to_numpy(), ends, strict=True):
        if known[i:j].any():
            rows.append((d, t, place[i:j][known[i:j]].tobytes()))
    return pd.DataFrame(rows, columns=["d", "t", "starts"])


def _apply(batches: Iterator[pa.RecordBatch], window: int, as_is: bool):
    for batch in batches:
        texts, starts = batch.column("text"), batch.column("starts")
        total, gone, kept = [], [], []
        for i in range(len(batch)):
            s = texts[i].as_buffer()
            raw = None if s is None else s.to_pybytes()
            words = (raw or b"").split()
            lost = 0
            if starts[i].is_valid:
                cover = np.zeros(len(words) + 1, np.int32)
                at = np.frombuffer(starts[i].as_buffer(), np.uint32)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                stay = np.cumsum(cover[:-1]) == 0
                lost = int(len(words) - stay.sum())
                words = [words[k] for k in np.flatnonzero(stay)]
            total.append(len(words) + lost)
            gone.append(lost)
            kept.append(raw if as_is and not lost else b" ".join(words))
        kept = pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), kept.cast(pa.string()), *(batch.column(c) for c in batch.schema.names if c.startswith("c__"))], ["doc_id", "n_words", "n_removed", "kept_text", *(c for c in batch.schema.names if c.startswith("c__"))])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_bits: int = 28, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), then ``carry``'d columns as they are.

    ``as_is``: kept_text is the text itself (null for null) where nothing is removed.
    docs: doc_id and text, read four times; it should be a table or a file.
    ``max_bits``: log2 of the cells a row up to which the sketch is broadcast.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", *(F.col(c).alias(f"c__{c}") for c in carry))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(n_bytes)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = int(max(4 * shuffle, n_bytes >> 23, 16))
    # a document is known by its id and a hash of its text, so repeated ids do no harm
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    plane = None
    if bits <= max_bits:
        plane = spark.sparkContext.broadcast(repeated_bits(docs, window, anchor, bits, 1 + (n_bytes >> 35)))
    else:
        hot = repeated_anchors(rows, window, anchor, bits).withColumnsRenamed({"d": "e", "t": "u"})
        rows = rows.join(hot, F.col("d").eqNullSafe(F.col("e")) & (F.col("t") == F.col("u"))).drop("e", "u")
    sent = rows.mapInArrow(lambda it: _candidates(it, window, anchor, bits, plane and plane.value, parts), "r int, flush long, kind int, a binary, b binary, w binary")
    hits = sent.groupBy("r").applyInPandas(_exact, "flush long, kind int, a binary, b binary, w binary")
    spans = hits.groupBy("flush").applyInPandas(_returned, f"d {kind}, t long, starts binary")
    # rows alike in id and text all have the same starts
    spans = spans.groupBy("d", "t").agg(F.max("starts").alias("starts"))
    joined = keyed.withColumn("t", F.xxhash64("text")).join(spans.withColumnRenamed("t", "u"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left").drop("d", "t", "u")
    kept = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    for c in carry:
        kept.add(f"c__{c}", docs.schema[c].dataType)
    out = joined.mapInArrow(lambda it: _apply(it, window, as_is), kept)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *(F.col(f"c__{c}").alias(c) for c in carry))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed and kept text's SHA-256 of each text, by counting every window."""
    seen: dict[tuple, int] = {}
    split = [(t or "").encode().split() for t in texts]
    for w in split:
        for i in range(len(w) - window + 1):
            seen[k] = seen.get(k := tuple(w[i : i + window]), 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
