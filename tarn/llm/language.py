"""Language identification by a byte convolutional network, in numpy.

A text's UTF-8 bytes (A-Z lowered) are cut into windows of ``WINDOW`` bytes. Over
each window run filters of several widths; each filter's largest response goes to
a softmax layer. Over bytes a filter is a table with a weight per offset and
byte, so a response is a sum of table rows, and the same code serves learning,
where gradients only reach the largest responses. A text's probabilities are the
mean of its windows', by bytes; every window of every text counts.

Learning reads at most ``max_rows`` labelled texts, chosen by a hash of their id,
and from each at most ``windows`` of all its windows, chosen by a hash of the text;
those reach the driver, which sorts them. An id that repeats is learned from once a
language. Scoring is a pass over Arrow batches without a shuffle.

Defined cases: null text and text without a letter are ``und`` with score 0;
texts whose lang is null are not learned from; with nothing to learn from all is
``und``; repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _sample
from tarn.llm import _text as X

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
MAX_ROWS, WINDOWS = 6_000, 2
CHUNK = 64  # windows whose responses are held at once


@dataclass
class Network:
    """tables[j]: weights of offset j, 256 x filters; filters of a width below j + 1 have none there."""

    languages: list[str]
    tables: list[np.ndarray]
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Of each place and filter: windows x places x filters."""
        places = windows.shape[1] - len(self.tables) + 1
        wide = self.tables[0].shape[1]
        out = self.tables[0][windows[:, :places]]
        for j, t in enumerate(self.tables[1:], 1):
            skip = wide - t.shape[1]
            out[:, :, skip:] += t[windows[:, j : j + places]]
        return out

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of each filter, rectified."""
        parts = [self.responses(windows[i : i + CHUNK]).max(1) for i in range(0, len(windows), CHUNK)]
        top = np.concatenate(parts) if parts else np.zeros((0, self.tables[0].shape[1]), np.float32)
        return np.maximum(top + self.shift, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.dense + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (bytes, zeros after a text's end), the text of each, and its own bytes."""
    n = np.diff(offs)
    per = -(-n // WINDOW)
    doc = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(WINDOW, n[doc] - nth * WINDOW)
    out = np.zeros(len(doc) * WINDOW, np.uint8)
    first = np.cumsum(per * WINDOW) - per * WINDOW
    out[np.arange(len(buf)) + np.repeat(first - offs[:-1], n)] = X.LOWER[buf]
    return out.reshape(-1, WINDOW), doc, size


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the cross-entropy; half of the windows of a batch are cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    wide = FILTERS * len(WIDTHS)
    tables = []
    for j in range(max(WIDTHS)):
        own = FILTERS * sum(w > j for w in WIDTHS)
        tables.append(rng.normal(0, 0.3, (256, own)).astype(np.float32))
    net = Network(languages, tables, np.zeros(wide, np.float32), rng.normal(0, 0.1, (wide, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.tables, net.shift, net.dense, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    filters = np.arange(wide)
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        speed = rate * (1 - epoch / epochs) + 1e-4
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            x = windows[own].copy()
            short = rng.integers(8, WINDOW, len(own))
            x[(np.arange(WINDOW) >= short[:, None]) & (np.arange(len(own)) % 2 == 0)[:, None]] = 0
            r = net.responses(x)
            at = r.argmax(1)
            top = np.take_along_axis(r, at[:, None], 1)[:, 0] + net.shift
            h = np.maximum(top, 0)
            g = softmax(h @ net.dense + net.bias)
            g[np.arange(len(own)), labels[own]] -= 1
            g /= len(own)
            grads = [np.zeros_like(t) for t in net.tables]
            back = (g @ net.dense.T) * (top > 0)
            for j, t in enumerate(grads):
                skip = wide - t.shape[1]
                seen = np.take_along_axis(x, at[:, skip:] + j, 1)
                np.add.at(t, (seen, np.broadcast_to(filters[skip:] - skip, seen.shape)), back[:, skip:])
            grads += [back.sum(0), h.T @ g, g.sum(0)]
            step += 1
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, max_rows: int = MAX_ROWS, windows: int = WINDOWS) -> Network | None:
    """Learns from text and lang of rows whose crc32(doc_id) modulo four is not two."""
    own = docs.where(F.col("lang").isNotNull() & (_sample.remainder(4) != 2)).select("doc_id", F.col("lang").alias("known"))
    met = _sample.texts_of(docs.select("doc_id", "text"), _sample.draw(own, max_rows)).where("octet_length(text) > 0")
    # of all windows of the whole text, those that its hash names
    raw, count = "encode(text, 'UTF-8')", f"ceil(octet_length(text) / {WINDOW})"
    parts = f"transform(array_distinct(transform(sequence(1, {windows}), j -> pmod(xxhash64(text_hash, j), {count}))), w -> substring({raw}, cast(w * {WINDOW} + 1 as int), {WINDOW}))"
    rows = _sample.one_each(met.withColumn("parts", F.expr(parts)), ["doc_id", "known"], "parts").select("known", "parts").collect()
    got = sorted({(r.known, bytes(t)) for r in rows for t in r.parts})
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    data = np.zeros((len(got), WINDOW), np.uint8)
    for i, (_, t) in enumerate(got):
        data[i, : len(t)] = np.frombuffer(t, np.uint8)
    return fit(X.LOWER[data], np.array([languages.index(lang) for lang, _ in got]), languages)


def _predict(batches: Iterator[pa.RecordBatch], net: Network):
    names = np.array(net.languages)
    for batch in batches:
        buf, offs = X.column(batch, "text")
        for a, b in X.slices(offs):
            windows, doc, size = windows_of(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            p = net.probabilities(windows) * size[:, None]
            total = np.stack([np.bincount(doc, p[:, c], minlength=b - a) for c in range(p.shape[1])], 1)
            total /= np.maximum(offs[a + 1 : b + 1] - offs[a:b], 1)[:, None]
            best = total.argmax(1)
            score = np.clip(total[np.arange(b - a), best], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "lettered")), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lettered", "lang", "p"])


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(lambda it: _predict(it, net), f"doc_id {kind}, lettered boolean, lang string, p double")
    return out.select("doc_id", F.when(F.col("lettered"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("p")).otherwise(0.0).alias("score"))
