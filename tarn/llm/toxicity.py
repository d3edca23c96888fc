"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are contrasted with texts of unknown kind drawn from the
whole table. A linear model over the presence of hashed words and beginnings of
words minimises the
non-negative risk estimator of Kiryo et al. (2017),

    prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic)),

in numpy on the driver. ``prior`` is the share of toxic texts; where it is not
given, the share among labelled rows stands for it (``DEFAULT_PRIOR`` if all of
those are toxic). Copies of a text count once in learning.

Learning reads at most ``max_positive`` and ``max_unlabelled`` texts, chosen by a
hash of their id. Their words are counted in Spark, and the ``most`` significant
chosen there; what reaches the driver is those and, of each text, a bit for each of
them, sorted: neither the length of texts nor the order of rows matters. An id that
repeats is learned from once a label, by its text of the smallest hash. Scoring is a
pass of numpy over Arrow batches, without a shuffle.

Defined cases: null or empty text has no words and gets the model's base score;
labels that are null are no labels; without toxic examples the score is 0;
repeated rows are scored alike; other columns are not read.
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
from tarn.llm._store import cut

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 3_000, 8_000, 512
PREFIXES = (4, 5, 6, 7)
DEFAULT_PRIOR = 0.1
SIGNIFICANT, LIFT, LEAST = 5.0, 4.0, 3
U64 = np.uint64


def features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(32-bit hashes, documents) of all words, then of the first bytes of longer words, a pair for each of PREFIXES.

    Words are letters, digits and non-ASCII characters, A-Z lowered. Beginnings
    catch insults that take endings.
    """
    low = X.LOWER[buf]
    starts, ends, bounds = X.words(low, offs, X.NAME)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    yield (X.word_hashes(low, starts, ends) >> U64(32)).astype(np.uint32), doc
    acc, done = np.zeros(len(starts), U64), 0
    for k in PREFIXES:
        own = np.flatnonzero(ends - starts > k)
        starts, acc, doc, ends = starts[own], acc[own], doc[own], ends[own]
        while done < k:
            acc = X.mix(acc + low[starts + done] + U64(1 + done))
            done += 1
        yield (X.mix(acc, k) >> U64(32)).astype(np.uint32), doc


@dataclass(frozen=True)
class Model:
    """Score = sigmoid(bias + sum of weights of the words present). words: sorted hashes."""

    bias: float
    words: np.ndarray
    weights: np.ndarray

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = np.full(len(offs) - 1, self.bias)
        if len(self.words):
            table = np.zeros(1 << 16, bool)
            table[self.words >> np.uint32(16)] = True
            pairs = []
            for h, doc in features(buf, offs):
                maybe = np.flatnonzero(table[h >> np.uint32(16)])
                h, doc = h[maybe], doc[maybe]
                at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                same = self.words[at] == h
                pairs.append(doc[same] * len(self.words) + at[same])
            pair = np.unique(np.concatenate(pairs))
            np.add.at(z, pair // len(self.words), self.weights[pair % len(self.words)])
        return 1 / (1 + np.exp(-z))


def risk_gradient(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the non-negative risk by the scores of positives and of unlabelled, with the logistic loss.

    Where the negative part's estimate falls below zero, the step goes up on it
    instead of down, as Kiryo et al. have it.
    """
    sig = lambda z: 1 / (1 + np.exp(-z))
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    up_u, up_p = sig(z_u) / len(z_u), -prior * sig(z_p) / len(z_p)
    if negative < 0:
        return -up_p, -up_u
    return -prior * sig(-z_p) / len(z_p) + up_p, up_u


def fit(x_p: np.ndarray, x_u: np.ndarray, words: np.ndarray, prior: float, steps: int = 500, decay: float = 1e-4) -> Model:
    """x_p, x_u: which of the words (sorted hashes) each toxic and each unlabelled text has."""
    none = np.zeros(0, np.uint32)
    if not len(x_p) or not len(x_u):
        return Model(-50.0 if not len(x_p) else 0.0, none, np.zeros(0))
    if not len(words):
        return Model(float(np.log(prior / (1 - prior))), none, np.zeros(0))
    w, bias = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for i in range(1, steps + 1):
        w32 = w.astype(np.float32)
        g_p, g_u = risk_gradient(x_p @ w32 + bias, x_u @ w32 + bias, prior)
        g = np.append(g_p.astype(np.float32) @ x_p + g_u.astype(np.float32) @ x_u + decay * w, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), words, w)


def _words_of(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        buf, offs = X.column(batch, "text")
        for a, b in X.slices(offs):
            h, doc = map(np.concatenate, zip(*features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), strict=True))
            each = np.unique(doc.astype(U64) << U64(32) | h)
            bounds = np.searchsorted(each >> U64(32), np.arange(b - a + 1))
            words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(each.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "toxic", "text_hash")), words], ["doc_id", "toxic", "text_hash", "words"])


def _has(batches: Iterator[pa.RecordBatch], words: np.ndarray):
    for batch in batches:
        col = batch.column("words")
        at, values = np.asarray(col.offsets), np.asarray(col.values).view(np.uint32)
        place = np.minimum(np.searchsorted(words, values), len(words) - 1)
        hit = np.zeros((len(batch), len(words)), bool)
        own = np.flatnonzero(words[place] == values)
        row = np.searchsorted(at, own, "right") - 1
        inside = (row >= 0) & (row < len(batch))
        hit[row[inside], place[own[inside]]] = True
        bits = [x.tobytes() for x in np.packbits(hit, axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bits, pa.binary())], ["toxic", "bits"])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, most: int = MAX_FEATURES) -> Model:
    """Learns ``toxic`` from rows whose crc32(doc_id) is no multiple of five."""
    own = labels.where(F.col("toxic").isNotNull() & (_sample.remainder(5) != 0))
    if prior is None:
        n, k = own.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first()
        prior = DEFAULT_PRIOR if not n or not k or k == n else float(np.clip(k / n, 0.001, 0.9))
    positive = _sample.draw(own.where("toxic = 1").select("doc_id"), max_positive).withColumn("toxic", F.lit(1))
    unlabelled = _sample.draw(docs.where(_sample.remainder(5) != 0).select("doc_id"), max_unlabelled).withColumn("toxic", F.lit(0))
    drawn = positive.union(unlabelled)  # a toxic text may be drawn as unlabelled too, as the estimator assumes
    texts = _sample.texts_of(docs.select("doc_id", "text"), drawn)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_words_of, f"doc_id {kind}, toxic int, text_hash long, words array<int>")
    rows = cut(_sample.one_each(rows, ["doc_id", "toxic"], "words").select("toxic", "words").distinct())
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if not n_p or not n_u:
        return fit(np.zeros((n_p, 0)), np.zeros((n_u, 0)), np.zeros(0, np.uint32), prior)
    each = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u"))
    p, u = F.col("p") / n_p, (F.col("u") + 1) / (n_u + 2)
    z = (p - u) / F.sqrt(u * (1 - u) / n_p)
    top = each.where((F.col("p") >= LEAST) & (p > LIFT * u) & (z >= SIGNIFICANT)).orderBy(z.desc(), "word").limit(most)
    words = np.sort(np.array([r.word for r in top.collect()], np.int32).view(np.uint32))
    if not len(words):
        return fit(np.zeros((n_p, 0)), np.zeros((n_u, 0)), words, prior)
    got = sorted((r.toxic, bytes(r.bits)) for r in rows.mapInArrow(lambda it: _has(it, words), "toxic int, bits binary").collect())
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in got]), axis=1, count=len(words)).astype(np.float32)
    return fit(x[n_u:], x[:n_u], words, prior)


def _score(batches: Iterator[pa.RecordBatch], model: Model):
    for batch in batches:
        buf, offs = X.column(batch, "text")
        got = [model.scores(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in X.slices(offs)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(got) if got else np.zeros(0))], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``score``, the probability that the text is toxic."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _score(it, model), f"doc_id {kind}, score double")
