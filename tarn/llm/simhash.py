"""Near-duplicate documents by SimHash and pigeonhole blocks.

A document's fingerprint has a bit for each of the 64 bits of XXH64 (seed 42)
that is set in over half of its 3-word shingles. Two fingerprints that differ in
at most three bits agree on all but three of any ``b`` blocks, so they share
one of the C(b, 3) keys made of the other blocks. Distinct fingerprints are
dealt out by those keys and compared within a key only, in numpy, by Hamming
distance; a task returns a spanning star of what it links, never all pairs.

Keys with more than ``crowd`` fingerprints (dense groups of near copies) are not
compared as one group: their fingerprints go on to a finer split into more
blocks, which still loses no pair. With 16 blocks a key leaves 12 bits open, so
the last level's groups have 4,096 members at most.

Copies share a fingerprint and count once from the start. Components come from
star contraction in Spark; nothing of the corpus reaches the driver.

Three bits of 64 are next to identity: texts of Jaccard similarity 0.8 differ in some
ten. ``near_copies`` is the same operator for those, with blocks for that radius.

Defined cases: null or empty text has fingerprint zero and links like any other;
repeated rows and ids keep a row each; null doc_id gets its component's smallest
doc_id (null if there is none); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._components import components
from tarn.llm._store import cut
from tarn.llm.blocks import near_copies  # noqa: F401

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Blocks of each level, and the members of a key from which the next level takes over.
LEVELS, CROWD = (6, 8, 12, 16), 256
_ONES = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text's UTF-8 bytes."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    n = len(words)
    if n == 0:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _ONES
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        text = batch.column("text")
        got = [fingerprint(b.to_pybytes()) if (b := x.as_buffer()) is not None else 0 for x in text]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks to leave out, a mask of the others, as signed longs."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    out = [(1 << 64) - 1 - sum(x) for x in combinations(own, distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _links(batches, distance: int):
    """Of rows (k, fp) sorted by k: edges of a spanning star of each linked part of a key's fingerprints."""
    import pandas as pd

    def linked(k: np.ndarray, x: np.ndarray):
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(first, len(k)))
        pair = first[size == 2]
        a, b = x[pair], x[pair + 1]
        near = np.bitwise_count(a ^ b) <= distance
        us, vs = [a[near]], [b[near]]
        for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            y = np.unique(x[i : i + n])
            label = np.arange(len(y))
            near = [np.flatnonzero(np.bitwise_count(y ^ y[j]) <= distance) for j in range(len(y))]
            while True:
                new = np.array([label[z].min() for z in near])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            out = label != np.arange(len(y))
            us.append(y[out])
            vs.append(y[label[out]])
        return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    held_k, held_x = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for pdf in batches:
        k = np.concatenate((held_k, pdf["k"].to_numpy()))
        x = np.concatenate((held_x, pdf["fp"].to_numpy().view(np.uint64)))
        last = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
        if last:
            yield linked(k[:last], x[:last])
        held_k, held_x = k[last:], x[last:]
    if len(held_k):
        yield linked(held_k, held_x)


def edges(nodes: DataFrame, distance: int = DISTANCE, levels: tuple[int, ...] = LEVELS, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect just the fingerprints (column fp, distinct) which links connect."""
    spark, found, rest = nodes.sparkSession, None, nodes.select("fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for level, blocks in enumerate(levels):
        keys = rest.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(blocks, distance))))).alias("k"))
        sizes = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("k", "j")
        shared = cut(keys.join(sizes, F.col("k") == F.col("j")).select("k", "fp", "n"))
        last = level == len(levels) - 1
        small = shared if last else shared.where(F.col("n") <= crowd)
        got = small.select("k", "fp").repartition(n, "k").sortWithinPartitions("k").mapInPandas(lambda it: _links(it, distance), "u long, v long")
        found = got if found is None else found.union(got)
        rest = shared.where(F.col("n") > crowd).select("fp").distinct()
        if last or rest.isEmpty():
            return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id: the smallest doc_id that links reach, its own included."""
    marked = cut(fingerprints(docs))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(edges(nodes))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return marked.join(named, F.col("fp") == F.col("f"), "left").select("doc_id", "fp", "component_id")


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """doc_id -> (fingerprint in hex, component), comparing every pair of fingerprints."""
    fps = [bin_majority((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= DISTANCE) + i + 1:
            parent[find(int(j))] = find(i)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[r] = min(least.get(r := find(i), d), d)
    return {d: (f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)}


def bin_majority(text: bytes) -> int:
    """The fingerprint by counting bit after bit."""
    w = text.lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + SHINGLE]), SEED) for i in range(max(1, len(w) - SHINGLE + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
