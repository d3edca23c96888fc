"""Near copies by SimHash at Jaccard similarity: the pigeonhole blocks of ``simhash`` for wider radii.

Two texts are near copies if their sets of ``SHINGLE``-word shingles have a Jaccard
similarity of ``SHARE`` or more. At 0.8 some 15 % of a SimHash's bits differ, too many
for blocks of bits, so here the fingerprint is split by what it is made of: each
shingle belongs to one of b blocks by its hash, and a block's value is the SimHash of
its own shingles. Pigeonhole: k changed shingles touch at most k blocks, the others
are equal. Texts that share a block are joined on it, then verified by the Hamming
distance of the 256-bit SimHash of the whole text, then by their exact sets.

b grows with the number of distinct shingles, as LEVELS says and then with each
doubling, so that blocks stay as large; of those beyond the first 32 are not needed
(whole texts are verified all the same). Blocks of one or two shingles of a longer text
are left out: boilerplate has such. A text is blocked at each level that a text of
similar size can have. A pair of exactly 0.8 shares no block with a chance of about 2 in
10,000 at the worst size of each level; pairs above it have less. RADIUS is five standard deviations above the
mean distance of such a pair.

Verification makes no pairs of all texts of a block. First each is compared with the
centre of its block, the text whose blocks most others hold: that is what near copies
were made from, if it is there. Texts linked to the same centre are of one part. Blocks
that then still hold several parts (one of those with the same texts) are compared as a
whole, in numpy: texts of different parts that Hamming distance lets pass, by a product
of matrices of their sets. Blocks of more than ``CROWD`` texts are cut into segments, two
of which meet in a task, but for two of a block's largest part: if that has nearly
all of the block, the work stays in proportion to it. Only links leave a task, as
spanning stars.

Exact copies count once from the start. Components come from star contraction; nothing
of the corpus reaches the driver.

Defined cases: words and case as in ``simhash``; a text of fewer than five words is one
shingle; null and wordless texts are alike; repeated rows and ids keep a row each; null
doc_id gets its component's smallest (null sorts first within a struct id); other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _text
from tarn.llm._components import components
from tarn.llm._store import cut

SHINGLE, SHARE = 5, 0.8
#: (most distinct shingles, blocks): e**(-2 (1 - s) / (1 + s) n / b) is a block's chance to be equal, and b of those must leave 1e-4.
LEVELS = ((59, 16), (190, 32))
LEAST = 3  # shingles of a block, but for the first level
WORDS, RADIUS = 4, 80  # 64-bit words of the fingerprint; 0.19 * 256 + 5 * sqrt(256 * 0.19 * 0.81): small sets differ in up to 19 %
SLICE = 1 << 19
CROWD, WIDTH = 1024, 8192  # texts that meet in a task at most twice as many; columns of their matrix that are multiplied at a time
U64 = np.uint64


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts): the distinct shingles of each text, sorted within it."""
    buf = _text.LOWER[buf]
    starts, ends, first = _text.words(buf, offs)
    h = _text.word_hashes(buf, starts, ends)
    n = np.diff(first)
    x = h.copy()
    for k in range(1, SHINGLE):
        x[:-k] = _text.mix(x[:-k] * U64(0x9E3779B97F4A7C15) + h[k:], k)
    doc = np.repeat(np.arange(len(n)), n)
    last = first[doc + 1] - np.arange(len(h)) >= SHINGLE  # a whole shingle begins here
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = np.array([xxhash.xxh64_intdigest(h[first[i] : first[i + 1]].tobytes(), 42) for i in short.tolist()], U64)
    x, doc = np.concatenate((x[last], whole)), np.concatenate((doc[last], short))
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[new], doc[new]


def majorities(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes that begins at ``at``, in 64-bit words."""
    if not len(at):
        return np.zeros(0, U64)
    size = np.diff(np.append(at, len(x)))
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view(U64).ravel()


def _level(n: np.ndarray) -> np.ndarray:
    """The index in LEVELS of a size; beyond the last one more for each doubling."""
    most = np.array([m for m, _ in LEVELS])
    return np.searchsorted(most, n) + np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / most[-1])) - 1).astype(np.int64)


def keys(x: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, texts) of all blocks of all levels of each text, sorted by text."""
    n = np.bincount(doc, minlength=n_docs)
    slack = SHARE**-0.5
    low, high = _level(n / slack), _level(n * slack)
    out_k, out_d = [], []
    for level in range(int(high.max(initial=0)) + 1):
        own = (low <= level) & (level <= high) & (n > 0)
        if not own.any():
            continue
        used = LEVELS[min(level, len(LEVELS) - 1)][1]
        blocks = used << max(0, level - len(LEVELS) + 1)
        block = (_text.mix(x, 55) >> U64(20)) & U64(blocks - 1)
        take = np.flatnonzero(own[doc] & (block < used))
        run = doc[take] * used + block[take].astype(np.int64)
        order = np.argsort(run, kind="stable")
        take, run = take[order], run[order]
        at = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else run
        got = majorities(x[take], at)
        if level:
            full = np.diff(np.append(at, len(take))) >= LEAST
            at, got = at[full], got[full]
        out_k.append(_text.mix(_text.mix(got, level + 1) + block[take[at]], 77))
        out_d.append(doc[take[at]])
    wordless = np.flatnonzero(n == 0)
    k = np.concatenate([*out_k, np.zeros(len(wordless), U64)])
    d = np.concatenate([*out_d, wordless])
    order = np.argsort(d, kind="stable")
    return k[order], d[order]


def fingerprints(x: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """A row of WORDS words for each text: the SimHash of its set; zeros without words."""
    out = np.zeros((n_docs, WORDS), U64)
    if len(x):
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for w in range(WORDS):
            out[doc[at], w] = majorities(_text.mix(x, 900 + w), at)
    return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def _marked(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        buf, offs = _text.column(batch, "text")
        for a, b in _text.slices(offs, SLICE):
            n = b - a
            x, doc = shingles(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            k, d = keys(x, doc, n)
            fp = fingerprints(x, doc, n)
            out = [_lists(k, np.searchsorted(d, np.arange(n + 1))), *(pa.array(fp[:, w].view(np.int64)) for w in range(WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), batch.column("h").slice(a, n), *out], ["doc_id", "h", "keys", *(f"f{w}" for w in range(WORDS))])


def _sets(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        buf, offs = _text.column(batch, "text")
        for a, b in _text.slices(offs, SLICE):
            x, doc = shingles(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            at = np.searchsorted(doc, np.arange(b - a + 1)) * 8
            own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column("h").slice(a, b - a), own.cast(pa.binary())], ["h", "own"])


def _verified(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        near = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both >= SHARE * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))


def _similar(own: list[np.ndarray]) -> np.ndarray:
    """Which two of the sets have a similarity of SHARE or more: a square matrix."""
    n, size = len(own), np.array([len(x) for x in own])
    row = np.repeat(np.arange(n), size)
    _, col, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    often = count > 1
    place = np.cumsum(often) - 1
    row, col = row[often[col]], place[col[often[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(often.sum()), WIDTH):
        i, j = np.searchsorted(col, (a, a + WIDTH))
        m = np.zeros((n, int(col[j - 1]) - a + 1), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        both += m @ m.T
    return both >= SHARE * (size[:, None] + size[None, :] - both)


def _stars(h: list[bytes], root: list[bytes], marks: np.ndarray, own: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Edges that connect those texts of a block whose components links connect."""
    _, part = np.unique(np.array(root, object), return_inverse=True)
    away = np.zeros((len(h), len(h)), np.int16)
    for w in range(WORDS):
        away += np.bitwise_count(marks[:, None, w] ^ marks[None, :, w])
    near = (away <= RADIUS) & (part[:, None] != part[None, :])
    some = np.flatnonzero(near.any(1))
    if not len(some):
        return [], []
    near = _similar([np.frombuffer(own[i], U64) for i in some]) & near[np.ix_(some, some)]
    np.fill_diagonal(near, True)
    label = np.arange(len(some))
    while True:
        new = np.where(near, label, len(some)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(some)))
    return [h[i] for i in some[out]], [h[i] for i in some[label[out]]]


def _met(batches: Iterator[pa.RecordBatch]):
    """Of rows sorted by block and segments: the links within each."""
    key, h, root, own, marks = None, [], [], [], []
    for batch in batches:
        us, vs = [], []
        f = np.stack([batch.column(f"f{w}").to_numpy() for w in range(WORDS)], 1).view(U64)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "a", "b", "h", "root", "own")), strict=True)):
            if row[:3] != key:
                if len(h) > 1:
                    u, v = _stars(h, root, np.stack(marks), own)
                    us, vs = us + u, vs + v
                key, h, root, own, marks = row[:3], [], [], [], []
            h.append(row[3])
            root.append(row[4])
            own.append(row[5])
            marks.append(f[i])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])
    if len(h) > 1:
        u, v = _stars(h, root, np.stack(marks), own)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def _own(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, own): the sets of the texts whose h is in the column w of ``wanted``, distinct."""
    whole = texts.join(wanted, F.col("h") == F.col("w"), "left_semi").dropDuplicates(["h"])
    return whole.mapInArrow(_sets, "h binary, own binary")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v) those whose sets are similar enough, kept in the shared folder."""
    pairs = cut(pairs)
    own = cut(_own(pairs.select(F.col("u").alias("w")).union(pairs.select("v")).distinct(), texts))
    met = pairs.join(own.select(F.col("h").alias("u"), F.col("own").alias("x")), "u").join(own.select(F.col("h").alias("v"), F.col("own").alias("y")), "v")
    return cut(met.select("u", "v", "x", "y").mapInArrow(_verified, "u binary, v binary"))


def _crowds(rest: DataFrame, texts: DataFrame, crowd: int) -> DataFrame:
    """Links between different roots within the blocks of rest (k, h, root, f0..., and as numbers: big, of the block's
    most frequent root or not, and how many texts of the block are, and are not).

    Segments of the others meet each other and those of the big root; those of the big root don't meet.
    """
    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = [f"f{w}" for w in range(WORDS)]
    own = cut(_own(rest.select(F.col("h").alias("w")).distinct(), texts))
    cuts = rest.withColumns({"p": F.ceil(F.col("bigs") / crowd).cast("int"), "q": F.ceil(F.col("others") / crowd).cast("int")})
    cuts = cuts.withColumn("g", F.expr("cast(pmod(xxhash64(h, 5), if(big, p, q)) as int)"))
    meets = "transform(filter(sequence(0, q - 1), o -> o <> g), o -> struct(least(g, o) as a, greatest(g, o) as b)), transform(sequence(0, p - 1), j -> struct(g as a, q + j as b))"
    cuts = cuts.select("k", "h", "root", *f, F.expr(f"explode(if(big, transform(sequence(0, q - 1), i -> struct(i as a, q + g as b)), concat({meets})))").alias("at"))
    rows = cuts.select("k", "at.a", "at.b", "h", "root", *f)
    rows = rows.join(own.withColumnRenamed("h", "w"), F.col("h") == F.col("w")).select("k", "a", "b", "h", "root", *f, "own")
    return cut(rows.repartition(n, "k", "a", "b").sortWithinPartitions("k", "a", "b").mapInArrow(_met, "u binary, v binary"))


def edges(nodes: DataFrame, texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect just the texts (column h) which links connect; nodes has h, keys and f0...; texts h and text."""
    f = [f"f{w}" for w in range(WORDS)]
    every = nodes.select("h", F.explode("keys").alias("k"))
    sizes = every.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("k", "j")
    shared = cut(every.join(sizes, F.col("k") == F.col("j")).select("k", "h", "n"))
    weight = shared.groupBy("h").agg(F.sum("n").alias("w")).withColumnRenamed("h", "o")
    centre = shared.join(weight, F.col("h") == F.col("o")).groupBy("k").agg(F.max(F.struct("w", "h")).alias("c")).select(F.col("k").alias("j"), F.col("c.h").alias("v"))
    marks = nodes.select("h", *f)
    first = shared.join(centre, F.col("k") == F.col("j")).where("h <> v").select(F.col("h").alias("u"), "v").distinct()
    first = first.join(marks.withColumnRenamed("h", "u"), "u")
    first = first.join(marks.select(F.col("h").alias("v"), *(F.col(c).alias(f"v_{c}") for c in f)), "v")
    away = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"v_{c}"))) for c in f), F.lit(0))
    found = _linked(first.where(away <= RADIUS).select("u", "v"), texts)
    # not whole components: the text that one was linked to, and the one that this was linked to, which are of its component
    up = found.groupBy("u").agg(F.min("v").alias("p"))
    over = up.select(F.col("u").alias("c"), F.col("p").alias("pp"))
    roots = cut(up.join(over, F.col("p") == F.col("c"), "left").select(F.col("u").alias("node"), F.coalesce("pp", "p").alias("root")))
    named = marks.join(roots, F.col("h") == F.col("node"), "left").select("h", *f, F.coalesce("root", "h").alias("root"))
    held = shared.where("n > 2").join(named, "h")
    same = [F.bit_xor(F.xxhash64(F.lit(i), "h")).alias(f"z{i}") for i in (0, 1)]
    each = held.groupBy("k", "root").agg(F.count("*").alias("c"), *same)
    split = each.groupBy("k").agg(F.count("*").alias("roots"), F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top"), F.bit_xor("z0").alias("z0"), F.bit_xor("z1").alias("z1"))
    split = split.where("roots > 1").groupBy("n", "z0", "z1").agg(F.min(F.struct("k", "top")).alias("one"))  # of blocks of the same texts one
    split = split.select(F.col("one.k").alias("j"), F.col("one.top.root").alias("most"), F.col("one.top.c").alias("bigs"), (F.col("n") - F.col("one.top.c")).alias("others"))
    rest = held.drop("n").join(split, F.col("k") == F.col("j"))
    rest = cut(rest.select("k", "h", "root", *f, (F.col("root") == F.col("most")).alias("big"), "bigs", "others"))
    return found if rest.isEmpty() else found.union(_crowds(rest, texts, crowd))


def near_copies(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id and component_id: the smallest doc_id that links reach, its own included."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("h"), "text")
    f = [f"f{w}" for w in range(WORDS)]
    marked = cut(texts.mapInArrow(_marked, f"doc_id {kind}, h binary, keys array<long>, {', '.join(f'{c} long' for c in f)}"))
    nodes = cut(marked.groupBy("h").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("keys", *f))))
    roots = components(edges(nodes, texts.select("h", "text"), crowd))
    rooted = nodes.join(roots, F.col("h") == F.col("node"), "left").select("h", "first", F.coalesce("root", "h").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("h").alias("t"), "component_id")
    return marked.select("doc_id", "h").join(named, F.col("h") == F.col("t"), "left").select("doc_id", "component_id")


def brute_force(rows: list[tuple]) -> dict:
    """doc_id -> component, comparing every pair of texts."""

    def own(text: str | None) -> set[bytes]:
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    sets = [own(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= SHARE * len(x | y) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if z == old else z for z in label]
    least = {}
    for (d, _), z in zip(rows, label, strict=True):
        least[z] = min(least.get(z, d), d)
    return {d: least[z] for (d, _), z in zip(rows, label, strict=True)}
