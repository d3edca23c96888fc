"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A text is lower-cased and split at ASCII characters that are no letters or
digits. A seed is a mask over consecutive tokens; tokens under 0 are ignored, so
replaced words leave some seed of an overlap untouched. Seeds of the
benchmark and of the documents are joined by hash, and around each hit the
``OVERLAP`` tokens windows that contain the seed's first token are compared
token by token on the hit's diagonal. A pair counts if a window has at least
``SHARE`` of its tokens (of the item's, if it is shorter) in place.

All masks begin with 11, so a bitmap of the benchmark's neighbouring token pairs
rules out most places of a document inside one array expression, a second bitmap
of its seeds nearly all others, and only real hits become rows. The bitmaps grow
with the number of seeds up to 16 MB each, enough for 16 million seeds; beyond,
more places go on to the join. The join broadcasts the benchmark's seeds while there are
at most ``BROADCAST_ROWS`` of them, and is a shuffle join, which adaptive
execution can split, beyond. Documents are never shuffled; a passage that very
many documents share only makes rows that are counted before the shuffle.

The masks hit every overlap of 13 tokens with two replaced, of 12 with two and of 9
with one, wherever those are. Of the places for as many replacements as SHARE allows,
3 of 55 are missed at 11 tokens, 9 of 45 at 10, 2 of 8 at 8 and 4 of 7 at 7.

Defined cases: null or empty texts, and texts or items of under seven tokens,
give no row; repeated rows of a doc_id add up in n_seeds; null ids are kept as
ids; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._store import cut

# The masks.
MASKS = ("111111", "1110111", "110100111")
OVERLAP, SHARE = 13, 0.8
BROADCAST_ROWS = 100_000
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPANS = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
SHORTEST = 7
#: log2 of the most bits of a bitmap (16 MB), at 8 bits a seed and 4 a pair.
MOST_BITS = 27
_BACK, _AHEAD = OVERLAP - 1, OVERLAP - 1 + 1


def _hashes(text: str) -> str:
    return f"transform(filter(split(lower({text}), '{BREAK.replace(chr(92), chr(92) * 2)}'), t -> t <> ''), t -> xxhash64(t))"


def _pair(i: str) -> str:
    return f"(get(th, {i}) ^ shiftleft(get(th, {i} + 1), 1))"


def _seed(mask: int, i: str) -> str:
    return f"xxhash64({mask}, {', '.join(f'get(th, {i} + {o})' for o in _SPANS[mask])})"


def _bitmap(values: DataFrame, log2: int) -> DataFrame:
    """One row, column ``bits``: 2**log2 bits as longs, those of the low bits of each value in ``h`` set."""
    words = 1 << (log2 - 6)
    own = values.groupBy(F.expr(f"cast(shiftright(h, 6) & {words - 1} as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b"))
    spark = values.sparkSession
    every = spark.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    return own.union(every).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).agg(F.expr("transform(array_sort(collect_list(struct(w, b))), x -> x.b)").alias("bits"))


def _has(bits: str, h: str, log2: int) -> str:
    return f"getbit(get({bits}, cast(shiftright({h}, 6) & {(1 << (log2 - 6)) - 1} as int)), cast({h} & 63 as int)) = 1"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_seeds (verified hits), matched (most tokens in place), first_token: a row for each contaminated pair."""
    items = benchmark.select("item_id", F.expr(_hashes("text")).alias("th"))
    items = cut(items.where(F.size("th") >= SHORTEST).withColumn("need", F.ceil(F.least(F.lit(OVERLAP), F.size("th")) * F.lit(SHARE))))
    context = f"transform(sequence({-_BACK}, {_AHEAD - 1}), k -> get(th, j + k)) as iw"
    seeds = None
    for m, span in enumerate(MASKS):
        own = items.where(F.size("th") >= len(span)).selectExpr("item_id", "need", "th", f"explode(sequence(0, size(th) - {len(span)})) as j").selectExpr("item_id", "need", "j", f"{_seed(m, 'j')} as h", context)
        seeds = own if seeds is None else seeds.union(own)
    pairs = items.selectExpr("th", "explode(sequence(0, size(th) - 2)) as j").selectExpr(f"{_pair('j')} as h")
    n = seeds.count()
    pair_log, seed_log = (max(12, min(MOST_BITS, math.ceil(math.log2(max(1, n) * k)))) for k in (4, 8))
    near = seeds.withColumnRenamed("h", "sh")
    if n <= BROADCAST_ROWS:
        near = F.broadcast(near)

    d = docs.select("doc_id", F.expr(_hashes("text")).alias("th"))
    d = d.withColumns({"pb": _bitmap(pairs, pair_log).scalar(), "sb": _bitmap(seeds.select("h"), seed_log).scalar()})
    hit = " or ".join(f"({_has('sb', _seed(m, 'i'), seed_log)})" for m in range(len(MASKS)))
    # the partition id makes the list one that the optimizer does not compute twice
    at = d.selectExpr("doc_id", "th", f"if(spark_partition_id() >= 0 and size(th) >= {SHORTEST}, filter(sequence(0, size(th) - {min(map(len, MASKS))}), i -> {_has('pb', _pair('i'), pair_log)} and ({hit})), null) as at")
    around = f"explode(transform(at, i -> struct(i as i, transform(sequence({-_BACK}, {max(map(len, MASKS)) + _AHEAD}), k -> get(th, i + k)) as th)))"
    rows = at.selectExpr("doc_id", f"{around} as x").selectExpr("doc_id", "x.i as i", "x.th as th")
    rows = rows.selectExpr("doc_id", "i", "th as w", f"explode(array({', '.join(_seed(m, str(_BACK)) for m in range(len(MASKS)))})) as h")
    met = rows.join(near, F.col("h") == F.col("sh"))
    width = _BACK + _AHEAD
    met = met.selectExpr("doc_id", "item_id", "i", "need", f"zip_with(slice(w, 1, {width}), iw, (x, y) -> if(x = y, 1, 0)) as e")
    best = f"array_max(transform(sequence(1, {width - OVERLAP + 1}), s -> aggregate(slice(e, s, {OVERLAP}), 0, (n, x) -> n + x)))"
    found = met.selectExpr("doc_id", "item_id", "i", "need", f"{best} as matched").where("matched >= need")
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_seeds"), F.max("matched").cast("long").alias("matched"), F.min("i").cast("long").alias("first_token"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The distinct doc_id of documents that overlap with an item."""
    return overlaps(docs, benchmark).select("doc_id").distinct()


def by_diagonals(doc: str | None, item: str | None) -> bool:
    """Whether any diagonal holds a window with enough tokens in place: no seeds, every place compared."""
    d, b = ([t for t in re.split(BREAK, (x or "").lower()) if t] for x in (doc, item))
    if min(len(d), len(b)) < SHORTEST:
        return False
    need = math.ceil(min(OVERLAP, len(b)) * SHARE)
    for shift in range(1 - len(b), len(d)):
        e = [int(0 <= j + shift < len(d) and d[j + shift] == b[j]) for j in range(len(b))]
        if max(sum(e[s : s + OVERLAP]) for s in range(max(1, len(e) - OVERLAP + 1))) >= need:
            return True
    return False


def brute_force(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """(doc_id, item_id, n_seeds, matched, first_token) by comparing every place of every pair."""

    def tokens(text):
        return [t for t in re.split(BREAK, (text or "").lower()) if t]

    out, bench = {}, [(i, tokens(t)) for i, t in items]
    for doc, text in docs:
        d = tokens(text)
        for item, b in bench:
            if len(b) < SHORTEST:
                continue
            need = math.ceil(min(OVERLAP, len(b)) * SHARE)
            for offs, m in zip(_SPANS, MASKS, strict=True):
                for j in range(len(b) - len(m) + 1):
                    for i in range(len(d)):
                        if i + offs[-1] < len(d) and all(d[i + o] == b[j + o] for o in offs):
                            e = [int(0 <= i + k < len(d) and 0 <= j + k < len(b) and d[i + k] == b[j + k]) for k in range(-_BACK, _AHEAD)]
                            most = max(sum(e[s : s + OVERLAP]) for s in range(len(e) - OVERLAP + 1))
                            if most >= need:
                                n, mm, f = out.get((doc, item), (0, 0, i))
                                out[doc, item] = (n + 1, max(mm, most), min(f, i))
    return {(*k, *v) for k, v in out.items()}
