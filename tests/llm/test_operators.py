"""Each operator against a plainer form of itself, and on odd tables."""

import gzip
import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import _sample, _store, _text, blocks, decontaminate, flac, language, licenses, media, packing, quality, queries, simhash, substring_dedup, toxicity, warc
from tarn.llm._components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, t long, n int, w string, row string, score double, fp long, k string, task int, `rank` int, starts string, component_id string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"Wd{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, periodic, empty, null and long ones."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(40)]
    texts += [" ".join([*words(rng, 20), *passage, *words(rng, 15)]) for _ in range(6)]
    texts += [texts[0], texts[0], texts[3] + " more", "a " * 200, "a " * 36, "", " \t\n\x0b\x0c\r ", None, None, "x", "one two", "no break space", " ".join(words(rng, 9000)), "y" * 70_000]
    texts += ["\n".join(words(rng, 34)), "\t".join(words(rng, 35)), " ".join(passage[:35])]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With clashing extra columns, nulls in them, and a table of its own partitions."""
    rows = [(i, t, None if i % 7 == 0 else "en", None, None, *[None] * 12) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def repeated(spark, docs):
    """Every row twice, and rows without an id."""
    bare = docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    return docs.union(docs).union(bare).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_a_words_hash_depends_on_its_bytes_alone():
    long = b"y" * 70_000
    alone, beside = (np.frombuffer(t, np.uint8) for t in (b"some words", b"some words " + long + b" " + long + b"z"))
    h = [_text.word_hashes(b, *_text.words(b, np.array([0, len(b)]))[:2]) for b in (alone, beside)]
    assert h[0].tolist() == h[1][:2].tolist() and len(set(h[1].tolist())) == 4


def test_words_and_hashes(texts):
    raw = [(t or "").encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, bounds = _text.words(buf, offs)
    h, seen = _text.word_hashes(buf, starts, ends), {}
    for i, r in enumerate(raw):
        own = [buf[a:b].tobytes() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
        assert own == r.split()
        for w, x in zip(own, h[bounds[i] : bounds[i + 1]], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def _removed(rows):
    return sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows), key=str)


def _removed_by_force(rows):
    force = substring_dedup.brute_force([r.text for r in rows])
    return sorted(((r.doc_id is None, r.doc_id, *f) for r, f in zip(rows, force, strict=True)), key=str)


@pytest.mark.parametrize("table", ["docs", "repeated", "empty"])
def test_substring_dedup(request, table):
    df = request.getfixturevalue(table)
    assert _removed(substring_dedup.remove_repeats(df).collect()) == _removed_by_force(df.collect())


def test_substring_dedup_loses_nothing_with_a_full_sketch_and_many_flushes(docs, monkeypatch):
    """Flushes of one batch's windows each, and a sketch that is all ones."""
    bits = substring_dedup.repeated_bits
    monkeypatch.setattr(substring_dedup, "repeated_bits", lambda *a: bits(*a) | np.uint8(255))
    small = docs.repartition(20)
    assert _removed(substring_dedup.remove_repeats(small).collect()) == _removed_by_force(docs.collect())


@pytest.mark.parametrize("table", ["docs", "repeated", "empty"])
def test_substring_dedup_with_a_sketch_that_stays_distributed(request, table):
    df = request.getfixturevalue(table)
    assert _removed(substring_dedup.remove_repeats(df, max_bits=8).collect()) == _removed_by_force(df.collect())


def test_a_distributed_sketch_passes_the_same_anchors(docs, spark):
    """As the broadcast one does, in flushes of one slice or of all."""
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    plane = substring_dedup.repeated_bits(docs, 35, 18, 18)
    want = {}
    for batch, a, b, own, place, bounds in substring_dedup._anchors(iter(rows.toArrow().to_batches()), 35, 18):
        hit = np.ones(len(own), bool)
        for row in range(substring_dedup.ROWS):
            c = substring_dedup._cells(own, row, 18)
            hit &= (plane[row][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 == 1
        doc = np.searchsorted(bounds, place, "right") - 1
        for i in np.unique(doc[hit]):
            want[batch.column("d")[int(a + i)].as_py()] = np.unique(own[hit & (doc == i)]).tolist()
    got = {r.d: np.frombuffer(bytes(r.hot), np.uint64).tolist() for r in substring_dedup.repeated_anchors(rows, 35, 18, 18).collect()}
    assert got == want and len(got) > 8


def test_flushes_make_no_difference(docs, monkeypatch):
    import pyarrow as pa

    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text").toArrow().to_batches()
    monkeypatch.setattr(substring_dedup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    monkeypatch.setattr(_text, "SLICE_BYTES", 1000)
    plane = np.full((substring_dedup.ROWS, (1 << 18) // 8), 255, np.uint8)
    found = []
    for most in (1 << 21, 20):
        monkeypatch.setattr(substring_dedup, "FLUSH_WINDOWS", most)
        small = [x.slice(i, 1) for b in rows for x in [b] for i in range(len(b))]
        sent = pa.Table.from_batches(list(substring_dedup._candidates(iter(small), 35, 18, 18, plane, 4))).to_pandas()
        hits = [substring_dedup._exact(g) for _, g in sent.groupby("r")]
        import pandas as pd

        spans = pd.concat([substring_dedup._returned(g) for _, g in pd.concat(hits).groupby("flush")])
        got = defaultdict(set)
        for d, _, s in spans.itertuples(index=False):
            got[d].update(np.frombuffer(s, np.uint32).tolist())
        found.append(dict(got))
    assert found[0] == found[1] and len(found[0]) > 8


def test_substring_dedup_of_many_rows_of_one_id_and_text(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    began = time.time()
    assert substring_dedup.remove_repeats(df).groupBy("n_words", "n_removed", "kept_text").count().collect() == [(200, 200, "", 4000)]
    assert time.time() - began < 60


def test_sketches_merge_in_steps_alike(docs):
    one = substring_dedup.repeated_bits(docs, 35, 18, 18)
    assert one.any() and (one == substring_dedup.repeated_bits(docs, 35, 18, 18, 5)).all()


def test_substring_dedup_carries_columns(docs):
    out = substring_dedup.remove_repeats(docs, carry=("text", "t", "d", "starts"))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_text", "text", "t", "d", "starts"]
    assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("table", ["docs", "empty"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == simhash.brute_force([(r.doc_id, r.text) for r in df.collect()])


def test_simhash_of_repeated_rows(docs, repeated):
    want = simhash.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    rows = simhash.near_duplicates(repeated).collect()
    assert len(rows) == repeated.count()
    by_fp = {fp: c for fp, c in want.values()}
    assert all(r.component_id == by_fp[f"{r.fp & (1 << 64) - 1:016x}"] for r in rows)


def test_simhash_levels(spark):
    """Dense groups of fingerprints that go through every level link as by comparing all pairs."""
    rng = random.Random(4)
    xs = set()
    for c in [rng.getrandbits(64) for _ in range(5)]:
        for _ in range(50):
            y = c
            for _ in range(rng.randint(0, 6)):
                y ^= 1 << rng.randrange(64)
            xs.add(y - (1 << 64) if y >> 63 else y)
    xs = sorted(xs)
    parent = {x: x for x in xs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(xs):
        for y in xs[:i]:
            if bin((x ^ y) & (1 << 64) - 1).count("1") <= 3:
                parent[find(x)] = find(y)
    roots = {r.node: r.root for r in components(simhash.edges(spark.createDataFrame([(x,) for x in xs], "fp long"), crowd=4)).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for x in xs:
        want[find(x)].add(x)
        got[roots.get(x, x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def near_texts():
    """Families of near copies around the limit, short and long, with boilerplate that many texts share."""
    rng = random.Random(11)
    texts = [None, "", " ", "a b", "A  b", "a b c", *corpus(6)]
    for n, k, most in ((30, 12, 3), (90, 30, 6), (200, 30, 9), (700, 8, 30), (2000, 4, 90), (30000, 3, 1200)):
        texts += variants(rng, words(rng, n, 5000), k, most)
    line = words(rng, 12)
    texts += [" ".join([*line, *words(rng, rng.randint(5, 30), 3000), *line]) for _ in range(60)]
    return texts


def test_near_copies(spark, docs):
    for rows in ([(i, t) for i, t in enumerate(near_texts())], [(r.doc_id, r.text) for r in docs.collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit(1)).withColumn("h", F.lit(None))
        force = blocks.brute_force(rows)
        for crowd in (blocks.CROWD, 3):
            assert {r.doc_id: r.component_id for r in blocks.near_copies(df.repartition(5), crowd).collect()} == force


def test_near_copies_of_odd_tables(repeated, empty):
    rows = blocks.near_copies(repeated).collect()
    assert len(rows) == repeated.count() and blocks.near_copies(empty).count() == 0
    every = repeated.collect()
    force = blocks.brute_force([(i, r.text) for i, r in enumerate(every)])
    least = {}
    for i, c in force.items():
        least[c] = min(least.get(c, 10**9), every[i].doc_id if every[i].doc_id is not None else 10**9)
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter((every[i].doc_id, least[c]) for i, c in force.items())


def test_blocks_of_two_sizes_have_a_level_in_common():
    n = np.arange(1, 200_000)
    slack = blocks.SHARE**-0.5
    low, high = blocks._level(n / slack), blocks._level(n * slack)
    other = np.minimum(np.floor(n / blocks.SHARE).astype(int), n[-1]) - 1
    assert (np.maximum(low, low[other]) <= np.minimum(high, high[other])).all()


def test_block_chance():
    """Of each level's largest size: some block of a pair of exactly SHARE is equal but twice in 10,000."""
    for level, (most, b) in enumerate(blocks.LEVELS):
        full = most / b * (1 + blocks.SHARE) ** -1 * 2 * blocks.SHARE  # shared shingles of a block
        same = np.exp(-2 * (1 - blocks.SHARE) / (1 + blocks.SHARE) * most / b)
        few = 0 if not level else np.exp(-full) * (1 + full + full**2 / 2)
        assert (1 - same * (1 - few)) ** b < 2e-4


def test_pairs_at_the_limit_share_a_block():
    """Of 400 pairs of exactly SHARE and all sizes, drawn anew, none is without a key in common."""
    rng = np.random.default_rng(3)
    for n in rng.integers(9, 5000, 400):
        both = int(round(n * 2 * blocks.SHARE / (1 + blocks.SHARE)))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 10, dtype=np.uint64))
        rng.shuffle(pool)
        sets = [np.sort(np.concatenate((pool[:both], pool[a : a + n - both]))) for a in (both, n)]
        found = [set(blocks.keys(s, np.zeros(len(s), np.int64), 1)[0].tolist()) for s in sets]
        assert found[0] & found[1], n


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000 + i, 999) for i in range(50)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {1000 + i: 999 for i in range(50)}


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((30, 22, 13, 9, 6, 40))] + [(98, None), (99, "")]
    docs = []
    for i, (_, t) in enumerate(items[:6]):
        own = t.split()
        swapped = [w if k % 7 else "other" for k, w in enumerate(own, 1)]
        for j, part in enumerate((own, swapped, own[: len(own) // 3], [w.upper() + "," for w in own])):
            docs.append((10 * i + j, " ".join([*words(rng, 25), *part, *words(rng, 25)])))
    docs += [(900 + i, t) for i, t in enumerate(corpus(5)[:30])] + [(990, None), (991, ""), (992, "w1"), (None, items[0][1]), (3, docs[3][1])]
    return docs, items


def test_decontamination(spark, leaky):
    docs, items = leaky
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, th string, item_id int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, need string")
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        decontaminate.BROADCAST_ROWS, kept = limit, decontaminate.BROADCAST_ROWS
        out = decontaminate.overlaps(df, bench)
        decontaminate.BROADCAST_ROWS = kept
        assert {tuple(r) for r in out.collect()} == decontaminate.brute_force(docs, items)
    found = {r.doc_id for r in decontaminate.contaminated(df, bench).collect()}
    assert {0, 1, 3, 10, 11, 20, None} <= found and not {d for d, _ in docs if d and d >= 900} & found


def test_decontamination_recall_by_replacements(spark):
    """Against every diagonal compared: with 0, 1 and 2 words replaced anywhere in 13, nothing is missed."""
    rng, docs, items = random.Random(12), [], []
    for k in (0, 1, 2):
        for _ in range(60):
            item = [f"t{rng.randrange(10**6)}" for _ in range(13)]
            for at in rng.sample(range(13), k):
                item[at] = "#"
            whole = [w if w != "#" else f"r{rng.randrange(10**6)}" for w in item]
            other = [w if w != "#" else f"s{rng.randrange(10**6)}" for w in item]
            items.append((len(items), " ".join(whole)))
            docs.append((len(docs), " ".join([*words(rng, 9), *other, *words(rng, 9)])))
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(d, i) for d, t in docs for i, u in items if decontaminate.by_diagonals(t, u)} and len(got) == 180


def test_decontamination_of_many_seeds(spark):
    """A million seeds: bitmaps that still rule places out, and a shuffle join."""
    bench = spark.range(40_000).selectExpr("id as item_id", "array_join(transform(sequence(0, 9), i -> concat('w', xxhash64(id, i))), ' ') as text")
    docs = bench.where("item_id % 4000 = 7").selectExpr("item_id as doc_id", "concat('before it ', text, ' after it') as text").union(spark.createDataFrame([(-1, " ".join(f"n{i}" for i in range(5000)))]))
    out = decontaminate.overlaps(docs, bench)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(i, i) for i in range(7, 40_000, 4000)}


def test_decontamination_is_native(spark, leaky):
    docs, items = leaky
    out = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_decontamination_of_nothing(spark, leaky, empty):
    docs, items = leaky
    full = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.overlaps(empty, full[1]).count() == decontaminate.overlaps(full[0], full[1].where("false")).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of two kinds of quality, some toxic, in two languages."""
    rng = random.Random(3)
    rows, labels = [], []
    tongue = {"en": ["the", "of", "and", "with", "thing", "there"], "de": ["der", "und", "nicht", "schön", "über", "eine"]}
    for i in range(600):
        lang = "de" if i % 3 == 0 else "en"
        w = [rng.choice(tongue[lang]) + rng.choice(["", "er", "ing"]) for _ in range(rng.randrange(3, 60))]
        bad, toxic = i % 5 == 1, i % 10 == 4
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["scum", "grubbel" + rng.choice(["en", "tum", "ig"])]))
        rows.append((i, " ".join(x + "###" for x in w) if bad else " ".join(w), lang, "s", 0))
        if i % 2 == 0 or bad:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, "en", None, None), (1001, "", None, None, None), (1002, "123 !!", "en", None, None), (None, "the thing", "en", None, None), (0, "der und", "de", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.cache(), spark.createDataFrame([*labels, (2000, 1, 1), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").cache()


def _accuracy(rows, truth):
    own = [(r, truth[r.doc_id]) for r in rows if r.doc_id in truth and truth[r.doc_id] is not None]
    return sum(p == y for p, y in own) / len(own) if not hasattr(own[0][0], "_fields") else own


def test_quality(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 300
    out = {r.doc_id: r.score for r in quality.score(docs, model, "doc_id").collect()}
    right = [(out[r.doc_id] >= 0.3) == (r.quality == 1) for r in labels.collect() if r.doc_id in out and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in out.values())
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_rules_compile_as_they_score(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    rows = quality.statistics(docs, "doc_id").select("row.*", *(f"s_{n}" for n in quality.STATISTICS), model.column().alias("score")).toPandas()
    x = rows[[f"s_{n}" for n in quality.STATISTICS]].to_numpy()
    assert np.allclose(model.score(x), rows["score"])


def test_quality_of_odd_tables(docs, repeated, empty, labelled):
    _, labels = labelled
    for own in (labels, labels.where("false"), labels.where("quality = 1")):
        model = quality.train(docs, own)
        assert quality.accepted(repeated, model).columns == repeated.columns
        assert quality.score(repeated, model, "doc_id", "score" if False else "text").where("score is null or score < 0 or score > 1").count() == 0
    assert quality.accepted(empty, quality.train(empty, labels)).count() == 0


def test_toxicity(labelled):
    docs, labels = labelled
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    truth = {i: i % 10 == 4 for i in range(600)}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == truth[i] for i in held]) > 0.95
    assert all(out[i] < 0.5 for i in held if not truth[i])


def test_fits_do_not_depend_on_partitions(spark, labelled):
    """Ids that repeat with other texts included."""
    docs, labels = labelled
    docs = docs.union(docs.where("doc_id < 40").selectExpr("doc_id + 1", "text", "lang", "source", "n_chars"))
    seen = []
    for n in (1, 3, 7):
        d, own = docs.repartition(n, F.xxhash64("text", F.lit(n))), labels.repartition(n)
        q, t, net = quality.train(d, own), toxicity.train(d, own), language.train(d)
        seen.append((q, t.bias, t.words.tolist(), t.weights.tolist(), net.languages, [x.tolist() for x in (*net.tables, net.dense)]))
    assert seen[0] == seen[1] == seen[2]


def test_draw_is_bounded_and_even(spark):
    rows = spark.range(50_000).selectExpr("id as doc_id").union(spark.range(30_000).selectExpr("7L as doc_id"))
    got = _sample.draw(rows, 1000).collect()
    assert len({r.doc_id for r in got}) == 1000 == len(got)
    want = rows.distinct().orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(1000).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in want}


def test_toxicity_scores_by_a_plain_sum(labelled):
    """Of one text after the other: the distinct words and beginnings it has, looked up in a dict."""
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    assert weight
    for r in toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id == 0:
            continue  # two texts of one id
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        own = {int(h) for hashes, _ in toxicity.features(raw, np.array([0, len(raw)])) for h in hashes}
        z = model.bias + sum(weight.get(h, 0) for h in own)
        assert np.isclose(r.score, 1 / (1 + np.exp(-z)))


def test_language_scores_by_a_plain_network(docs):
    """Loops over windows, places and filters on short texts."""
    net = language.train(docs)
    for r in language.identify(docs, net).join(docs.select("doc_id", "text"), "doc_id").where("length(text) between 1 and 120").limit(6).collect():
        raw = (r.text.encode() + bytes(256))[:256]
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        wide = net.tables[0].shape[1]
        places = 256 - len(net.tables) + 1
        top = [max(sum(t[raw[p + j], f - (wide - t.shape[1])] for j, t in enumerate(net.tables) if f >= wide - t.shape[1]) for p in range(places)) for f in range(wide)]
        z = np.maximum(np.array(top) + net.shift, 0) @ net.dense + net.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if r.lang_pred != "und":
            assert r.lang_pred == net.languages[int(p.argmax())] and np.isclose(r.score, p.max(), atol=1e-4)


def test_non_negative_risk():
    """The gradient is that of the risk while its negative part is positive, and climbs on that part below."""
    rng = np.random.default_rng(0)
    z_p, z_u = rng.normal(0, 1, 5), rng.normal(0, 1, 9)

    def risk(p, u):
        return 0.2 * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - 0.2 * np.logaddexp(0, p).mean()

    g_p, g_u = toxicity.risk_gradient(z_p, z_u, 0.2)
    for z, g, f in ((z_p, g_p, lambda z: risk(z, z_u)), (z_u, g_u, lambda z: risk(z_p, z))):
        for i in range(len(z)):
            d = np.zeros(len(z))
            d[i] = 1e-6
            assert abs((f(z + d) - f(z - d)) / 2e-6 - g[i]) < 1e-6
    g_p, g_u = toxicity.risk_gradient(np.full(5, 9.0), np.full(9, -9.0), 0.2)
    assert (g_u < 0).all() and (g_p > 0).all()


def test_toxicity_of_odd_tables(docs, repeated, empty, labelled):
    _, labels = labelled
    for own in (labels, labels.where("false"), labels.where("toxic = 1")):
        out = toxicity.score(repeated, toxicity.train(docs, own))
        assert out.count() == repeated.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_language(labelled):
    docs, _ = labelled
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.train(docs)).collect() if r.doc_id}
    held = [i for i in range(1, 600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i][0] == ("de" if i % 3 == 0 else "en") for i in held]) > 0.95
    assert out[1000] == out[1001] == out[1002] == ("und", 0.0)


def test_language_windows_and_responses():
    raw = [b"Ab" * 300, b"", b"x", b"y" * 256]
    windows, doc, size = language.windows_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert doc.tolist() == [0, 0, 0, 2, 3] and size.tolist() == [256, 256, 88, 1, 256]
    assert b"".join(windows[doc == 0].tobytes()[: len(raw[0])].split()) == raw[0].lower()
    net = language.fit(windows, np.array([0, 0, 0, 1, 1]), ["a", "b"], epochs=1)
    r = net.responses(windows)
    j, f = 5, language.FILTERS  # the first filter of the second width
    assert np.isclose(r[0, j, f], sum(net.tables[k][windows[0, j + k], f - (r.shape[2] - net.tables[k].shape[1])] for k in range(language.WIDTHS[1])))


def test_language_of_odd_tables(docs, repeated, empty):
    net = language.train(docs)
    out = language.identify(repeated, net)
    assert out.count() == repeated.count() and out.where("lang_pred is null or score is null").count() == 0
    assert language.train(empty) is None and language.identify(repeated, None).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, net).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "u", "aa"), (2, "u v\r\nX: y", "aa"), (3, None, None), (4, "x", ""), (5, "y", "é" * 30000), (5, "y", "é" * 30000), (None, "z", "q"), (7, "w", "é" * 30000), (8, "v", "\r\n0\r\n\r\n" * 9000), (9, "s", "alone"), (9, "s", "alone")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha string")


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_ROWS, -1])
def test_warc(pages, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows = pages.collect()
    got = Counter(tuple(r)[:5] + (r.complete,) for r in warc.read_archive(warc.write_archive(pages)).collect())
    top = {}
    for r in rows:
        top[r.html or ""] = max(top.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
    want = Counter()
    for r in rows:
        raw = (r.html or "").encode()
        first = (r.page_id if r.page_id is not None else -1) == top[r.html or ""]
        want[r.page_id, len(raw), warc.digest(raw), "response" if first else "revisit", None if first else top[r.html or ""], True] += 1
    assert got == want


def test_warc_without_revisits_of_small_payloads(pages):
    out = warc.read_archive(warc.write_archive(pages, least=100)).collect()
    assert {r.page_id for r in out if r.record_type == "revisit"} == {5}


def test_warc_framing_and_damage(spark, pages):
    members = [r.member for r in warc.write_archive(pages).collect()]
    everything = b"".join(members)
    assert len(list(warc.records(bytes(everything)))) == len(members)
    whole = warc.read_responses(spark.createDataFrame([(everything,)], "member binary")).collect()
    assert sum(r.complete for r in whole) == len(whole) and max(r.n_segments for r in whole) > 3
    last = next(m for m in members if next(warc.records(m))["total"])
    lost = warc.read_responses(spark.createDataFrame([(m,) for m in members if m != last], "member binary")).where("not complete").collect()
    assert len(lost) == 1 and lost[0].payload is None
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"x" * 9999)) == b"x" * 9999


def test_warc_files(spark, pages, tmp_path):
    """Files that any gzip reader inflates, of records that are read as they were written."""
    path = warc.write_files(warc.write_archive(pages), str(tmp_path / "archive"), records_a_file=3)
    files = sorted((tmp_path / "archive").glob("*.warc.gz"))
    assert len(files) > 2
    ids = []
    for f in files:
        plain = gzip.decompress(f.read_bytes())
        own = list(warc.records(plain))
        assert own == list(warc.records(f.read_bytes())) == list(warc.records(gzip.compress(plain))) and 0 < len(own) <= 3
        ids += [r["ident"] for r in own]
        with pytest.raises(ValueError):
            list(warc.records(f.read_bytes()[:-30]))
        with pytest.raises(ValueError):
            list(warc.records(plain[:-9]))
    got = Counter(map(tuple, warc.read_archive(warc.read_files(spark, path)).collect()))
    assert got == Counter(map(tuple, warc.read_archive(warc.write_archive(pages)).collect())) and sum(got.values()) == pages.count()


def test_warc_records_in_linear_time():
    member = warc.record("resource", "<urn:x>", b"y" * 50)
    began = time.time()
    assert sum(1 for _ in warc.records(member * 60_000)) == 60_000
    assert time.time() - began < 20


def test_warc_of_nothing(pages):
    assert warc.read_archive(warc.write_archive(pages.where("false"))).count() == 0


def _payloads():
    rng = np.random.default_rng(1)
    raw = [b"", b"\xff" * 64, bytes(range(256)) * 5, rng.integers(0, 256, 6400, dtype=np.uint8).tobytes(), bytes([0] * 63 + [255]) * 40, b"abc" * 999, bytes((np.sin(np.arange(5000) / 9) * 90 + 128).astype(np.uint8)), *((t or "").encode() for t in corpus(8))]
    return [media.payload(r) for r in raw]


def test_flac_round_trip():
    raw = _payloads()
    samples = (np.frombuffer(b"".join(raw), np.uint8) ^ np.uint8(128)).view(np.int8)
    streams = flac.encode_many(samples, np.cumsum([0, *map(len, raw)]))
    for r, (x, first) in zip(raw, flac.decode_many(streams), strict=True):
        assert (x.view(np.uint8) ^ np.uint8(128)).tobytes() == r
        assert first.tolist() == list(range(0, len(r), flac.BLOCK))
    for r, s in list(zip(raw, streams, strict=True))[:8]:
        assert bytes(v + 128 for v in flac.decode_stream(s)[0]) == r
    kinds = {s[flac.metadata(s)["frames"] + 6] >> 1 for s in streams}
    assert len(kinds) > 2  # several kinds of subframes
    assert len(streams[6]) < len(raw[6]) / 1.5  # a sine is easy to predict


def test_flac_notices_damage():
    raw = media.payload(b"some text " * 300)
    (stream,) = flac.encode_many((np.frombuffer(raw, np.uint8) ^ np.uint8(128)).view(np.int8), np.array([0, len(raw)]))
    for at in (2, len(stream) - 5, len(stream) // 2, flac.metadata(stream)["frames"] + 3):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        for decode in (flac.decode_stream, lambda s: flac.decode_many([s])):
            with pytest.raises(ValueError):
                decode(bytes(bad))


def test_flac_partitions_escapes_and_stereo():
    """A hand-made frame: left and side, two Rice partitions of five-bit parameters, one of them raw."""
    bits = "11111111111110" + "0" + "0" + "0110" + "0100" + "1000" + "001" + "0" + "00000000" + f"{15:08b}"
    head = int(bits, 2).to_bytes(len(bits) // 8, "big")
    left = [3, 1, -2, 5, 0, 0, 1, -1, 7, 7, -8, 4, 2, 1, 0, 3]
    side = [0] * 16
    rice = lambda v, k: "0" * ((u := v * 2 if v >= 0 else -2 * v - 1) >> k) + "1" + (f"{u & (1 << k) - 1:0{k}b}" if k else "")
    body = "0" + "001000" + "0" + "01" + "0001" + "00001" + "".join(rice(v, 1) for v in left[:8]) + "11111" + "00101" + "".join(f"{v & 31:05b}" for v in left[8:])
    body += "0" + "000000" + "0" + "0" * 9
    body += "0" * (-len(body) % 8)
    frame = head + bytes([flac.crc8(head)]) + int(body, 2).to_bytes(len(body) // 8, "big")
    frame += flac.crc16(frame).to_bytes(2, "big")
    channels, end = flac._frame(frame, 0, 8)
    assert channels == [left, [a - b for a, b in zip(left, side, strict=True)]] and end == len(frame)


@pytest.mark.parametrize("table", ["repeated", "empty"])
def test_media(request, table):
    df = request.getfixturevalue(table)
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.round_trip(df).collect())
    want = Counter()
    for r in df.collect():
        raw = (r.text or "").encode()
        p = media.payload(raw)
        want[r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want


def test_media_blocks(docs):
    stored = media.encode(docs).cache()
    decoded = media.decode(stored).cache()
    assert {tuple(r) for r in media.features(decoded).collect()} == {tuple(r) for r in media.round_trip(docs).collect()}
    back, streams = defaultdict(dict), {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in media.pcm_blocks(decoded).collect():
        back[r.doc_id][r.first_sample] = bytes((np.frombuffer(r.pcm, np.uint8) ^ np.uint8(128)).tobytes())
        assert r.n_samples == len(r.pcm) and r.first_sample == r.block * flac.BLOCK
    for r in docs.collect():
        assert b"".join(v for _, v in sorted(back[r.doc_id].items())) == media.payload((r.text or "").encode())
    for r in media.round_trip(docs).collect():
        own = streams[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(own), hashlib.sha256(own).hexdigest())
        if r.n_bytes < 2000:  # the whole row from the plain decoder
            x = flac.decode_stream(own)[0]
            raw = bytes(v + 128 for v in x)
            crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
            assert r.feature == f"energy={sum(v * v for v in x)};crossings={crossings};peak={max(map(abs, x))};sum={sum(x)}"


LICENSES = [
    ("Licensed under the Apache License, Version 2.0.", {"apache", "apache-2.0"}),
    ("licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("GNU  Lesser General Public License", {"lgpl"}),
    ("CC BY-NC 4.0 applies; cc, by", {"cc-by", "cc-by-nc"}),
    ("SPDX-License-Identifier: GPLv2", {"gpl-2.0"}),
    ("MIT-License, mit licence", {"mit"}),
    ("mit der Zeit", set()),
    ("submit licenses, gplish", set()),
    ("Licensed under the\nMozilla Public License, version 1.1", {"mpl-1.1"}),
    ("Copyright (c) 2001 all rights reserved", {"all-rights-reserved", "copyright"}),
    ("İ APACHE\x00LICENSE", {"apache"}),
]


def test_licenses(spark, repeated, empty):
    assert len(licenses.rules()) > 300
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LICENSES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (t, want) in enumerate(LICENSES):
        assert set(filter(None, got[i].labels.split(","))) == want, t
        assert tuple(got[i][1:6]) == licenses.brute_force(t)
        ends = [(d.first_word, d.last_word) for d in got[i].detections]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    rows = licenses.scan(repeated).collect()
    assert Counter((r.doc_id, *r[1:6]) for r in rows) == Counter((r.doc_id, *licenses.brute_force(r.text)) for r in repeated.collect())
    assert licenses.scan(empty).count() == 0


BODIES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", {"mit"}),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", {"bsd"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", {"gpl", "gpl-3.0"}),
    ("see https://www.apache.org/licenses/LICENSE-2.0 and creativecommons.org/licenses/by-nc-sa/4.0/", {"apache-2.0", "cc-by-nc-sa"}),
    ("SPDX-License-Identifier:\tMPL-2.0", {"mpl-2.0"}),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", {"mit"}),
    ("© 1999 someone, in the public domain", {"copyright"}),
]


def test_license_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BODIES)], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(BODIES))] == [want for _, want in BODIES]


def test_license_suppression_by_a_plain_model():
    """All rules on all of a text; a match stays if no match that goes before it covers a byte of it."""
    s, rng = licenses.Scanner(), random.Random(9)
    parts = [t for t, _ in [*LICENSES, *BODIES]]
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))).lower().encode()
        found = sorted((r.priority, m.start() - m.end(), i, m.start(), m.end(), r.label) for i, r in enumerate(s.rules) for m in r.pattern.finditer(text))
        taken, want = set(), []
        for priority, _, _, a, b, label in found:
            if not taken & set(range(a, b)):
                taken |= set(range(a, b))
                want.append((a, b, label, priority))
        assert s.detections(text) == sorted(want)


def test_license_gate_is_lossless():
    """A scan of every rule on every text finds nothing in texts that the gate leaves out."""
    s = licenses.Scanner()
    for t, _ in LICENSES:
        low = t.lower().encode()
        if not len(s.gated(low, np.array([0, len(low)]))):
            assert not [m for r in s.rules for m in r.pattern.finditer(low)]
    assert len({r.pattern.pattern for r in s.rules}) > 300


ODD = ["It's DON'T we'll 3½ ¼ x² naïve ÀÉ—ß µm ªº a_b C++ #$% 12'34 '", "Σας ΟΔΟΣ", "éa", "<|endoftext|>x<|startoftext|>", "a b\x85c\x1cd\x0be", "İstanbul ǅ ﬁ", "× ÷ © ® ¿¡", "日本語 テスト", "", " \n\t", "''s 's''s"]


def test_token_ids():
    whole = packing.encoder(queries.tokenizer_path())
    for t in [*ODD, *(x for x in corpus(3) if x)]:
        want = np.array(whole.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert whole.ids(t) == want == whole.ids(t)


def test_fullest_by_force():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        take = packing.fullest(dict(counts), room)
        assert sum(n * k for n, k in take.items()) == max(sums) and all(k <= counts[n] for n, k in take.items())


def test_bins_hold_everything_and_few_are_slack():
    rng = random.Random(7)
    counts = Counter(min(4096, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(5000))
    bins = packing.minimum_bin_slack(dict(counts))
    held = Counter()
    for times, take in bins:
        assert sum(n * k for n, k in take.items()) <= 4096
        for n, k in take.items():
            held[n] += times * k
    assert held == counts
    assert sum(t for t, _ in bins) <= -(-sum(n * c for n, c in counts.items()) // 4096) + 2


@pytest.mark.parametrize("table", ["repeated", "empty"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    rows = packing.pack(df, queries.tokenizer_path(), capacity=256).collect()
    enc = packing.encoder(queries.tokenizer_path())
    want = Counter()
    for r in df.collect():
        raw = enc.ids(r.text or "") + (1).to_bytes(4, "little")
        for k, a in enumerate(range(0, len(raw), 1024)):
            want[r.doc_id, k, a // 4, len(raw[a : a + 1024]) // 4, zlib.crc32(raw[a : a + 1024])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.01 * -(-sum(r.length for r in rows) // 256)


def test_cut_leaves_no_shuffle(spark):
    """The shuffles of a copy go with its execution, not with the driver's garbage; the session's setting stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = spark.conf.get(key, None)

    def held():
        return {f.name for f in local.rglob("shuffle_*.data")}

    old = held()
    rows = spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("t"))
    got = _store.cut(rows)
    for _ in range(50):
        if held() <= old:
            break
        time.sleep(0.1)
    assert held() <= old and spark.conf.get(key, None) == before
    assert got.count() == rows.count() == 100 and got.agg(F.sum("t")).first()[0] == sum(range(5000))


def test_broadcast_blocks_are_small(spark):
    _store.bounded(spark)
    seen = spark.sparkContext._jsc.sc().conf().getSizeAsKb("spark.broadcast.blockSize")
    assert seen < 512  # half of G1's smallest region, from where an object is humongous
