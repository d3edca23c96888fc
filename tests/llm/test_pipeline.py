"""The pipeline on the smallest tables, and each stage by its plainer form."""

from pathlib import Path

import pytest

import corpus_pipeline
from tarn.llm import blocks, decontaminate, queries, substring_dedup

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, D).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((name, docs, got))
        docs = got
    return {name: (a, b) for name, a, b in out}


def test_columns(stages):
    for name, (a, b) in stages.items():
        assert name == "packing" or a.columns == b.columns


def test_quality_keeps_clean_documents(spark, stages):
    a, b = stages["quality"]
    labels = spark.read.parquet(f"{D}/labels.parquet")
    kept = {r.doc_id for r in b.collect()}
    clean = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(clean - kept) <= 0.02 * len(clean) and len(kept) < a.count()


def test_near_dedup_keeps_one_of_each_group(stages):
    a, b = stages["near_dedup"]
    groups = blocks.brute_force([(r.doc_id, r.text) for r in a.collect()])
    assert sorted(r.doc_id for r in b.collect()) == sorted(d for d, c in groups.items() if c == d)


def test_substring_dedup(stages):
    a, b = stages["substring_dedup"]
    rows = a.collect()
    force = {r.doc_id: f for r, f in zip(rows, substring_dedup.brute_force([r.text for r in rows]), strict=True)}
    before = {r.doc_id: r for r in rows}
    for r in b.collect():
        words, gone, _ = force[r.doc_id]
        assert len(r.text.encode().split()) == words - gone
        assert gone or r.asDict() == before[r.doc_id].asDict()


def test_decontamination(spark, stages):
    a, b = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id for r in b.collect()}
    gone = [(r.doc_id, r.text) for r in a.collect() if r.doc_id not in kept]
    assert {d for d, *_ in decontaminate.brute_force(gone, items)} == {d for d, _ in gone}
    assert not [r for r in b.collect() if any(t in r.text for _, t in items)]


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "x y z w"), (None, "x y z w"), (5, None), (6, "")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0) for r in corpus_pipeline.near_dedup_stage(spark, df, D).collect())) == [0, 1, 5]


def test_different_texts_of_one_id_or_none(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    df = spark.createDataFrame([(None, a), (None, b), (7, c), (7, d), (8, d)], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.near_dedup_stage(spark, df, D).collect()) == [a, b, c, d]
    df = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, df, D).collect())) == [(3, a), (5, b)]
    df = spark.createDataFrame([(None, a), (4, a)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, D).collect()] == [4]


def test_leaks_take_no_clean_row_of_their_id(spark):
    leak = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(None, leak), (None, a), (7, b), (7, leak), (9, None)], "doc_id long, text string")
    assert {tuple(r) for r in corpus_pipeline.decontamination_stage(spark, df, D).collect()} == {(None, a), (7, b), (9, None)}


def test_run(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    assert rows and {r.doc_id for r in rows} and queries.queries()


CLASHING = ["n_words", "n_removed", "kept_text", "kept_id", "leaked_id", "key", "row", "first_key", "leaked_key", "h", "k", "t", "d", "n", "w", "score", "text_hash", "component_id", "item_id", "task", "rank"]


def clashing(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [None, "", " ".join(f"a{i}" for i in range(80)), f"x {passage} y z", f"q r {passage}", "three words here", f"x {passage} y z"]
    rows = [(None if i == 2 else i % 6, t, *([None] * len(CLASHING))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_columns_and_empty_tables(spark, name):
    """Without lang, source and n_chars, with every other name; then without rows."""
    stage, df = dict(corpus_pipeline.STAGES)[name], clashing(spark)
    got = stage(spark, df, D)
    rows = got.collect()
    if name != "packing":
        assert got.columns == df.columns and all(r[c] is None for r in rows for c in CLASHING)
    if name in ("decontamination", "packing"):
        assert len(rows) == 7
    if name == "near_dedup":
        assert sorted((r.text or "")[:3] for r in rows) == ["", "a0 ", "thr", "x p"]
    if name == "substring_dedup":
        # the two rows that are alike repeat each other whole but for what no window covers
        assert sorted((r.text for r in rows if r.text is not None), key=len)[:4] == ["", "", "", "q r"] and len(rows) == 7
    assert stage(spark, df.where("false"), D).count() == 0


def test_substring_stage_counts_characters(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"é {passage}", 7), (2, f"{passage}  b", 8), (3, "as  it is", 9), (4, None, None)], "doc_id long, text string, n_chars int")
    assert sorted(map(tuple, corpus_pipeline.substring_dedup_stage(spark, df, D).collect())) == [(1, "é", 1), (2, "b", 1), (3, "as  it is", 9), (4, None, None)]
