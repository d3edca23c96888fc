"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontaminate, packing, quality, simhash, substring_dedup
from tarn.llm._store import cut, documents
from tarn.llm.queries import tokenizer_path

#: Keys of under 100 bytes each.
BROADCAST_ROWS = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts, each row by its text; null and empty texts are scored like others. All of an unlabelled or empty table stay or go alike."""
    model = quality.train(docs, documents(spark, sf_dir, "doc_id", "quality", table="labels"))
    return quality.accepted(docs, model)


def row_key() -> Column:
    """What tells rows apart: doc_id (null sorts last) and the text, since ids may be null or repeat."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row): whole rows beside their keys, so that no column of docs can clash with one of ours."""
    return docs.select(row_key().alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard similarity of 0.8 or more) the document of the smallest key.

    Wordless and null texts are one group. Of rows alike in id and text one stays, whichever; an empty table stays empty.
    """
    groups = simhash.near_copies(docs.select(row_key().alias("doc_id"), "text"))
    first = cut(groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n")))
    del groups  # its copies are not needed while the texts are shuffled
    kept = keyed(docs).join(first.select(F.col("doc_id").alias("first_key")), F.col("key") == F.col("first_key"), "left_semi")
    if not first.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select("row.*")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; ``n_chars``, if there is one, is that of the new text.

    Untouched texts stay as they are, null ones too; documents left without words stay with an empty text.
    Rows alike in id and text count as repeats of each other.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("-"), *(F.col(f"`{c}`") for c in other)).alias("row"))
    out = substring_dedup.remove_repeats(rows, carry=("row",), as_is=True)
    own = {c: F.col("row").getField(c) for c in other} | {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return out.select(*(own[c].alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item.

    A row goes by its own id and text: null, empty and short texts stay, and so do clean rows of an id that repeats.
    """
    rows = docs.select(row_key().alias("doc_id"), "text")
    found = decontaminate.contaminated(rows, documents(spark, sf_dir, "item_id", "text", table="benchmark"))
    leaked = cut(found).select(F.col("doc_id").alias("leaked_key"))
    if leaked.count() <= BROADCAST_ROWS:  # else the documents would be shuffled for a few rows
        leaked = F.broadcast(leaked)
    return keyed(docs).join(leaked, F.col("key") == F.col("leaked_key"), "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row: where it lies in which sequence. Null and empty texts are the end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two of them is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
