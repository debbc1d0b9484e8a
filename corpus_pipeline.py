"""A training corpus in five stages, each over all that the stage before kept.

Rows with a null id pass the filters of the near-duplicate stage (they link with nothing); null texts are never toxic, never
near copies, never contaminated, and are packed as empty. Decisions fall on rows, not on ids: rows that repeat an id with
other texts have their own. Columns of documents that a stage doesn't need pass through unchanged, whatever their names.
Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import all_columns, cut, drop_cut, free_name
from tessera.llm.decontaminate import with_contamination
from tessera.llm.ngram_join import jaccard_classes
from tessera.llm.packing import pack_documents
from tessera.llm.queries import trains
from tessera.llm.suffix_dedup import without_repeats
from tessera.llm.toxicity import score_toxicity

#: Documents that score as high as this are toxic.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents. Learns from the training fold of labels, as far as these documents hold it. Null, empty and
    wordless texts stay unless the curve alone calls texts without evidence toxic; rows with equal texts share a decision."""
    found = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), trains())
    return found.where(F.col(found.columns[-1])["score"] < TOXIC).select(*all_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the least id,
    and of several rows with that id the one with the least hash of the text. Of rows that repeat an id and a text one
    stays. Rows with a null id, a null text or no words stay, apart from such repeats of an id and a text."""
    classes = cut(jaccard_classes(docs.select("doc_id", "text"), n=5, num=80, den=100, kind="space"))
    one, two, three = (free_name(docs, x) for x in ("__id", "__t1", "__t2"))
    keys = [F.col("id").alias(one), F.col("t1").alias(two), F.col("t2").alias(three)]
    gone = cut(classes.where("not kept").select(*keys).distinct())
    twice = cut(classes.where("kept and id is not null").groupBy("id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    drop_cut(classes)
    text = F.col("text").cast("string")
    keyed = docs.withColumns({one: F.col("doc_id"), two: F.xxhash64(text), three: F.xxhash64(text, F.lit(1))})
    left = keyed.join(gone, [one, two, three], "left_anti")
    if twice.isEmpty():
        return left.select(*all_columns(docs))
    single = left.join(twice, [one, two, three], "left_anti").select(*all_columns(docs))
    return single.unionByName(left.join(twice, [one, two, three], "left_semi").dropDuplicates([one, two, three]).select(*all_columns(docs)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 200 bytes that start more than once out of the texts; n_chars, where there is such a column, follows.
    All rows stay, also those that are left empty; null texts stay null."""
    kept = without_repeats(docs, length=200)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (five-word shingles, similarity 0.8 or more). Null, empty and wordless texts
    stay; rows with equal texts share a decision."""
    found = with_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=5, least=0.8)
    return found.where(F.size(found.columns[-1]) == 0).select(*all_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens at most. Null and empty texts are one end token each; rows that repeat an id or a text are
    packed each on its own; a null id stays null."""
    return pack_documents(docs, capacity=2048, open_bins=256)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's rows go when the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir))
        drop_cut(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
