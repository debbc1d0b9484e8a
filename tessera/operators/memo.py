"""A memo that outlives its runs: what has been computed for a text is looked up, and only the rest is computed, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import kept, released, scratch
from tessera.sources.tables import table
from tessera.sources.versions import Conflict, VersionedTable


class Memo:
    """Rows (key, value, run) below root; keys are digests of namespace and text. compute(df(key, text)) -> df(key, value)."""

    def __init__(self, spark: SparkSession, root: str, namespace: str, value: T.DataType, compute: Callable[[DataFrame], DataFrame]):
        self.spark, self.namespace, self.compute = spark, namespace, compute
        self.table = VersionedTable(spark, root, "key")
        self.schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value), T.StructField("run", T.IntegerType())])
        if not self.table.version():
            self.table.create(spark.createDataFrame([], self.schema))

    def looked_up(self, requests: DataFrame, run: int) -> DataFrame:
        """requests(text, ...) with key, value and the run that computed it. Null texts have no value. A text that a third of the
        requests ask for is one key: duplicates go before anything is joined, and the memo's side of the last join is unique.
        Where another run commits first, its values are taken and only what is still missing is added."""
        keyed = kept(requests.withColumn("key", F.sha2(F.concat(F.lit(f"{self.namespace}:"), F.col("text")), 256)), "requests")
        wanted = kept(keyed.where("key is not null").groupBy("key").agg(F.first("text").alias("text")), "wanted")
        computed = None
        while True:
            base = self.table.version()
            misses = wanted.join(self.table.read(base).select("key"), "key", "left_anti")
            if computed is None:
                computed = kept(self.compute(misses).select("key", "value", F.lit(run).alias("run")).to(self.schema), "computed")
            try:
                self.table.append(computed.join(misses.select("key"), "key", "left_semi"), base)
                break
            except Conflict:
                continue
        out = kept(keyed.join(self.table.read(), "key", "left"), "answers")
        released(keyed, wanted, computed)
        return out


def lengths(texts: DataFrame) -> DataFrame:
    """A stand-in for an embedding: what a text's words and characters come to."""
    return texts.select("key", F.array(F.length("text").cast("long"), F.size(F.split("text", " ")).cast("long"), F.crc32("text")).alias("value"))


def r17_embedding_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over turns: the first asks for the first two of each conversation, the second for all. Each position with its value
    and the run that computed it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    root = scratch(spark, "memo")
    memo = Memo(spark, root, "model", T.ArrayType(T.LongType()), lengths)
    first = memo.looked_up(turns.where("turn < 2"), 1)
    found = memo.looked_up(turns, 2)
    memo.table.drop()
    released(first)
    return found.select("conv_id", "turn", F.col("key").alias("memo_key"), F.col("value")[0].alias("n_chars"), F.col("value")[1].alias("n_words"), "run")


QUERIES = {"r17_embedding_memo": r17_embedding_memo}

ORACLES = {
    "r17_embedding_memo": "select conv_id, turn, case when text is not null then sha256('model:' || text) end memo_key, length(text)::bigint n_chars, len(string_split(text, ' '))::bigint n_words, case when text is null then null when text in (select text from conversations where turn < 2 and text is not null) then 1 else 2 end run from conversations",
}
