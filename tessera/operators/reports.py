"""Golden cases, reports, previews, generated rows, recorded pointers: small sources and sinks around the evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapsed
from tessera.sources.shared import kept, removed, scratch
from tessera.sources.tables import table, telemetry, turns

#: Different hypotheses that a query needs; kinds of generated accounts.
HYPOTHESES = 3
ACCOUNTS = ["savings", "current", "loan"]
PREVIEWS = 5


def golden_cases(cases: DataFrame, key: str, text: str) -> DataFrame:
    """Cases with `valid` (a text that isn't blank) and `times`, how many rows have their key: counts meet by key only."""
    times = cases.groupBy(key).agg(F.count("*").alias("times"))
    return cases.join(times, key).select(key, F.coalesce(collapsed(text) != "", F.lit(False)).alias("valid"), "times")


def s12_golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as golden cases, keyed by the digest of their text: those that stand twice can't serve."""
    items = table(spark, sf_dir, "benchmark").select(F.md5(F.lower(collapsed("text"))).alias("case_id"), "text")
    return golden_cases(items, "case_id", "text")


def s13_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each feature, written as JSON lines and read back under its schema."""
    out = scratch(spark, "report")
    t = telemetry(spark, sf_dir)
    rows = t.groupBy("feature").agg(F.count("*").alias("cases"), F.count_if("fallback").alias("errors"), F.round(F.avg("k"), 4).alias("mean"))
    rows.write.json(out)
    return spark.read.schema("feature string, cases long, errors long, mean double").json(out)


def s14_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample accounts generated from the customers' keys: one to three each, their kinds in turn."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    each = c.select("c_custkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c_custkey") % 3 + 1)).alias("account"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ACCOUNTS]), ((F.col("c_custkey") + F.col("account")) % 3 + 1).cast("int"))
    return each.select("c_custkey", "account", kind.alias("kind"))


def of_feature(column: str, feature: str | None, baseline: str | None = None) -> Column:
    """Rows of a feature, with those of a baseline if one is named; all rows without a feature."""
    if feature is None:
        return F.lit(True)
    return F.col(column).isin(feature, baseline) if baseline else F.col(column) == feature


def p8_feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return t.where(of_feature("feature", "purchase", "view")).select("event_id", "feature")


def p11_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of each source, nested as a preview in JSON."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").alias("length"))
    first = d.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("place") <= PREVIEWS)
    return first.select("doc_id", F.to_json(F.struct("doc_id", F.struct("source", "lang").alias("origin"), "length")).alias("preview"))


def hypotheses(texts: DataFrame, key: str, order: str, text: str, n: int = HYPOTHESES) -> DataFrame:
    """(key, place, hypothesis) for the keys that have exactly n different texts, the first spelling of each in order. Texts
    are the same if they differ by case and white space only. No key's texts are gathered before all but n are gone."""
    flat = texts.select(key, F.col(order).alias("_o"), collapsed(text).alias("hypothesis"))
    each = flat.groupBy(key, F.lower("hypothesis").alias("_t")).agg(F.min("_o").alias("_o"), F.min_by("hypothesis", "_o").alias("hypothesis"))
    enough = each.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == n).select(key)
    place = F.row_number().over(Window.partitionBy(key).orderBy("_o"))
    return each.join(enough, key, "left_semi").select(key, place.alias("place"), "hypothesis")


def r7_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's answers as hypothetical texts for its first question."""
    return hypotheses(turns(spark, sf_dir), "conv_id", "turn", "answer")


def r15_record_and_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers of cached answers appended to their namespace in two writes; clearing a namespace tells how many it held.
    Namespaces of odd length are cleared: their partitions are written anew without rows."""
    out, told = scratch(spark, "pointers"), scratch(spark, "cleared")
    c = table(spark, sf_dir, "conversations").select(F.md5("text").alias("cache_key"), (F.col("turn") % 2 == 0).alias("early"), F.col("role").alias("namespace"))
    for part in (F.col("early"), ~F.col("early")):
        c.where(part).select("cache_key", "namespace").write.mode("append").partitionBy("namespace").parquet(out)
    held = spark.read.schema("cache_key string, namespace string").parquet(out)
    held.groupBy("namespace").agg(F.count("*").alias("held")).write.parquet(told)
    emptied = scratch(spark, "pointers")
    held.where("length(namespace) % 2 = 0").write.partitionBy("namespace").parquet(emptied)
    left = spark.read.schema("cache_key string, namespace string").parquet(emptied).groupBy("namespace").agg(F.count("*").alias("left"))
    counts = spark.read.schema("namespace string, held long").parquet(told).join(left, "namespace", "left").select("namespace", "held", F.coalesce("left", F.lit(0)).cast("long").alias("left"))
    result = kept(counts, "counts")
    removed(spark, out, told, emptied)
    return result


QUERIES = {f.__name__: f for f in (s12_golden_cases, s13_report, s14_generated, p8_feature_filter, p11_previews, r7_hypotheses, r15_record_and_clear)}

_FLAT = "trim(regexp_replace({0}, '[ \\t\\n\\r]+', ' ', 'g'))"
_TURNS = "t as (select q.conv_id, q.turn, a.text answer from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant')"

ORACLES = {
    "s12_golden_cases": f"select case_id, valid, count(*) over (partition by case_id) times from (select md5(lower({_FLAT.format('text')})) case_id, coalesce({_FLAT.format('text')} <> '', false) valid from benchmark)",
    "s13_report": "select event_type feature, count(*) cases, count(*) filter ((props->>'$.k')::int % 5 = 0) errors, round(avg((props->>'$.k')::int), 4) mean from events group by 1",
    "s14_generated": "select c_custkey::bigint c_custkey, account, ['savings', 'current', 'loan'][((c_custkey + account) % 3 + 1)::int] kind from (select c_custkey, unnest(range(1, c_custkey % 3 + 2)) account from customer)",
    "p8_feature_filter": "select event_id, event_type feature from events where event_type in ('purchase', 'view')",
    "p11_previews": "select doc_id, '{\"doc_id\":' || doc_id || ',\"origin\":{\"source\":\"' || source || '\",\"lang\":\"' || lang || '\"},\"length\":' || length(text) || '}' preview from (select *, row_number() over (partition by source order by doc_id) r from documents) where r <= 5",
    "r7_hypotheses": f"with {_TURNS}, f as (select conv_id, turn, {_FLAT.format('answer')} h from t), e as (select conv_id, lower(h) l, min(turn) o, arg_min(h, turn) hypothesis from f group by 1, 2) select conv_id, (row_number() over (partition by conv_id order by o))::int place, hypothesis from e where conv_id in (select conv_id from e group by 1 having count(*) = 3)",
    "r15_record_and_clear": "select role as namespace, count(*) held, case when length(role) % 2 = 0 then count(*) else 0 end::bigint as left from conversations group by role",
}
