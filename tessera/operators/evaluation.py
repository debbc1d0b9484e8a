"""Evaluation metrics, cohort planning, and corpus maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.answers import FORBIDDEN
from tessera.functions.text import PATTERNS, holds, sql_holds
from tessera.operators.retrieval import bm25
from tessera.sources.shared import kept, released, scratch
from tessera.sources.tables import corpus, table, telemetry, texts
from tessera.sources.versions import VersionedTable

#: Documents of a page of a scroll, and those before it.
SCROLL, SCROLL_FROM = 50, 10


def _lines(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key), F.explode(F.split("text", "\n")).alias("line"))


def goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id): documents that share a line of five words or more with an item. Lines of documents meet those of items
    as they are read; only what they share is made distinct, so that the corpus isn't shuffled."""
    asked = _lines(table(spark, sf_dir, "benchmark"), "item_id").where(F.size(F.split("line", " ")) >= 5).distinct()
    return asked.join(_lines(table(spark, sf_dir, "documents"), "doc_id"), "line").select("item_id", "doc_id").distinct()


def f21_retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item with goldens: whether BM25's first 20 hold one, the reciprocal rank of the first, the share found."""
    return _quality(spark, sf_dir, goldens(spark, sf_dir))


def _quality(spark: SparkSession, sf_dir: str, golden: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = bm25(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), docs, 20)
    joined = golden.join(found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank"), ["item_id", "doc_id"], "left")
    ranks = joined.groupBy("item_id").agg(F.count("*").alias("golden"), F.count("rank").alias("hits"), F.min("rank").alias("first"))
    return ranks.select("item_id", "golden", (F.col("hits") > 0).alias("hit"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.col("hits") / F.col("golden"), 6).alias("recall"))


def f20_source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item with goldens: how many of their sources BM25's first 20 bring, the share, whether any."""
    d = table(spark, sf_dir, "documents")
    source = d.select("doc_id", "source")
    found = bm25(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), d.select(F.col("doc_id").alias("id"), "text"), 20)
    wanted = goldens(spark, sf_dir).join(source, "doc_id").select("item_id", "source").distinct()
    actual = found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id")).join(source, "doc_id").select("item_id", "source").distinct().withColumn("hit", F.lit(1))
    each = wanted.join(actual, ["item_id", "source"], "left").groupBy("item_id").agg(F.count("*").alias("golden"), F.count("hit").alias("matched"))
    return each.select("item_id", "golden", "matched", F.round(F.col("matched") / F.col("golden"), 6).alias("ratio"), (F.col("matched") > 0).alias("passed"))


def d11_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by feature and reason: errors are an emergency, signups are disabled, others by 25 percent roll-out."""
    e = telemetry(spark, sf_dir)
    digest = F.sha2(F.concat(F.lit("hyde:v1\0"), F.col("user_id").cast("string")), 256)
    inside = (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % 10000) < 2500
    reason = F.when(F.col("feature") == "signup", "disabled").when(F.col("feature") == "error", "emergency").when(inside, "treatment").otherwise("control")
    return e.groupBy("feature", reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def d13_cacheable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that may be cached: no fallback, not an error, grade 50 or more."""
    t = telemetry(spark, sf_dir)
    ok = ~F.col("fallback") & (F.col("feature") != "error") & (F.col("k") >= 50)
    return t.groupBy("feature").agg(F.count_if(ok).alias("cacheable"), F.count_if(~ok).alias("refused"))


def i15_stale_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks without a later purchase of the same user, older than 5 minutes at the table's end, are failed. A user's last purchase
    is one row: no user's events meet in one task."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.struct("ts", "event_id").alias("at"))
    bought = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("at").alias("bought"))
    open_ones = e.where("event_type = 'click'").join(bought, "user_id", "left").where("bought is null or bought < at")
    stale = F.col("ts") < F.col("latest") - F.expr("interval 5 minutes")
    return open_ones.crossJoin(e.agg(F.max("ts").alias("latest"))).groupBy(F.when(stale, "failed").otherwise("executing").alias("state")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def a9_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on all benchmark cases: how many, skipped ones (nothing to find), those that failed (no text), hit rate and mean reciprocal
    rank to 3 digits over the scored ones (null without any), and cases whose goldens hold a forbidden word."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").isNull().alias("broken"))
    golden = kept(goldens(spark, sf_dir), "goldens")
    scored = kept(_quality(spark, sf_dir, golden), "scored")
    held = texts(spark, sf_dir).where(F.exists(F.array(*[F.lit(x.lower()) for x in FORBIDDEN]), lambda x: F.contains(F.lower("text"), x))).select("doc_id")
    bad = golden.join(held, "doc_id", "left_semi").select("item_id", F.lit(True).alias("violates")).distinct()
    rows = items.join(scored, "item_id", "left").join(bad, "item_id", "left")
    mean = lambda c, name: F.bround(F.avg(c), 3).alias(name)
    out = kept(rows.agg(F.count("*").alias("cases"), F.count_if(F.col("golden").isNull() & ~F.col("broken")).alias("skipped"), F.count_if("broken").alias("errors"), mean(F.col("hit").cast("int"), "hit_rate"), mean(F.col("reciprocal_rank"), "mrr"), F.count_if("violates").alias("violations")), "report")
    released(scored, golden)
    return out


def s5_delete_and_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written corpus from which the largest source is deleted, and in which the quarantined documents of the smallest are
    approved (S5, S6): what the table holds afterwards. Only the parts of these two sources are written anew."""
    d = corpus(spark, sf_dir).select("doc_id", "source", "ingestion_status")
    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    edges = sizes.agg(F.max_by("source", F.struct("n", "source")).alias("gone"), F.min_by("source", F.struct("n", "source")).alias("approved")).first()
    chunks = VersionedTable(spark, scratch(spark, "corpus"), "source")
    chunks.create(d)
    chunks.delete(F.col("source") == edges["gone"])
    chunks.update((F.col("source") == edges["approved"]) & (F.col("ingestion_status") == "quarantined"), {"ingestion_status": F.lit("active")})
    held = kept(chunks.read().groupBy("source", "ingestion_status").agg(F.count("*").alias("n")), "held")
    chunks.drop()
    return held


def s4_bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scroll over the active documents of each source: SCROLL of them in order of id, from the id that the last page ended
    with (here the source's tenth) on."""
    active = corpus(spark, sf_dir).where("ingestion_status = 'active'").select("source", "doc_id")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    # a rank bounded by a filter: each task keeps so many rows of a source before they shuffle
    return active.withColumn("place", place).where((F.col("place") > SCROLL_FROM) & (F.col("place") <= SCROLL_FROM + SCROLL)).select("source", "doc_id", "place")


def s15_cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates to replace the served corpus: the embedded documents, then all documents with backfilled status. One is
    swapped in only if it holds all documents of each source; what is served after each."""
    d = corpus(spark, sf_dir).select("doc_id", "source", "ingestion_status")
    serving = VersionedTable(spark, scratch(spark, "serving"), "doc_id")
    serving.create(d.withColumn("ingestion_status", F.lit(None).cast("string")))
    want = kept(d.groupBy("source").agg(F.count("*").alias("n")), "want")

    def whole(candidate: DataFrame) -> bool:
        return want.join(candidate.groupBy("source").agg(F.count("*").alias("m")), "source", "full").where("n is distinct from m").isEmpty()

    embedded = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    after = None
    for step, candidate in enumerate((embedded, d), 1):
        swapped = serving.swap(candidate, whole)
        told = serving.read().groupBy("source", F.coalesce("ingestion_status", F.lit("none")).alias("ingestion_status")).agg(F.count("*").alias("n"))
        told = told.select(F.lit(step).alias("step"), F.lit(swapped).alias("swapped"), "source", "ingestion_status", "n")
        after = told if after is None else after.unionByName(told)  # each reads the version that was current then
    out = kept(after, "served")
    serving.drop()
    released(want)
    return out


def s15_cutover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each source in documents and in the embedded corpus; a source may be cut over if they agree."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    held = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    counts = d.groupBy("source").agg(F.count("*").alias("documents")).join(held.groupBy("source").agg(F.count("*").alias("embedded")), "source", "left")
    return counts.select("source", "documents", F.coalesce("embedded", F.lit(0)).alias("embedded"), F.coalesce(F.col("documents") == F.col("embedded"), F.lit(False)).alias("complete"))


def a13_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal data and secrets in each source's documents, sorted."""
    d = table(spark, sf_dir, "documents")
    kinds = sorted(PATTERNS)
    found = d.groupBy("source").agg(*[F.bool_or(holds("text", k)).alias(k) for k in kinds])
    return found.select("source", F.array_join(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds])), ",").alias("categories"))


def f25_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("n"), F.min(F.date_trunc("week", "o_orderdate")).cast("date").alias("first_week"), F.max(F.dayofyear("o_orderdate")).alias("last_day"))


_ALL = [a9_evaluation_report, f20_source_overlap, f21_retrieval_quality, d11_cohorts, d13_cacheable, i15_stale_reclaim, s4_bounded_scan, s5_delete_and_approve, s15_cutover, s15_cutover_check, a13_categories, f25_date_parts]
QUERIES = {f.__name__: f for f in _ALL}

_T = "t as (select event_type feature, user_id, (props->>'$.k')::int k, (props->>'$.k')::int % 5 = 0 fallback from events)"
_MAIL = "regexp_matches(text, '" + PATTERNS["email"] + "')"
_BM = """asked as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from benchmark),
post as (select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) dl, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from documents),
tf as (select term, doc_id, dl, count(*) tf from post where term in (select term from asked) group by all), df as (select term, count(*) df from tf group by all),
w as (select term, doc_id, ln(((select count(*) from documents) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 256)) w from tf join df using (term)),
bm as (select item_id, doc_id, round(sum(w), 6) score from asked join w using (term) group by all), top as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from bm)"""
_LINES = "select distinct {0}, line from (select {0}, unnest(string_split(text, chr(10))) line from {1}) where len(string_split(line, ' ')) >= 5"

ORACLES = {
    "f20_source_overlap": f"with {_BM}, g as (select distinct item_id, doc_id from ({_LINES.format('item_id', 'benchmark')}) join ({_LINES.format('doc_id', 'documents')}) using (line)), wanted as (select distinct item_id, source from g join documents using (doc_id)), found as (select distinct item_id, source, 1 hit from top join documents using (doc_id) where rank <= 20) select item_id, count(*) golden, count(hit) matched, round(count(hit) / count(*), 6)::double ratio, count(hit) > 0 passed from wanted left join found using (item_id, source) group by 1",
    "f21_retrieval_quality": f"with {_BM}, g as (select distinct item_id, doc_id from ({_LINES.format('item_id', 'benchmark')}) join ({_LINES.format('doc_id', 'documents')}) using (line)) select item_id, count(*) golden, count(rank) > 0 hit, round(coalesce(1.0 / min(rank), 0), 6)::double reciprocal_rank, round(count(rank) / count(*), 6)::double recall from g left join (select * from top where rank <= 20) using (item_id, doc_id) group by 1",
    "d11_cohorts": f"with {_T} select feature, case when feature = 'signup' then 'disabled' when feature = 'error' then 'emergency' when ('0x' || substr(sha256('hyde:v1' || chr(0) || user_id::varchar), 1, 16))::ubigint % 10000 < 2500 then 'treatment' else 'control' end reason, count(*) n, count(distinct user_id) users from t group by all",
    "d13_cacheable": f"with {_T}, x as (select feature, not fallback and feature <> 'error' and k >= 50 ok from t) select feature, count(*) filter (ok) cacheable, count(*) filter (not ok) refused from x group by 1",
    "i15_stale_reclaim": "with e as (select *, max(case when event_type = 'purchase' then 1 end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) later from events) select case when ts < (select max(ts) from events) - interval 5 minutes then 'failed' else 'executing' end state, count(*) n, count(distinct user_id) users from e where event_type = 'click' and later is null group by 1",
    "s5_delete_and_approve": f"with s as (select source, count(*) n from documents group by 1), g as (select (select source from s order by n desc, source desc limit 1) gone, (select source from s order by n, source limit 1) approved) select source, case when source = approved or not {_MAIL} then 'active' else 'quarantined' end ingestion_status, count(*) n from documents, g where source <> gone group by all",
    "s4_bounded_scan": f"select source, doc_id, place::int place from (select source, doc_id, row_number() over (partition by source order by doc_id) place from documents where not {_MAIL}) where place between 11 and 60",
    "s15_cutover": f"with d as (select source, case when {_MAIL} then 'quarantined' else 'active' end s, doc_id in (select vec_id from embeddings) held from documents), a as (select bool_and(held) ok from d) select 1 as step, ok swapped, source, case when ok then s else 'none' end ingestion_status, count(*) n from d, a group by all union all select 2, true, source, s, count(*) from d group by all",
    "s15_cutover_check": "select source, count(*) documents, count(v) embedded, count(*) = count(v) complete from documents left join (select distinct vec_id v from embeddings) on v = doc_id group by 1",
    "a13_categories": "select source, concat_ws(',', " + ", ".join(f"case when bool_or({sql_holds('text', k)}) then '{k}' end" for k in sorted(PATTERNS)) + ") categories from documents group by 1",
    "f25_date_parts": "select year(o_orderdate)::int y, quarter(o_orderdate)::int q, count(*) n, min(date_trunc('week', o_orderdate))::date first_week, max(dayofyear(o_orderdate))::int last_day from orders group by all",
}
_FORBIDDEN = " or ".join(f"contains(lower(text), '{x.lower()}')" for x in FORBIDDEN)
_LINES = "list_filter(string_split(text, chr(10)), lambda x: len(string_split(x, ' ')) >= 5)"
ORACLES["a9_evaluation_report"] = f"""with s as ({ORACLES["f21_retrieval_quality"]}), l as (select doc_id, unnest({_LINES}) line from documents where {_FORBIDDEN}), g as (select distinct item_id from (select item_id, unnest({_LINES}) line from benchmark) join l using (line))
select count(*) cases, count(*) filter (golden is null and text is not null) skipped, count(*) filter (text is null) errors, round_even(avg(hit::int), 3) hit_rate, round_even(avg(reciprocal_rank), 3) mrr, count(g.item_id) violations from benchmark left join s using (item_id) left join g using (item_id)"""
