"""Governed analytics over the star schema, history and lifecycle folds, telemetry aggregates, evaluation metrics.

The governed surface is a set of views with an allow-list and masked columns; statements themselves are parsed, planned and
pushed down by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.files import ingested
from tessera.sources.tables import EMAIL, corpus, table, telemetry, texts, turns

MAX_ROWS, MAX_BYTES, WINDOW = 200, 250_000, 1000
#: Conversations of a page of search results.
SEARCH_PAGE = 20
#: Views of the governed schema, their sensitive columns.
SENSITIVE = {"customers": {"c_name"}}


def governed(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view of the governed schema; sensitive columns show *** whatever they are called later."""
    t = lambda name: table(spark, sf_dir, name)
    views = {
        "branches": lambda: t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"),
        "customers": lambda: t("customer"),
        "accounts": lambda: t("orders"),
        "transactions": lambda: t("lineitem"),
    }
    if view not in views:
        raise PermissionError(f"table_not_allowed: {view}")
    out = views[view]()
    for c in SENSITIVE.get(view, set()):
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.lit("***")))
    return out


def nearest_rank(c: Column | str, share: float) -> Column:
    """The value at place min(n - 1, floor(n * share)) of the sorted values."""
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, F.least(F.size(values) - 1, F.floor(F.size(values) * share).cast("int")) + 1)


def last_of(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def q4_revenue_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, b = (governed(spark, sf_dir, v) for v in ("customers", "accounts", "branches"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(b, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"))


def q5_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and accounts joined outright: rows with both sides, without accounts, without a customer, by segment."""
    c, o = governed(spark, sf_dir, "customers"), governed(spark, sf_dir, "accounts")
    both = c.join(o.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "full")
    return both.groupBy("c_mktsegment").agg(F.count_if(F.col("o_orderkey").isNotNull() & F.col("c_custkey").isNotNull()).alias("matched"), F.count_if(F.col("o_orderkey").isNull()).alias("without_account"), F.count_if(F.col("c_custkey").isNull()).alias("without_customer"))


def q5_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of each customer, 0 where there are none."""
    c, o = governed(spark, sf_dir, "customers"), governed(spark, sf_dir, "accounts")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("accounts"))


def q8_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(spark, sf_dir, "accounts").select("o_orderstatus", "o_orderpriority").distinct()


def q11_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 100 of the greatest accounts."""
    o = governed(spark, sf_dir, "accounts")
    return o.orderBy(F.desc_nulls_first("o_totalprice"), "o_orderkey").offset(100).limit(100).select("o_orderkey", "o_totalprice")


def q13_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = governed(spark, sf_dir, "transactions")
    return t.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def q13_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = governed(spark, sf_dir, "transactions")
    return t.groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def q6_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = governed(spark, sf_dir, "transactions").where("l_shipdate <= timestamp '1998-09-02'")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    paid = price * (1 - F.col("l_discount").cast("decimal(18,2)"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.round(F.sum(price).cast("double"), 2).alias("sum_price"), F.round(F.sum(paid).cast("double"), 4).alias("sum_paid"), F.count("*").alias("n"))


def q7_distinct_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = governed(spark, sf_dir, "accounts")
    return o.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers")).where("customers > 1")


def q10_limited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest accounts, within the row limit that every governed statement gets."""
    o = governed(spark, sf_dir, "accounts")
    return o.orderBy(F.desc_nulls_first("o_totalprice"), "o_orderkey").limit(MAX_ROWS).select("o_orderkey", "o_totalprice")


def q12_windowed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = governed(spark, sf_dir, "accounts").groupBy("o_orderstatus", "o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    share = F.col("total").cast("double") / F.sum("total").over(Window.partitionBy("o_orderstatus")).cast("double")
    return o.select("o_orderstatus", "o_orderpriority", F.round(share, 6).alias("share"))


def q13_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = governed(spark, sf_dir, "transactions")
    return t.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


def q14_date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = governed(spark, sf_dir, "accounts")
    recent = o.crossJoin(o.agg(F.max("o_orderdate").alias("latest"))).where("o_orderdate >= latest - interval 1 year")
    return recent.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("n"))


def q17_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a statement over each source's documents in id order returns: MAX_ROWS rows at most, and within MAX_BYTES; the row
    that crosses the budget is dropped whole, its bytes are counted. truncated: whether rows are left over. Only the first
    MAX_ROWS + 1 rows of a source leave a partition."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    by_source = Window.partitionBy("source").orderBy("doc_id")
    fetched = d.withColumn("place", F.row_number().over(by_source)).where(F.col("place") <= MAX_ROWS + 1)
    total = fetched.withColumn("total", F.sum("bytes").over(by_source.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.col("total") <= MAX_BYTES) & (F.col("place") <= MAX_ROWS)
    reached = (F.col("total") - F.col("bytes") <= MAX_BYTES) & (F.col("place") <= MAX_ROWS)
    return total.groupBy("source").agg(F.count_if(inside).alias("rows"), F.coalesce(F.max(F.when(reached, F.col("total"))), F.lit(0)).alias("bytes_returned"), (F.count("*") > F.count_if(inside)).alias("truncated"))


def q19_masked_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = governed(spark, sf_dir, "customers")
    return c.select("c_custkey", F.col("c_name").alias("harmless"), "c_mktsegment")


def i1_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, newest first: the second page of 20."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("place", place).where(F.col("place").between(21, 40)).select("user_id", "place", "event_id")


def i2_conversation_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads, oldest first, as far as 200 turns; titles of 60 characters, cut at a blank."""
    c = table(spark, sf_dir, "conversations")
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    flat = F.trim(F.regexp_replace("question", "[ \\t\\n\\r]+", " "))
    title = F.when(F.length(flat) <= 60, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, 60), " [^ ]*$", ""), F.lit("…")))
    spans = c.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.least(F.count("*"), F.lit(200)).alias("shown"))
    return spans.join(first.select("conv_id", title.alias("title")), "conv_id", "left")


def i3_conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which a user's turn holds a word, each under its first question as title, the most recently touched first;
    the second page of SEARCH_PAGE."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.max(F.when(F.col("text").ilike("%the%"), F.col("turn"))).alias("touched"), F.min_by("text", "turn").alias("first"))
    title = F.substring(F.trim(F.regexp_replace("first", "[ \\t\\n\\r]+", " ")), 1, 60)
    return asked.where("touched is not null").orderBy(F.desc("touched"), "conv_id").offset(SEARCH_PAGE).limit(SEARCH_PAGE).select("conv_id", title.alias("title"), "touched")


def i5_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.event_type", "s.event_id")


def i8_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as examples by text: the first conversation that brings one stays, the last one's turn holds."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.sha2("text", 256).alias("fingerprint"), "conv_id", "turn")
    order = F.struct("conv_id", "turn")
    return q.groupBy("fingerprint").agg(F.min_by("conv_id", order).alias("created_by"), F.max_by("turn", order).alias("turn"), F.count("*").alias("writes"))


def i11_row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which a user's first and last event differ."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    both = e.groupBy("user_id").agg(F.min_by("event_type", order).alias("a"), F.max_by("event_type", order).alias("b"), F.min_by("value", order).alias("c"), F.max_by("value", order).alias("d"))
    stacked = both.select("user_id", F.explode(F.array(F.struct(F.lit("event_type").alias("field"), F.col("a").alias("old"), F.col("b").alias("new")), F.struct(F.lit("value").alias("field"), F.format_string("%.2f", "c").alias("old"), F.format_string("%.2f", "d").alias("new")))).alias("x"))
    return stacked.select("user_id", "x.*").where(~F.col("old").eqNullSafe(F.col("new")))


def i17_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir)
    return d.where("trim(source) <> ''").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("ingestion_status") == "quarantined").alias("pending"), F.min("doc_id").alias("oldest"))


def a1_rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 1000 samples of each feature: percentiles, fallback rate; totals over all samples."""
    t = telemetry(spark, sf_dir)
    recent = last_of(t, "feature", WINDOW, F.desc("ts"), F.desc("event_id")).groupBy("feature").agg(F.count("*").alias("n"), nearest_rank("duration_ms", 0.5).alias("p50"), nearest_rank("duration_ms", 0.95).alias("p95"), F.round(F.avg(F.col("fallback").cast("int")), 6).alias("fallback_rate"))
    return recent.join(t.groupBy("feature").agg(F.sum("k").alias("tokens")), "feature")


def a6_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by grade (a k of 70 or more is correct, below 50 incorrect, between them ambiguous), their shares, and the share
    of corrections, which are all that aren't correct."""
    t, k = telemetry(spark, sf_dir), F.col("k")
    grades = {"correct": k >= 70, "incorrect": k < 50, "ambiguous": k.between(50, 69)}
    counts = t.groupBy("feature").agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in grades.items()])
    rate = lambda c, name: F.round(c / F.col("n"), 6).alias(name)
    return counts.select("feature", *grades, *[rate(F.col(name), f"{name}_rate") for name in grades], rate(F.col("n") - F.col("correct"), "corrected_rate"))


def a8_cache_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up hits if the same user has asked for the same k within 900 seconds before."""
    t = telemetry(spark, sf_dir).withColumn("s", F.unix_timestamp("ts"))
    before = F.lag("s").over(Window.partitionBy("feature", "user_id", "k").orderBy("ts", "event_id"))
    hit = F.coalesce(F.col("s") - F.col("before") <= 900, F.lit(False))
    return t.withColumn("before", before).groupBy("feature").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"))


def a9_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the labels of each source, 3 digits, null without any."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "source").join(l, "doc_id", "left").groupBy("source").agg(F.bround(F.avg("quality"), 3).alias("quality"), F.bround(F.avg("toxic"), 3).alias("toxic"), F.count_if(F.col("toxic") == 1).alias("violations"))


def w6_sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event how many of its user's fall into the 3600 seconds up to it. Events are dealt by user and hour, those of the hour
    before beside them, so that a user with a third of all events fills many tasks."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("s")).withColumn("h", F.floor(F.col("s") / 3600))
    both = e.withColumn("hour", F.explode(F.array("h", F.col("h") + 1)))
    counted = both.withColumn("within_hour", F.count("*").over(Window.partitionBy("user_id", "hour").orderBy("s").rangeBetween(-3600, 0)))
    return counted.where("h = hour").select("event_id", "within_hour")


def u2_report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are attempted but have no label, or no document of their own."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    attempted, scored = b.select("item_id"), b.join(d.select("doc_id"), F.col("item_id") == F.col("doc_id"), "left_semi").select("item_id")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    gone = attempted.exceptAll(labelled.distinct()).withColumn("side", F.lit("unlabelled"))
    return gone.unionByName(attempted.exceptAll(scored).withColumn("side", F.lit("unscored")))


def a5_bypass_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites by feature: why they were left out (k below 20: disabled, from 80 on: too short), tokens, rate of fallbacks."""
    t = telemetry(spark, sf_dir)
    reason = lambda name, c: F.count_if(c).alias(f"bypass_{name}")
    return t.groupBy("feature").agg(F.count("*").alias("n"), reason("disabled", F.col("k") < 20), reason("too_short", F.col("k") >= 80), F.sum("k").alias("tokens"), F.round(F.avg(F.col("fallback").cast("int")), 6).alias("fallback_rate"))


def a7_reflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflection runs, served and shadow apart: iterations are k modulo 3 and 1, accepted from k = 30 on, abstained from 95 on;
    rates of first-pass acceptance, revision, abstention and fallback, mean iterations."""
    t = telemetry(spark, sf_dir).select((F.col("user_id") % 2 == 0).alias("served"), "feature", (F.col("k") % 3 + 1).alias("i"), (F.col("k") >= 30).alias("ok"), (F.col("k") >= 95).alias("abstain"), "fallback")
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    return t.groupBy("served", "feature").agg(F.count("*").alias("n"), rate(F.col("ok") & (F.col("i") <= 1), "first_pass"), rate(F.col("i") > 1, "revised"), rate(F.col("abstain"), "abstained"), rate(F.col("fallback"), "fallback_rate"), F.round(F.avg("i"), 6).alias("mean_iterations"))


def a11_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's features as health checks: ok if none has seen an error, else degraded."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(F.col("event_type") != "error").alias("ok"))
    return e.select("user_id", F.when(F.col("ok"), "ok").otherwise("degraded").alias("status"))


def u1_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that were scored (labels) or skipped (items), each once."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).union(table(spark, sf_dir, "benchmark").select("item_id")).distinct()


def u3_source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents and of embedded documents: what either has alone; empty if a cut-over may go on."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    held = d.join(table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    one, two = d.select("source").distinct(), held.select("source").distinct()
    return one.exceptAll(two).withColumn("only_in", F.lit("documents")).unionByName(two.exceptAll(one).withColumn("only_in", F.lit("embedded")))


def u4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local and web evidence as one table, by origin and host or source."""
    local = table(spark, sf_dir, "documents").select(F.lit("local").alias("origin"), F.col("source").alias("place"))
    web = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1).alias("place"), F.lit("web").alias("origin"))
    return local.unionByName(web).groupBy("origin", "place").agg(F.count("*").alias("n"))


def s1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of 200 words, pages of 5 chunks."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    each = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 200).cast("int"))).alias("chunk"))
    text = F.array_join(F.slice("w", F.col("chunk") * 200 + 1, 200), " ")
    return each.select("doc_id", "chunk", (F.floor(F.col("chunk") / 5) + 1).cast("int").alias("page_number"), F.md5(text).alias("text_md5"))


def s2_ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files by language: found, failed (nothing in them), waiting for approval and served, with their chunks."""
    d = texts(spark, sf_dir).select("lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    mail = F.contains("text", F.lit("@")) & F.col("text").rlike(EMAIL)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return ingested(d, mail).groupBy("lang").agg(F.count("*").alias("discovered"), count("active"), count("quarantined"), count("failed"), F.countDistinct("source").alias("sources"), F.sum("chunks").alias("chunks"))


_ALL = [q4_revenue_by_branch, q5_outer_join, q5_left_join, q6_pricing_summary, q7_distinct_customers, q8_distinct, q10_limited_scan, q11_offset, q12_windowed_share, q13_rollup, q13_cube, q13_grouping_sets, q14_date_arithmetic, q17_byte_budget, q19_masked_projection, i1_history_page, i2_conversation_thread, i3_conversation_search, i5_latest_state, i8_upsert, i11_row_diff, i17_sources, a1_rolling_stats, a5_bypass_reasons, a6_decision_counts, a7_reflection, a8_cache_tiers, a9_label_agreement, a11_health, w6_sliding_count, u1_attempted, u2_report_diff, u3_source_sets, u4_evidence, s1_chunks, s2_ingestion_report]
QUERIES = {f.__name__: f for f in _ALL}

_RANK = "list_sort(list(duration_ms))[least(count(*) - 1, floor(count(*) * {0}))::int + 1]"
_TELEMETRY = "t as (select event_type feature, ts, event_id, user_id, value duration_ms, (props->>'$.k')::int k, (props->>'$.k')::int % 5 = 0 fallback from events)"
_MAIL = r"regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2))"
_FLAT = "trim(regexp_replace(question, '[ \\t\\n\\r]+', ' ', 'g'))"

ORACLES = {
    "q4_revenue_by_branch": "select r_name, n_name, count(*) orders, round(sum(o_totalprice::decimal(18,2))::double, 2) revenue from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    "q5_outer_join": "select c_mktsegment, count(*) filter (o_orderkey is not null and c_custkey is not null) matched, count(*) filter (o_orderkey is null) without_account, count(*) filter (c_custkey is null) without_customer from customer full join (select * from orders where o_orderstatus = 'F') o on o_custkey = c_custkey group by 1",
    "q5_left_join": "select c_custkey, count(o_orderkey) accounts from customer left join orders on o_custkey = c_custkey group by 1",
    "q8_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "q11_offset": "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 100 offset 100",
    "q13_cube": "select l_returnflag, l_linestatus, count(*) n, grouping_id(l_returnflag, l_linestatus)::int as level from lineitem group by cube (l_returnflag, l_linestatus)",
    "q13_grouping_sets": "select l_returnflag, l_linestatus, count(*) n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "q6_pricing_summary": "select l_returnflag, l_linestatus, sum(l_quantity::bigint)::bigint sum_qty, round(sum(l_extendedprice::decimal(18,2))::double, 2) sum_price, round(sum(l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(18,2)))::double, 4) sum_paid, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all",
    "q7_distinct_customers": "select o_orderpriority, count(distinct o_custkey) customers from orders group by 1 having count(distinct o_custkey) > 1",
    "q10_limited_scan": "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 200",
    "q12_windowed_share": "with o as (select o_orderstatus, o_orderpriority, sum(o_totalprice::decimal(18,2)) total from orders group by all) select o_orderstatus, o_orderpriority, round(total::double / sum(total) over (partition by o_orderstatus)::double, 6) as share from o",
    "q13_rollup": "select l_returnflag, l_linestatus, count(*) n, sum(l_quantity::bigint)::bigint qty from lineitem group by rollup (l_returnflag, l_linestatus)",
    "q14_date_arithmetic": "select date_trunc('month', o_orderdate)::date as month, count(*) n from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 1 year group by 1",
    "q17_byte_budget": "with d as (select source, coalesce(strlen(text), 0) b, row_number() over (partition by source order by doc_id) p, sum(coalesce(strlen(text), 0)) over (partition by source order by doc_id) t from documents) select source, count(*) filter (t <= 250000 and p <= 200) as rows, coalesce(max(t) filter (t - b <= 250000 and p <= 200), 0)::bigint bytes_returned, count(*) > count(*) filter (t <= 250000 and p <= 200) truncated from d group by 1",
    "q19_masked_projection": "select c_custkey, '***' harmless, c_mktsegment from customer",
    "i1_history_page": "select user_id, place::int place, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) place from events) where place between 21 and 40",
    "i2_conversation_thread": f"with f as (select conv_id, arg_min(text, turn) question from conversations where role = 'user' group by 1), s as (select conv_id, min(turn) first_turn, max(turn) last_turn, least(count(*), 200) shown from conversations group by 1) select conv_id, first_turn, last_turn, shown, case when length({_FLAT}) <= 60 then {_FLAT} else regexp_replace(substring({_FLAT}, 1, 60), ' [^ ]*$', '') || '…' end title from s left join f using (conv_id)",
    "i3_conversation_search": "with f as (select conv_id, max(turn) filter (text ilike '%the%') touched, arg_min(text, turn) first from conversations where role = 'user' group by 1) select conv_id, substring(trim(regexp_replace(first, '[ \\t\\n\\r]+', ' ', 'g')), 1, 60) title, touched from f where touched is not null order by touched desc, conv_id limit 20 offset 20",
    "i5_latest_state": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1",
    "i8_upsert": "select sha256(text) fingerprint, arg_min(conv_id, conv_id * 1000000 + turn) created_by, arg_max(turn, conv_id * 1000000 + turn) turn, count(*) writes from conversations where role = 'user' group by 1",
    "i11_row_diff": "with b as (select user_id, first(event_type order by ts, event_id) a, last(event_type order by ts, event_id) b, first(value order by ts, event_id) c, last(value order by ts, event_id) d from events group by 1), s as (select user_id, 'event_type' field, a old, b new from b union all select user_id, 'value', printf('%.2f', c), printf('%.2f', d) from b) select * from s where old is distinct from new",
    "i17_sources": f"select source, count(*) documents, count(*) filter ({_MAIL}) pending, min(doc_id) oldest from documents where trim(source) <> '' group by 1",
    "a1_rolling_stats": f"with {_TELEMETRY}, r as (select * from (select *, row_number() over (partition by feature order by ts desc, event_id desc) n from t) where n <= 1000) select feature, count(*) n, {_RANK.format(0.5)} p50, {_RANK.format(0.95)} p95, round(avg(fallback::int), 6) fallback_rate, any_value(tokens)::bigint tokens from r join (select feature, sum(k) tokens from t group by 1) using (feature) group by feature",
    "a6_decision_counts": f"with {_TELEMETRY}, c as (select feature, count(*) n, count(*) filter (k >= 70) correct, count(*) filter (k < 50) incorrect, count(*) filter (k between 50 and 69) ambiguous from t group by 1) select feature, correct, incorrect, ambiguous, round(correct / n, 6) correct_rate, round(incorrect / n, 6) incorrect_rate, round(ambiguous / n, 6) ambiguous_rate, round(1 - correct / n, 6) corrected_rate from c",
    "a8_cache_tiers": f"with {_TELEMETRY}, h as (select feature, coalesce(epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) over (partition by feature, user_id, k order by ts, event_id) <= 900, false) hit from t) select feature, count(*) filter (hit) hits, count(*) filter (not hit) misses, round(avg(hit::int), 6) hit_rate from h group by 1",
    "a9_label_agreement": "select source, round_even(avg(quality), 3) quality, round_even(avg(toxic), 3) toxic, count(*) filter (toxic = 1) violations from documents left join labels using (doc_id) group by 1",
    "w6_sliding_count": "select event_id, count(*) over (partition by user_id order by s range between 3600 preceding and current row) within_hour from (select *, epoch(date_trunc('second', ts))::bigint s from events)",
    "u2_report_diff": "select item_id, 'unlabelled' side from benchmark where item_id not in (select doc_id from labels) union all select item_id, 'unscored' from benchmark where item_id not in (select doc_id from documents)",
    "a5_bypass_reasons": f"with {_TELEMETRY} select feature, count(*) n, count(*) filter (k < 20) bypass_disabled, count(*) filter (k >= 80) bypass_too_short, sum(k)::bigint tokens, round(avg(fallback::int), 6) fallback_rate from t group by 1",
    "a7_reflection": f"with {_TELEMETRY} select user_id % 2 = 0 served, feature, count(*) n, round(avg((k >= 30 and k % 3 = 0)::int), 6) first_pass, round(avg((k % 3 > 0)::int), 6) revised, round(avg((k >= 95)::int), 6) abstained, round(avg(fallback::int), 6) fallback_rate, round(avg(k % 3 + 1), 6) mean_iterations from t group by all",
    "a11_health": "select user_id, case when bool_or(event_type = 'error') then 'degraded' else 'ok' end status from events group by 1",
    "u1_attempted": "select doc_id id from labels union select item_id from benchmark",
    "u3_source_sets": "with h as (select distinct source from documents where doc_id in (select vec_id from embeddings where label is not null)) select distinct source, 'documents' only_in from documents where source not in (select source from h) union all select source, 'embedded' from h where source not in (select source from documents)",
    "u4_evidence": "select origin, place, count(*) n from (select 'local' origin, source place from documents union all select 'web', regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) from pages) group by all",
    "s1_chunks": "with d as (select doc_id, string_split(text, ' ') w from documents), c as (select doc_id, w, unnest(range(((len(w) - 1) // 200) + 1))::int as chunk from d) select doc_id, chunk, (chunk // 5 + 1)::int page_number, md5(array_to_string(w[chunk * 200 + 1 : chunk * 200 + 200], ' ')) text_md5 from c",
    "s2_ingestion_report": f"with d as (select *, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') = '' bad from documents) select lang, count(*) discovered, count(*) filter (not bad and not {_MAIL}) active, count(*) filter (not bad and {_MAIL}) quarantined, count(*) filter (bad) failed, count(distinct source) sources, coalesce(sum(((len(string_split(text, ' ')) + 199) // 200)) filter (not bad), 0)::bigint chunks from d group by 1",
}
