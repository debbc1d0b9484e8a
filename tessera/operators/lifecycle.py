"""State that events bring about: proposals and documents through their lifecycles, queues, partial updates, versions, caches;
and the sinks that such state is written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.guardrails import decided
from tessera.functions.text import collapsed, findings, sql_findings
from tessera.operators.vector_index import knn
from tessera.sources.shared import kept, released, removed, scratch
from tessera.sources.tables import EMAIL, corpus, table, telemetry
from tessera.sources.versions import Conflict, VersionedTable

#: A proposal expires after, an execution is given up after (seconds); rows of the pending queue; seconds that
#: each cache tier keeps its entries; the least confidence of a route to SQL.
EXPIRES, GIVEN_UP, PENDING = 300, 300, 50
TTL = {"emb": 604_800, "rag": 3_600, "sql_gen": 86_400, "sql_result": 900, "intent": 86_400}
SQL_CONFIDENCE = 0.90


def proposals(e: DataFrame) -> DataFrame:
    """(user_id, event_id, state) of each proposal in events(user_id, ts, event_id, event_type). A signup or view proposes; what
    a user does until the next proposal acts on it, in order of (ts, event_id):

    proposed: a click in time approves (executing), a late one finds it expired, an error rejects it; executing: a purchase
    ends it executed, an error failed, and without either it is failed once GIVEN_UP seconds older than the last event of
    the table. Other events, and those on a state that has ended, change nothing."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = F.col("event_type").isin("signup", "view")
    numbered = e.withColumn("place", F.row_number().over(by_user)).withColumn("proposal", F.count_if(opens).over(by_user.rowsBetween(Window.unboundedPreceding, 0))).where("proposal > 0")
    one = Window.partitionBy("user_id", "proposal")
    first = numbered.withColumn("decision", F.min(F.when(F.col("event_type").isin("click", "error"), F.struct("place", "event_type", "ts"))).over(one))
    ends = F.col("event_type").isin("purchase", "error") & (F.col("place") > F.col("decision.place"))
    each = first.groupBy("user_id", "proposal").agg(F.min_by("event_id", "place").alias("event_id"), F.min("ts").alias("opened"), F.first("decision").alias("decision"), F.min(F.when(ends, F.struct("place", "event_type"))).alias("end"))
    each = each.join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    seconds = lambda a, b: F.unix_micros(b) - F.unix_micros(a)
    late = seconds(F.col("opened"), F.col("decision.ts")) >= EXPIRES * 1_000_000
    running = F.when(F.col("end.event_type") == "purchase", "executed").when(F.col("end.event_type") == "error", "failed").when(seconds(F.col("decision.ts"), F.col("now")) > GIVEN_UP * 1_000_000, "failed").otherwise("executing")
    state = F.when(F.col("decision").isNull(), "proposed").when(F.col("decision.event_type") == "error", "rejected").when(late, "expired").otherwise(running)
    return each.select("user_id", "event_id", state.alias("state"))


def d16_proposal_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return proposals(e)


def claimed(table: VersionedTable, requests: DataFrame, owner: str, base: int | None = None) -> DataFrame:
    """(id, outcome) of requests(id, user_id, at) for proposals in a table (id, user_id, created, state, claimed_by): executing,
    proposal_expired, proposal_already_consumed, or not_found for an id that isn't there or is somebody else's.

    The decision is made on one version and committed on top of it. Where another claimant has committed meanwhile, it is made
    again on what that one has left, so each proposal is executed once. base: a version read before, for a first try."""
    asked = kept(requests.groupBy("id").agg(F.min_by(F.struct("user_id", "at"), "at").alias("r")).select("id", "r.*"), "asked")
    while True:
        base = table.version() if base is None else base
        held = table.read(base).select("id", F.col("user_id").alias("owner"), "created", "state")
        late = F.unix_micros("at") - F.unix_micros("created") >= EXPIRES * 1_000_000
        own = F.col("owner") == F.col("user_id")
        outcome = F.when(~F.coalesce(own, F.lit(False)), "not_found").when(F.col("state") != "proposed", "proposal_already_consumed").when(late, "proposal_expired").otherwise("executing")
        told = kept(asked.join(held, "id", "left").select("id", outcome.alias("outcome")), "told")
        won = told.where("outcome in ('executing', 'proposal_expired')").select("id", F.when(F.col("outcome") == "executing", "executing").otherwise("expired").alias("now"))

        def applied(df: DataFrame, won: DataFrame = won) -> DataFrame:
            j = df.join(won, "id", "left")
            return j.withColumns({"state": F.coalesce("now", "state"), "claimed_by": F.when(F.col("now") == "executing", owner).otherwise(F.col("claimed_by"))}).drop("now")

        try:
            table.merge(won.select("id"), applied, base)
            released(asked)
            return told
        except Conflict:
            released(told)
            base = None


def i14_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and views as proposals, claimed by the user's next event if it is a click. Two claimants decide on the same version: one
    asks for clicks from 6 o'clock on and commits, the other asks for those before 12, finds its version gone, and decides again.
    Outcomes for both, and the states that the table ends in."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    after = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select("event_id", "user_id", "event_type", "ts", F.lead("event_type").over(after).alias("then"), F.lead("ts").over(after).alias("at"))
    p = kept(e.where("event_type in ('signup', 'view')").select(F.col("event_id").alias("id"), "user_id", "ts", "then", "at"), "proposals")
    proposals = VersionedTable(spark, scratch(spark, "claims"), "id")
    proposals.create(p.select("id", "user_id", F.col("ts").alias("created"), F.lit("proposed").alias("state"), F.lit(None).cast("string").alias("claimed_by")))
    clicks = p.where("then = 'click'").select("id", "user_id", "at")
    base = proposals.version()
    late = claimed(proposals, clicks.where("hour(at) >= 6"), "late", base)
    early = claimed(proposals, clicks.where("hour(at) < 12"), "early", base)
    states = proposals.read().select(F.coalesce("claimed_by", F.lit("none")).alias("who"), "state")
    tell = lambda df, who: df.select(F.lit(who).alias("who"), F.concat(F.lit("outcome "), "outcome").alias("state"))
    out = kept(states.unionByName(tell(late, "late")).unionByName(tell(early, "early")).groupBy("who", "state").agg(F.count("*").alias("n")), "claims")
    proposals.drop()
    released(p, late, early)
    return out


def d15_document_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads: the scan passes or fails them; a decision (labels: good quality approves, bad rejects) moves those that wait for
    one. Failed uploads lose their chunks and can't be approved; passed ones stay quarantined until approved."""
    d = table(spark, sf_dir, "documents").select("doc_id", (decided(findings("text"), redacts=False)["action"] == "block").alias("failed"))
    wish = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("wish"))
    j = d.join(wish, "doc_id", "left")
    failed, wanted = F.col("failed"), F.coalesce("wish", F.lit("none"))
    state = F.when(wanted == "reject", "rejected").when(failed, "scan_failed").when(wanted == "approve", "active").otherwise("scan_passed")
    chunks = F.when(state.isin("rejected", "scan_failed"), "deleted").when(state == "active", "active").otherwise("quarantined")
    refused = failed & (wanted == "approve")
    return j.groupBy(state.alias("state"), chunks.alias("chunks"), refused.alias("refused")).agg(F.count("*").alias("n"))


def i6_pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest documents that wait for approval."""
    return corpus(spark, sf_dir).where("ingestion_status = 'quarantined'").orderBy("doc_id").limit(PENDING).select("doc_id", "source")


def i9_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of events inserted among the customers' keys: existing keys stay as they are."""
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().join(have, "id", "left_anti").withColumn("origin", F.lit("event"))
    return have.unionByName(new)


def i10_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a patch for the labelled ones: what the patch leaves null stays."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    patch = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.when(F.max("toxic") == 1, "toxic").alias("p_lang"), F.when(F.max("quality") == 0, "low").alias("p_source"))
    return d.join(patch, "doc_id", "left").select("doc_id", F.coalesce("p_lang", "lang").alias("lang"), F.coalesce("p_source", "source").alias("source"))


def i12_state_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event; errors carry the time at which they took effect, others none."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("s"))
    return e.select("user_id", F.col("s.event_type").alias("state"), F.when(F.col("s.event_type") == "error", F.col("s.ts")).alias("stamped_at"))


def i13_counter_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions from 1, one more for each purchase of a user."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") + 1).alias("version"))


def d17_version_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views write cache entries under the user's version at that time; only those of the last version, written after the user's last
    purchase, can be reached. That purchase is one row a user: no user's events meet in one task."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    bump = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("at").alias("bumped"))
    views = e.where("event_type = 'view'").join(bump, "user_id", "left")
    live = F.col("bumped").isNull() | (F.col("at") > F.col("bumped"))
    return views.groupBy("user_id").agg(F.count_if(live).alias("reachable"), F.count_if(~live).alias("stale"))


def p5_owner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for events by number and owner: every third names the true owner, the others the next user; what isn't owned
    isn't found."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    asked = e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"))
    found = asked.join(e.withColumn("found", F.lit(True)), ["event_id", "user_id"], "left")
    return found.groupBy("user_id").agg(F.count("found").alias("found"), F.count_if(F.col("found").isNull()).alias("not_found"))


def p9_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query's 20 nearest vectors the first 3 that support it (good quality) with a relevance of 0.5 or more."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = knn(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 20)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    fit = found.where("score >= 0.5").join(good, "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return fit.withColumn("place", place).where("place <= 3").select("query_id", "place", "id")


def d12_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router output (type: intent, k: confidence in percent) by route: SQL and hybrid below SQL_CONFIDENCE are rejected."""
    t = telemetry(spark, sf_dir)
    intent = F.when(F.col("feature") == "purchase", "sql").when(F.col("feature") == "click", "hybrid").otherwise("rag")
    unsure = intent.isin("sql", "hybrid") & (F.col("k") / 100 < SQL_CONFIDENCE)
    return t.groupBy(intent.alias("intent"), F.when(unsure, "reject:uncertain_sql_intent").otherwise(intent).alias("route")).agg(F.count("*").alias("n"))


def d14_config_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations out of samples (percentage k + 10, threshold value / 500, version k modulo 3, enabled fallback) by the
    invariants they break: percentage 0-100, threshold 0-1, version 1 or more, enabled needs a percentage above 50."""
    t = telemetry(spark, sf_dir).select((F.col("k") + 10).alias("percentage"), (F.col("duration_ms") / 500).alias("threshold"), (F.col("k") % 3).alias("version"), F.col("fallback").alias("enabled"))
    rules = {"percentage_range": ~F.col("percentage").between(0, 100), "threshold_range": ~F.col("threshold").between(0, 1), "version_range": F.col("version") < 1, "enabled_implies_percentage": F.col("enabled") & (F.col("percentage") <= 50)}
    broken = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), ",")
    return t.groupBy(broken.alias("broken")).agg(F.count("*").alias("n"))


def s3_upsert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table partitioned by source: all sources appended as quarantined, then about half of them written anew
    as active, which replaces their partitions only. What the table holds afterwards."""
    out = scratch(spark, "chunks")
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"), "source")
    d.withColumn("ingestion_status", F.lit("quarantined")).write.mode("append").partitionBy("source").parquet(out)
    again = d.where("crc32(source) % 2 = 0").withColumn("ingestion_status", F.lit("active"))
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(out)
    held = spark.read.schema("doc_id long, text_md5 string, ingestion_status string, source string").parquet(out)
    told = kept(held.groupBy("source", "ingestion_status").agg(F.count("*").alias("n"), F.countDistinct("text_md5").alias("texts")), "told")
    removed(spark, out)
    return told


def s7_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written before there was a status (unlabelled documents) become active; the others keep theirs."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "active").otherwise("quarantined").alias("ingestion_status")), "doc_id", "left")
    return d.na.fill("active", ["ingestion_status"]).groupBy("ingestion_status").agg(F.count("*").alias("n"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache writes (tier, key, value, set_at): the last of a key holds."""
    tiers = F.array(*[F.lit(x) for x in TTL])
    e = telemetry(spark, sf_dir).withColumn("tier", F.element_at(tiers, (F.col("user_id") % len(TTL) + 1).cast("int")))
    key = F.concat_ws(":", "tier", "feature", F.col("k").cast("string"))
    return e.groupBy("tier", key.alias("key")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("set_at"))


def s9_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and expired entries of each tier at the end of the table, after all keys of views in the tier rag were deleted by
    their prefix."""
    c = _cache(spark, sf_dir).where(~F.col("key").startswith("rag:view"))
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    ttl = F.element_at(F.create_map(*[x for t, s in TTL.items() for x in (F.lit(t), F.lit(s))]), F.col("tier"))
    live = F.unix_micros(F.col("set_at").cast("timestamp")) + ttl.cast("long") * 1_000_000 > F.unix_micros(F.col("now").cast("timestamp"))
    return c.join(F.broadcast(now)).groupBy("tier").agg(F.count_if(live).alias("live"), F.count_if(~live).alias("expired"))


def s11_recorded_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as queries against recorded ones (first turns): equal apart from case and white space; 0 without one."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("key", F.lower(collapsed("text")))
    first = c.groupBy("conv_id").agg(F.min_by("key", "turn").alias("key"))
    recorded = first.groupBy("key").agg(F.count("*").alias("recorded"))
    return c.join(recorded, "key", "left").select("conv_id", "turn", F.coalesce("recorded", F.lit(0)).cast("long").alias("recorded"))


QUERIES = {f.__name__: f for f in (d16_proposal_lifecycle, i14_claims, d15_document_lifecycle, i6_pending_queue, i9_insert_if_absent, i10_partial_update, i12_state_stamp, i13_counter_bump, d17_version_invalidation, p5_owner_filter, p9_graded, d12_route, d14_config_invariants, s3_upsert_sink, s7_backfill, s9_ttl_cache, s11_recorded_fixture)}

_K = "t as (select event_type feature, ts, event_id, user_id, value duration_ms, (props->>'$.k')::int k, (props->>'$.k')::int % 5 = 0 fallback from events)"
_FLAT = "trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))"
_COS = "round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 9)"

ORACLES = {
    # a fold over each user's events: the state machine itself, not the windows of the query
    "d16_proposal_lifecycle": """with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) p, max(ts) over () now from events),
f as (select user_id, p, null::bigint proposal, null::timestamp opened, null::timestamp approved, null::varchar state, now from e where false union all
select user_id, 0, null, null, null, null, max(now) from e group by user_id union all
select f.user_id, f.p + 1, case when e.event_type in ('signup', 'view') then e.event_id else proposal end, case when e.event_type in ('signup', 'view') then e.ts else opened end, case when state = 'proposed' and e.event_type = 'click' then e.ts else approved end,
case when e.event_type in ('signup', 'view') then 'proposed' when state = 'proposed' and e.event_type = 'click' then case when e.ts - opened >= interval 300 seconds then 'expired' else 'executing' end when state = 'proposed' and e.event_type = 'error' then 'rejected' when state = 'executing' and e.event_type = 'purchase' then 'executed' when state = 'executing' and e.event_type = 'error' then 'failed' else state end, f.now
from f join e on e.user_id = f.user_id and e.p = f.p + 1),
l as (select *, row_number() over (partition by proposal order by p desc) r from f where proposal is not null)
select user_id, proposal event_id, case when state = 'executing' and now - approved > interval 300 seconds then 'failed' else state end as state from l where r = 1""",
    "i14_claims": """with e as (select *, lead(event_type) over w nxt, lead(ts) over w at_ from events window w as (partition by user_id order by ts, event_id)), p as (select *, nxt = 'click' asked, hour(at_) h, epoch_us(at_) - epoch_us(ts) >= 300000000 too_late from e where event_type in ('signup', 'view')),
s as (select case when not coalesce(asked, false) then 'none' when too_late then 'none' when h >= 6 then 'late' else 'early' end who, case when not coalesce(asked, false) then 'proposed' when too_late then 'expired' else 'executing' end as state from p
union all select 'late', 'outcome ' || case when too_late then 'proposal_expired' else 'executing' end from p where asked and h >= 6 union all select 'early', 'outcome ' || case when h >= 6 then 'proposal_already_consumed' when too_late then 'proposal_expired' else 'executing' end from p where asked and h < 12)
select who, state, count(*) n from s group by all""",
    "d15_document_lifecycle": f"with j as (select list_contains({sql_findings('text')}, 'credential_shaped_token') bad, quality from documents left join labels using (doc_id)), s as (select *, case when quality <> 1 then 'rejected' when bad then 'scan_failed' when quality = 1 then 'active' else 'scan_passed' end as state from j) select state, case when state in ('rejected', 'scan_failed') then 'deleted' when state = 'active' then 'active' else 'quarantined' end as chunks, bad and coalesce(quality = 1, false) refused, count(*) n from s group by all",
    "i6_pending_queue": f"select doc_id, source from documents where regexp_matches(text, '{EMAIL}') order by doc_id limit 50",
    "i9_insert_if_absent": "select c_custkey id, 'customer' origin from customer union all select distinct user_id, 'event' from events where user_id not in (select c_custkey from customer)",
    "i10_partial_update": "select doc_id, coalesce(case when t = 1 then 'toxic' end, lang) lang, coalesce(case when q = 0 then 'low' end, source) source from documents left join (select doc_id, max(toxic) t, max(quality) q from labels group by 1) using (doc_id)",
    "i12_state_stamp": "select user_id, event_type state, case when event_type = 'error' then ts end stamped_at from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1",
    "i13_counter_bump": "select user_id, count(*) filter (event_type = 'purchase') + 1 as version from events group by 1",
    "d17_version_invalidation": "with v as (select *, count(*) filter (event_type = 'purchase') over (partition by user_id order by ts, event_id rows unbounded preceding) v, count(*) filter (event_type = 'purchase') over (partition by user_id) l from events) select user_id, count(*) filter (v = l) reachable, count(*) filter (v < l) stale from v where event_type = 'view' group by 1",
    "p5_owner_filter": "with a as (select event_id, case when event_id % 3 = 0 then user_id else user_id + 1 end u from events) select u user_id, count(e.event_id) as found, count(*) - count(e.event_id) not_found from a left join events e on e.event_id = a.event_id and e.user_id = a.u group by 1",
    "p9_graded": f"with k as (select a.vec_id q, b.vec_id id, {_COS} s, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) r from embeddings a, embeddings b where a.vec_id % 100 = 0), g as (select q, id, row_number() over (partition by q order by r) place from k where r <= 20 and s >= 0.5 and id in (select doc_id from labels where quality = 1)) select q query_id, place::int place, id from g where place <= 3",
    "d12_route": f"with {_K}, i as (select case feature when 'purchase' then 'sql' when 'click' then 'hybrid' else 'rag' end intent, k from t) select intent, case when intent <> 'rag' and k < 90 then 'reject:uncertain_sql_intent' else intent end route, count(*) n from i group by all",
    "d14_config_invariants": f"with {_K} select concat_ws(',', case when not k + 10 between 0 and 100 then 'percentage_range' end, case when not duration_ms / 500 between 0 and 1 then 'threshold_range' end, case when k % 3 < 1 then 'version_range' end, case when fallback and k + 10 <= 50 then 'enabled_implies_percentage' end) broken, count(*) n from t group by 1",
    "s7_backfill": "select coalesce(case when quality = 1 then 'active' when quality is not null then 'quarantined' end, 'active') ingestion_status, count(*) n from documents left join labels using (doc_id) group by 1",
    "s9_ttl_cache": f"with {_K}, c as (select ['emb', 'rag', 'sql_gen', 'sql_result', 'intent'][(user_id % 5 + 1)::int] tier, feature, k, max(ts) set_at from t group by all) select tier, count(*) filter (live) live, count(*) filter (not live) expired from (select tier, set_at + to_seconds(case tier when 'emb' then 604800 when 'rag' then 3600 when 'sql_result' then 900 else 86400 end) > (select max(ts) from events) live from c where not (tier = 'rag' and feature = 'view')) group by 1",
    "s11_recorded_fixture": f"with c as (select conv_id, turn, lower({_FLAT}) as key from conversations where role = 'user'), f as (select arg_min(key, turn) as key from c group by conv_id), r as (select key, count(*) n from f group by 1) select conv_id, turn, coalesce(n, 0) recorded from c left join r using (key)",
}
