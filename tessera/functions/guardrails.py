"""Guardrail policy over findings, and the pipelines that apply it to input, context, output and ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.decoding import scannable
from tessera.functions.text import bound, findings, redacted, sql_findings
from tessera.sources.tables import table, texts

#: Categories that always block, those that block from a score on, those that are redacted.
ALWAYS_BLOCK = ["prompt_injection", "secrets", "malicious_url", "prompt_leak"]
BLOCK_FROM = {"toxicity": 0.75, "banned_topic": 0.6}
REDACT = ["pii"]
ABSTENTION = "I can't provide that answer."


def would_block(found: Column) -> Column:
    def reached(category: str, least: float):
        return lambda f: (f["category"] == category) & (f["score"] >= least)

    out = F.exists(found, lambda f: f["category"].isin(ALWAYS_BLOCK))
    for category, least in BLOCK_FROM.items():
        out = out | F.exists(found, reached(category, least))
    return out


def decided(found: Column, mode: str = "enforce", redacts: bool = True) -> Column:
    """struct<action, would_block> for array<struct<category, detail, score>>, which is worked out once. Monitor mode allows
    everything and keeps would_block; without redacts personal data is allowed, as at ingestion."""

    def verdict(found: Column) -> Column:
        redact = F.exists(found, lambda f: f["category"].isin(REDACT)) if redacts else F.lit(False)
        return F.struct(would_block(found).alias("block"), redact.alias("redact"))

    def named(v: Column) -> Column:
        action = F.lit("allow") if mode == "monitor" else F.when(v["block"], "block").when(v["redact"], "redact").otherwise("allow")
        return F.struct(action.alias("action"), v["block"].alias("would_block"))

    return bound(bound(found, verdict), named)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id, source, found): what their text gives, and toxicity as far as the labels mark it (score 0.9; 0.7,
    below the threshold, for those whose quality is good)."""
    d = texts(spark, sf_dir).select("doc_id", "source", findings("text").alias("f"))
    marks = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.when(F.col("quality") == 1, 0.7).otherwise(0.9).alias("toxic_score"))
    toxic = F.when(F.col("toxic_score").isNotNull(), F.struct(F.lit("toxicity").alias("category"), F.lit("label").alias("detail"), F.col("toxic_score").alias("score")))
    return d.join(marks, "doc_id", "left").select("doc_id", "source", F.array_compact(F.array_append("f", toxic)).alias("found"))


def d1_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source by the action on their text's findings, and how many of them would be blocked."""
    d = texts(spark, sf_dir).select("source", decided(findings("text")).alias("d"))
    return d.groupBy("source", "d.action").agg(F.count("*").alias("n"), F.count_if("d.would_block").alias("would_block"))


def d1_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds and modes: actions on text findings and labelled toxicity, enforced and monitored."""
    d = _scanned(spark, sf_dir).select(decided(F.col("found")).alias("e"), decided(F.col("found"), "monitor").alias("m"))
    return d.groupBy(F.col("e.action").alias("enforced"), F.col("m.action").alias("monitored"), F.col("m.would_block").alias("would_block")).agg(F.count("*").alias("n"))


def d2_input_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns in canonical form with what is encoded in them, scanned and decided: what goes on to the model (nothing if blocked, redacted text, or
    the canonical text), and whether an event is recorded."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    d = scannable(c, "text", "t").withColumn("d", decided(findings("t")))
    served = F.when(F.col("d.action") == "block", None).when(F.col("d.action") == "redact", redacted(F.col("t"))).otherwise(F.col("t"))
    return d.select("conv_id", "turn", F.col("d.action").alias("action"), (F.col("d.would_block") | (F.col("d.action") == "redact")).alias("event"), F.md5(served).alias("served_md5"))


def d3_context_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the context chunks of their source: blocked ones are dropped, one event a source counts them."""
    d = _scanned(spark, sf_dir).select("source", decided(F.col("found"))["action"].alias("action"))
    return d.groupBy("source").agg(F.count_if(F.col("action") != "block").alias("kept"), F.count_if(F.col("action") == "block").alias("dropped"))


def d4_output_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers after the output scan: blocked ones become the abstention text, personal data is redacted."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text", decided(findings("text"))["action"].alias("action"))
    served = F.when(F.col("action") == "block", ABSTENTION).when(F.col("action") == "redact", redacted(F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "action", F.md5(served).alias("served_md5"))


def d5_ingestion_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents of a source pooled (each kind once, with its greatest score): blocked or allowed, never
    redacted."""
    each = _scanned(spark, sf_dir).select("source", F.explode_outer("found").alias("f"))
    pooled = each.groupBy("source", "f.category", "f.detail").agg(F.max("f.score").alias("score"))
    found = pooled.groupBy("source").agg(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "detail", "score"))).alias("found"))
    return found.select("source", F.size("found").alias("n_findings"), decided(F.col("found"), redacts=False)["action"].alias("action"))


def d6_tool_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls (events) by verdict: all are denied while a lockdown holds (the last day of the table), else only
    administrators (users whose id is divisible by 10) may."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    e = e.join(F.broadcast(e.agg(F.max(day).alias("lockdown"))), day >= F.col("lockdown"), "left")
    verdict = F.when(F.col("lockdown").isNotNull(), "lockdown").when(F.col("user_id") % 10 != 0, "not_admin").otherwise("allowed")
    return e.groupBy("event_type", verdict.alias("verdict")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (d1_guardrail, d1_modes, d2_input_pipeline, d3_context_pipeline, d4_output_pipeline, d5_ingestion_scan, d6_tool_authorisation)}

_CATEGORY = "case x when 'credential_shaped_token' then 'secrets' else 'pii' end"
_FOUND = f"f as (select documents.doc_id, source, list_filter({sql_findings('text')}, lambda x: x is not null) f, case when toxic = 1 then case when quality = 1 then 0.7 else 0.9 end end toxic_score from documents left join labels using (doc_id))"
_BLOCK = "(list_contains(f, 'credential_shaped_token') or coalesce(toxic_score >= 0.75, false))"
_TEXT_ACTION = "case when list_contains(f, 'credential_shaped_token') then 'block' when len(f) > 0 then 'redact' else 'allow' end"

ORACLES = {
    "d1_guardrail": f"with f as (select source, list_filter({sql_findings('text')}, lambda x: x is not null) f from documents) select source, {_TEXT_ACTION} as action, count(*) n, count(*) filter (list_contains(f, 'credential_shaped_token')) would_block from f group by all",
    "d1_modes": f"with {_FOUND} select case when {_BLOCK} then 'block' when len(f) > 0 then 'redact' else 'allow' end enforced, 'allow' monitored, {_BLOCK} would_block, count(*) n from f group by all",
    "d3_context_pipeline": f"with {_FOUND} select source, count(*) filter (not {_BLOCK}) kept, count(*) filter ({_BLOCK}) dropped from f group by 1",
    "d5_ingestion_scan": f"with {_FOUND}, e as (select source, unnest(case when len(f) = 0 then [null] else f end) d, null::double s from f union all select source, 'label', toxic_score from f where toxic_score is not null) select source, count(distinct d)::int n_findings, case when bool_or(coalesce(d = 'credential_shaped_token', false) or coalesce(s >= 0.75, false)) then 'block' else 'allow' end as action from e group by 1",
    "d6_tool_authorisation": "select event_type, case when ts::date >= (select max(ts::date) from events) then 'lockdown' when user_id % 10 <> 0 then 'not_admin' else 'allowed' end verdict, count(*) n from events group by all",
}
