"""Ranked retrieval: dense kNN, BM25, reciprocal rank fusion, reranking, semantic cache.

Ties: score descending, then id ascending; scores are rounded to 9 digits before they rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.text_index import TextIndex, terms
from tessera.operators.vector_index import knn
from tessera.sources.tables import corpus, table, texts

#: The fusion constant, list sizes.
RRF_K, CANDIDATES, TOP = 60, 20, 5
#: Labels up to which a list of them is broadcast.
BROADCAST_LABELS = 100_000
CACHE_THRESHOLD, MAX_EVIDENCE, ENTRY_HOURS = 0.95, 10, 12


def ranked(df: DataFrame, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))))


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) from an index of docs(id, text), built for these queries(query_id, text)."""
    index = TextIndex(docs)
    found = index.search(queries, k)
    index.release()
    return found


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion with ranks from 0; norm: score over its greatest value for two lists, 1 at most."""
    parts = [x.select("query_id", "id", (1.0 / (RRF_K + F.col("rank") - 1)).alias("part")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    scored = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    out = ranked(scored).where(F.col("rank") <= k)
    return out.withColumn("norm", F.round(F.least(F.col("score") / (2.0 / RRF_K), F.lit(1.0)), 6))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where("ingestion_status = 'active'")


def r1_dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = knn(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), TOP)
    return found.select("query_id", "id", F.round("score", 5).alias("score"))


def r2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25(_items(spark, sf_dir), _active(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), TOP)
    return found.select("query_id", "id", F.round("score", 4).alias("score"))


def _dense_for_items(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The vector with an item's id stands for its question."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.join(_items(spark, sf_dir), e["vec_id"] == F.col("query_id")).select("query_id", F.col("embedding").alias("vector"))
    held = e.join(docs.select("id"), e["vec_id"] == F.col("id"), "left_semi").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn(asked, held, CANDIDATES)


def hybrid(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    docs = _active(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return fused([bm25(_items(spark, sf_dir), docs, CANDIDATES), _dense_for_items(spark, sf_dir, docs)], k)


def r3_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("query_id", "rank", "id", F.round("score", 6).alias("score"), "norm")


def r9_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid list in the order of a scorer (share of the item's terms that the document holds), original order for ties."""
    found = hybrid(spark, sf_dir, CANDIDATES).select("query_id", "id", F.col("rank").alias("original_rank"))
    asked = _items(spark, sf_dir).select("query_id", F.array_distinct(terms("text")).alias("asked"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(terms("text")).alias("held"))
    overlap = F.round(F.size(F.array_intersect("asked", "held")) / F.size("asked"), 6)
    scored = found.join(asked, "query_id").join(docs, "id").where(F.size("asked") > 0).withColumn("rerank_score", overlap)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "original_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("query_id", "rank", "id", "original_rank", "rerank_score")


def r14_semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest entry of the same label at CACHE_THRESHOLD or more, other than the asking vector itself, among entries that are live;
    without one the next live entry below the threshold is told as a miss. An entry was written at the time of the event with its
    number and lives ENTRY_HOURS: those older than that when the last entry was written are expired, those without an event were
    never written."""
    e = table(spark, sf_dir, "embeddings")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    written = e.select("vec_id").join(events, "vec_id")
    live = written.crossJoin(F.broadcast(written.agg(F.max("at").alias("now")))).where(F.col("now") - F.col("at") < ENTRY_HOURS * 3_600_000_000)  # one row
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    entries = e.join(live, "vec_id", "left_semi").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = knn(queries, entries, 2, same="label").where(F.col("id") != F.col("query_id"))
    return ranked(found.drop("rank")).where("rank = 1").select("query_id", "id", F.round("score", 5).alias("score"), (F.col("score") >= CACHE_THRESHOLD).alias("hit"))


def r6_embedding_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each label's vectors, scaled to length 1. Vectors with null or non-finite components take no part; a label whose vectors
    differ in length, or whose mean is zero, has none."""
    e = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('infinity'))")
    one_length = e.groupBy("label").agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).where("least = most").select("label")
    same = e.join(F.broadcast(one_length), "label", "left_semi") if one_length.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else e.join(one_length, "label", "left_semi")
    means = same.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return means.withColumn("norm", norm).where("norm > 1e-12").select("label", "pos", F.round(F.col("m") / F.col("norm"), 6).alias("x"))


def r16_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    flat = F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))
    return c.select("conv_id", "turn", F.sha2(F.concat_ws(":", F.lit("rag"), F.lit("v8"), F.lit("main"), F.lit("5"), flat), 256).alias("cache_key"))


def r18_evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved evidence of each item, in rank order: of pieces with one source, one page (here the language) and the same text apart
    from case and white space the first stays, MAX_EVIDENCE of them at most."""
    found = hybrid(spark, sf_dir, CANDIDATES).select("query_id", "id", "rank")
    d = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "lang", F.md5(F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n\\r]+", " "))).alias("key"))
    first = found.join(d, "id").groupBy("query_id", "source", "lang", "key").agg(F.min(F.struct("rank", "id")).alias("f"), F.count("*").alias("copies"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("f.rank"))
    return first.withColumn("place", place).where(F.col("place") <= MAX_EVIDENCE).select("query_id", "place", "f.id", "copies")


def r20_char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in rank order within 30 000 characters; the piece that crosses the budget is cut."""
    found = hybrid(spark, sf_dir, 10).select("query_id", "rank", "id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = found.join(docs, "id").withColumn("before", before).where("before < 30000")
    return cut.select("query_id", "rank", "id", F.least("n", 30000 - F.col("before")).cast("long").alias("used"))


QUERIES = {f.__name__: f for f in (r1_dense_knn, r2_bm25, r3_hybrid_rrf, r6_embedding_fusion, r9_rerank, r14_semantic_cache, r16_cache_key, r18_evidence_dedupe, r20_char_budget)}

_COSINE = "round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 9)"
_ACTIVE = r"active as (select doc_id id, text from documents where not regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'))"
_BM25 = f"""{_ACTIVE}, asked as (select distinct item_id query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from benchmark),
post as (select id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) dl, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from active),
tf as (select term, id, dl, count(*) tf from post where term in (select term from asked) group by all), df as (select term, count(*) df from tf group by all),
w as (select term, id, ln(((select count(*) from active) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 256)) w from tf join df using (term)),
bm as (select query_id, id, round(sum(w), 6) score from asked join w using (term) group by all), bmr as (select *, row_number() over (partition by query_id order by score desc, id) rank from bm)"""
_HYBRID = f"""with {_BM25}, dn as (select i.item_id query_id, b.vec_id id, {_COSINE} score from benchmark i join embeddings a on a.vec_id = i.item_id cross join embeddings b where b.vec_id in (select id from active)),
dnr as (select *, row_number() over (partition by query_id order by score desc, id) rank from dn),
f as (select query_id, id, round(sum(1.0 / (60 + rank - 1)), 9) score from (select query_id, id, rank from bmr where rank <= 20 union all select query_id, id, rank from dnr where rank <= 20) group by all),
h as (select *, row_number() over (partition by query_id order by score desc, id) rank from f)"""

ORACLES = {
    "r1_dense_knn": f"select query_id, id, round(score, 5) score from (select a.vec_id query_id, b.vec_id id, {_COSINE} score, row_number() over (partition by a.vec_id order by {_COSINE} desc, b.vec_id) r from embeddings a, embeddings b where a.vec_id % 100 = 0) where r <= 5",
    "r2_bm25": f"with {_BM25} select query_id, id, round(score, 4) score from bmr where rank <= 5",
    "r3_hybrid_rrf": f"{_HYBRID} select query_id, rank::int rank, id, round(score, 6) score, round(least(score / (2.0 / 60), 1.0), 6) norm from h where rank <= 5",
    "r6_embedding_fusion": "with u as (select label, embedding, len(embedding) n from embeddings where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), p as (select label, unnest(range(n))::int pos, embedding from u where label in (select label from u group by 1 having min(n) = max(n))), m as (select label, pos, avg(embedding[pos + 1]::double) m from p group by all) select label, pos, round(m / sqrt(sum(m * m) over (partition by label)), 6) x from m",
    "r9_rerank": f"{_HYBRID}, s as (select h.query_id, h.id, h.rank original_rank, round(len(list_intersect(list_distinct(regexp_extract_all(lower(i.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')))) / len(list_distinct(regexp_extract_all(lower(i.text), '[a-z0-9]+'))), 6) rerank_score from h join benchmark i on i.item_id = h.query_id join documents d on d.doc_id = h.id where h.rank <= 20) select query_id, rank::int rank, id, original_rank::int original_rank, rerank_score from (select *, row_number() over (partition by query_id order by rerank_score desc, original_rank) rank from s) where rank <= 5",
    "r14_semantic_cache": f"with written as (select event_id, epoch_us(ts) at_ from events where event_id in (select vec_id from embeddings)), live as (select event_id from written where (select max(at_) from written) - at_ < 12 * 3600000000) select query_id, id, round(score, 5) score, score >= 0.95 hit from (select *, row_number() over (partition by query_id order by score desc, id) r from (select a.vec_id query_id, b.vec_id id, {_COSINE} score from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and b.vec_id in (select event_id from live))) where r = 1",
    "r16_cache_key": "select conv_id, turn, sha256('rag:v8:main:5:' || trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) cache_key from conversations where role = 'user'",
    "r18_evidence_dedupe": f"{_HYBRID}, e as (select query_id, id, rank, source, lang, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) as key from h join documents on doc_id = id where rank <= 20), g as (select query_id, min(rank) r, arg_min(id, rank) id, count(*) copies from e group by query_id, source, lang, key) select query_id, place::int place, id, copies from (select *, row_number() over (partition by query_id order by r) place from g) where place <= 10",
    "r20_char_budget": f"{_HYBRID}, b as (select h.query_id, h.rank, h.id, length(d.text) n, coalesce(sum(length(d.text)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) before from h join documents d on d.doc_id = h.id where h.rank <= 10) select query_id, rank::int rank, id, least(n, 30000 - before)::bigint used from b where before < 30000",
}
