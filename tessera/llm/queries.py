"""Registered queries of this package: thin digests over its operators, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_cut
from .decontaminate import with_contamination
from .embeddings import near_duplicate_vectors
from .licenses import CONFIDENCE, scan_licenses
from .merkle import leaf_digest, manifest
from .ngram_join import jaccard_components
from .packing import pack_documents
from .paragraphs import duplicate_paragraphs
from .prefix_trie import prefix_trie, rebuilt, turn_digests
from .secret_rules import BASE_RULES
from .secrets import with_secrets
from .sharding import balanced_shards
from .suffix_dedup import span_digests
from .toxicity import score_toxicity
from .wordpiece import marked_vocabulary, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 24 shards whose row counts differ by one at most."""
    found = balanced_shards(_table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("group").alias("text_md5"))


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs with a near duplicate: five-word shingles, the whole sequence of shorter ones; similarity 0.8 or more."""
    found = duplicate_paragraphs(_table(spark, sf_dir, "documents"), n=5, num=80, den=100, least_words=1)
    return found.withColumnRenamed("class_id", "class_doc_id")


def trains(id_column: str = "doc_id") -> Column:
    """Rows whose labels may be learnt from: crc32 of the id's text modulo 3 is not 1."""
    return F.crc32(F.col(id_column).cast("string")) % 3 != 1


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every document's score; held_out is false for a null id."""
    scored = score_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), trains())
    score = F.col("toxicity.score")
    return scored.select("doc_id", F.coalesce(~trains(), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), F.round("toxicity.evidence", 9).alias("evidence"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: n_words, places of the base phrases, labels; score: 1 less the product over labels of the doubt that the
    surest evidence for each leaves (a base phrase counts like a name)."""
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    spans = found.select("doc_id", "n_words", F.col("base.word").alias("words"), F.col("base.label").alias("base"), "detections")
    base = F.array_sort(F.array_distinct("base"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.col("detections.label"))))
    doubts = "transform(detections, d -> case d.priority " + " ".join(f"when {p} then {1 - c:.2f}D" for p, c in CONFIDENCE.items()) + " end)"
    score = F.expr(f"round(1D - aggregate({doubts}, if(size(base) > 0, {1 - CONFIDENCE[1]:.2f}D, 1D), (a, x) -> a * x), 9)")
    return spans.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("words").alias("first_word"),
        F.array_max("words").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds: five-word shingles, similarity 0.8 or more."""
    found = with_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), n=5, least=0.8)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece lengths of all documents under a public vocabulary of 32 000 pieces."""
    import public_tokenizers

    first, inner = marked_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(_table(spark, sf_dir, "documents"), first, inner)


def op7_embedding_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all embeddings, cosine 0.98 or more among equal labels."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 3-word shingles, similarity 0.9 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100, kind="space")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: bytes covered by strings of 200 bytes that start twice."""
    return span_digests(_table(spark, sf_dir, "documents"), length=200)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all documents in sequences of 2048 tokens at most."""
    return pack_documents(_table(spark, sf_dir, "documents"), capacity=2048, open_bins=256)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: the nodes of the rebuilt conversations' trie. An empty table has no nodes, rows without conv_id count for
    nothing, turns that repeat a number stand in the order of a digest of role and text."""
    turns, every, spent = rebuilt(turn_digests(_table(spark, sf_dir, "conversations")))
    found = prefix_trie(turns, every)
    drop_cut(*spent)
    return found


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every row's leaf and proof; tampering lower-cases the text where 3 divides crc32 of the id (never for a null
    id)."""
    low = F.translate(F.col("text"), _UPPER, _LOWER)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest([low if f == "text" else F.col(f) for f in MANIFEST_FIELDS]))
    return manifest(_table(spark, sf_dir, "documents"), MANIFEST_FIELDS, group="lang", key="doc_id", tampered=changed)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: spans of the base kinds, counted and digested, and of all kinds as text."""
    found = with_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(secrets, s -> s.kind in (" + ", ".join(f"'{r.kind}'" for r in BASE_RULES) + "))"
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{r.kind}')) as long)").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(F.expr(told.format(base)), 256).alias("base_sha256"), F.expr(told.format("secrets")).alias("spans"))


QUERIES = {
    "op1_balanced_label_propagation": op1_balanced_label_propagation,
    "op2_paragraph_minhash": op2_paragraph_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_simhash_decontamination": op5_simhash_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_pigeonhole": op7_embedding_pigeonhole,
    "op8_ngram_join": op8_ngram_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_secret_scan": op13_secret_scan,
}

_DOT = "list_dot_product({0}.v, {1}.v)"
_REACHED = "r(a, b) as (select id, id from node union select r.a, l.b from r join l on r.b = l.a)"


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII string."""
    byte = "list_reduce(list_concat([xor(a, b)], [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end)"
    return f"xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split({text}, ''), lambda c: ascii(c)::ubigint)), lambda a, b: {byte}), 4294967295::ubigint)"


def _levels(name: str, most: int) -> str:
    """CTEs over {name}0(tree, i, h): {name}1.. above it, {name}s0.. the siblings of each node, {name}top the roots."""
    out, top = [], []
    for k in range(most):
        open_trees = f"(select tree from {name}{k} where i > 0)"
        side = "coalesce(string_agg(b.h, '' order by b.i) filter (b.i {} a.i), '')"
        out.append(f"{name}s{k} as (select a.tree, a.i, {side.format('<')} l, {side.format('>')} r from {name}{k} a join {name}{k} b on a.tree = b.tree and a.i // 8 = b.i // 8 where a.tree in {open_trees} group by a.tree, a.i)")
        out.append(f"{name}{k + 1} as (select tree, i // 8 i, sha256(string_agg(h, '' order by i)) h from {name}{k} where tree in {open_trees} group by tree, i // 8)")
        top.append(f"select tree, h from {name}{k} where tree not in {open_trees}")
    return ", ".join([*out, f"{name}top as ({' union all '.join(top)})"])


def _folds(name: str, start: str, most: int) -> str:
    """CTEs {name}p0.. over start(tree, i, ..., f, proof): f folded with the siblings of level k and the proof so far."""
    out = [f"{name}p0 as ({start})"]
    for k in range(most):
        out.append(f"{name}p{k + 1} as (select p.* replace (case when s.i is null then f else sha256(s.l || f || s.r) end as f, case when s.i is null then proof else proof || s.l || s.r end as proof) from {name}p{k} p left join {name}s{k} s on s.tree = p.tree and s.i = p.i // {8**k})")
    return ", ".join(out)


def _leaf(text: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


ORACLES: dict[str, str] = {
    "op7_embedding_pigeonhole": f"""with recursive ok as (select vec_id id, label, embedding::double[] v from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select x.id a, y.id b from ok x join ok y on x.label = y.label and len(x.v) = len(y.v) and x.id <> y.id where {_DOT.format("x", "y")} / sqrt({_DOT.format("x", "x")} * {_DOT.format("y", "y")}) >= 0.98),
node as (select vec_id id from embeddings), {_REACHED}, c as (select a, min(b) root from r group by a), n as (select a, count(*) n from l group by a)
select c.a vec_id, coalesce(n.n, 0)::bigint n_links, c.root component_id, c.a = c.root as kept from c left join n using (a)""",
    "op8_ngram_join": f"""with recursive w as (select doc_id id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [w] else list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2]) end) g from w),
size as (select id, count(*) n from s group by id), p as (select x.id a, y.id b, count(*) shared from s x join s y on x.g = y.g and x.id <> y.id group by all),
l as (select a, b from p join size i on i.id = a join size j on j.id = b where 100 * shared >= 90 * (i.n + j.n - shared)), node as (select doc_id id from documents), {_REACHED}
select r.a doc_id, coalesce(any_value(size.n), 0)::bigint n_shingles, min(r.b) component_id from r left join size on size.id = r.a group by r.a""",
    "op11_prefix_trie": f"""with t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') t, row_number() over (partition by conv_id order by turn nulls first) p from conversations where conv_id is not null),
i as (select c, c - c % 100 donor, {_crc32("c::varchar")} % 6 h from (select distinct c from t)),
b as (select i.c, t.p, t.r, t.t from i join t on t.c = i.donor and t.p <= i.h union all select t.c, t.p, t.r, t.t from t join i using (c) where t.p > i.h),
s as (select i.c, coalesce(g.s, []) s from i left join (select c, list({{'r': r, 't': t}} order by p) s from b group by c) g using (c)),
m as (select c, d, s[1:d] k, case when d > 0 then length(s[d].t) else 0 end size, d = len(s) here from s, unnest(range(0, len(s) + 1)) u(d)),
n as (select k, d, min(c) c, count(*) n, any_value(size) size, coalesce(string_agg(c::varchar, ',' order by c) filter (here), '') ids from m group by k, d),
kids as (select k[1:d - 1] k, d - 1 d, count(*) n from n where d > 0 group by all),
full_n as (select n.*, coalesce(kids.n, 0) kids from n left join kids on kids.k = n.k and kids.d = n.d),
below as (select k[1:e] k, e d, sum((n - 1) * size) saved, count(*) filter (kids = 0) leaves from full_n, unnest(range(0, d + 1)) u(e) group by all)
select x.c::bigint conv_id, x.d::bigint depth, up.c::bigint parent_conv_id, x.n::bigint n_convs, x.kids::bigint n_children, below.leaves::bigint n_leaves, below.saved::bigint saved_tokens, sha256(x.ids) ends_sha256
from full_n x join below on below.k = x.k and below.d = x.d left join n up on x.d > 0 and up.d = x.d - 1 and up.k = x.k[1:x.d - 1]""",
    "op12_merkle_manifest": f"""with d as (select *, {_leaf("text")} leaf, case when {_crc32("doc_id::varchar")} % 3 = 0 then {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} end other from documents),
l as (select *, coalesce('=' || lang, '-') tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i from d), a0 as (select tree, i, leaf h from l), {_levels("a", 9)},
b0 as (select 'all' tree, row_number() over (order by tree::blob) - 1 i, h, tree grp from atop), {_levels("b", 6)},
{_folds("a", "select tree, i, doc_id, leaf, coalesce(other, leaf) f, '' proof from l", 9)},
{_folds("b", "select 'all' tree, b0.i, p.doc_id, p.leaf, b0.h subroot, p.f, p.proof from ap9 p join b0 on b0.grp = p.tree", 6)}
select doc_id, leaf, subroot, h root, sha256(proof) proof_sha256, f folded_root, f = h verified from bp6 cross join btop""",
}
