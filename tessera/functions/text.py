"""Text functions and the policies over their findings, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import EMAIL, table, texts, turns

#: The kinds of personal data and secrets, in the order in which they are looked for and replaced.
PATTERNS = {
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    "api_key": r"(?i)\b(?:sk|pk|api|key)[-_](?:[A-Za-z0-9]+[-_])?[A-Za-z0-9]{16,}\b",
    "email": EMAIL,
    "phone": r"(?<!\d)(?:\+?91[-\s]?)?[6-9]\d{9}(?!\d)",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "aadhaar": r"(?<!\d)\d{4}[-\s]?\d{4}[-\s]?\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d[-\s]?){13,19}(?!\d)",
}
#: Findings in their order, as (category, detail, score, kinds).
FINDINGS = [
    ("secrets", "credential_shaped_token", 1.0, ("jwt", "api_key")),
    ("pii", "contact_identifier", 0.8, ("email", "phone")),
    ("pii", "government_id", 0.95, ("pan", "aadhaar")),
    ("pii", "card_number", 0.9, ("card",)),
]
#: Language that makes a sentence an absolute claim, phrases that refuse.
ABSOLUTE = r"(?i)\b(cannot|can not|can't|must|prohibited|forbidden|never|always|required to|not allowed|not permitted)\b"
REFUSALS = ["does not contain", "doesn't contain", "no relevant context", "not contain the answer", "don't know", "do not know", "cannot determine", "unable to determine", "no information", "not provided in the context"]
#: What a retrieval query must not hold, and its length.
QUERY_MARKERS = ["ignore previous", "ignore all previous", "system prompt", "http://", "https://", "sql:"]
QUERY_LENGTH = (3, 500)
#: Questions that may go to the public regulatory web.
PUBLIC_MARKERS = ["rbi circular", "reserve bank of india", "sebi circular", "npci circular", "public regulation", "regulatory circular"]
SPACE = "[ \\t\\n\\r]+"
#: Code points that nobody sees, control characters other than tabs and line ends, what ends a line.
INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060\\u2066-\\u2069\\uFEFF]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"
LINE_END = "\\r\\n|[\\n\\r\\u2028\\u2029]"


def collapsed(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def content_words(c: Column | str) -> Column:
    """Different runs of letters and digits of more than two characters, lower-cased."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 2))


def sentences(c: Column | str) -> Column:
    """Split after . ! or ? before white space."""
    marked = F.regexp_replace(collapsed(c), "([.!?]) ", "$1\n")
    return F.filter(F.split(marked, "\n"), lambda x: x != "")


def refiner_sentences(c: Column | str) -> Column:
    """Split after . ! or ? before white space and a capital, a digit or a bracket."""
    return F.filter(F.split(collapsed(c), "(?<=[.!?]) (?=[A-Z0-9(])"), lambda x: x != "")


def bound(c: Column | str, f) -> Column:
    """f of the value of c, worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def is_card(x: Column) -> Column:
    digits = F.regexp_replace(x, r"[-\s]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def card_numbers(c: Column | str) -> Column:
    """Numbers of 13 to 19 digits that pass the Luhn check."""
    found = F.filter(F.regexp_extract_all(c, F.lit(PATTERNS["card"]), F.lit(0)), is_card)
    return F.transform(found, lambda x: F.regexp_replace(x, r"[-\s]", ""))


def holds(c: Column | str, kind: str) -> Column:
    """Whether a text holds a kind of personal data or secret; cheap tests spare most texts the pattern."""
    c = F.col(c) if isinstance(c, str) else c
    gate = {"jwt": F.contains(c, F.lit("eyJ")), "email": F.contains(c, F.lit("@")), "api_key": c.rlike("[A-Za-z0-9]{16}")}.get(kind, c.rlike("[0-9]"))
    return gate & (F.size(card_numbers(c)) > 0 if kind == "card" else c.rlike(PATTERNS[kind]))


def findings(c: Column | str) -> Column:
    """array<struct<category, detail, score>> in the order of FINDINGS; null for a null text."""
    each = []
    for category, detail, score, kinds in FINDINGS:
        found = holds(c, kinds[0])
        for kind in kinds[1:]:
            found = found | holds(c, kind)
        each.append(F.when(found, F.struct(F.lit(category).alias("category"), F.lit(detail).alias("detail"), F.lit(score).alias("score"))))
    return F.array_compact(F.array(*each))


def replaced(c: Column, kind: str) -> Column:
    """Each match of a kind (cards: those that pass the Luhn check) replaced by a token with a digest of the value."""
    token = lambda x: F.concat(F.lit(f"[REDACTED:{kind.upper()}:"), F.substring(F.sha2(x, 256), 1, 8), F.lit("]"))
    value = (lambda x: F.when(is_card(x), token(x)).otherwise(x)) if kind == "card" else token
    pattern = PATTERNS[kind]

    def all_of(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.when(holds(t, kind), F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, x: F.concat(a, F.when(x.isNull(), "").otherwise(value(x)))), "")).otherwise(t)

    return bound(c, all_of)


def redacted(c: Column) -> Column:
    """All kinds replaced in the order of PATTERNS."""
    for kind in PATTERNS:
        c = replaced(c, kind)
    return c


def share_of(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


@F.pandas_udf(T.StringType())
def folded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, which Spark has no function for."""
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def canonical(c: Column | str) -> Column:
    """Compatibility forms folded, invisible and control characters out, white space of each line collapsed, no blanks or line
    ends around the whole."""
    clean = F.regexp_replace(F.regexp_replace(folded(c), INVISIBLE, ""), CONTROL, "")
    lines = F.transform(F.split(clean, LINE_END, -1), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\u1680]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), "^[ \n]+|[ \n]+$", "")


def f3_sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each document with at least one, in their order, and the greatest score."""
    d = texts(spark, sf_dir).select("doc_id", findings("text").alias("f")).where(F.size("f") > 0)
    return d.select("doc_id", F.array_join("f.detail", ",").alias("details"), F.array_max("f.score").alias("score"))


def f5_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with secrets, e-mail addresses and numbers replaced, in order, by a token; digest of the result."""
    c = texts(spark, sf_dir).select("doc_id", "text", redacted(F.col("text")).alias("clean"))
    return c.select("doc_id", F.md5("clean").alias("redacted_md5"), (F.col("clean") != F.col("text")).alias("changed"))


def f7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(refiner_sentences("text")).alias("pos", "sentence")).select("conv_id", "turn", "pos", "sentence")


def f10_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an answer's content words that its question holds, and whether it refuses."""
    t = turns(spark, sf_dir).withColumns({"a": content_words("answer"), "q": content_words("question")})
    refusal = F.exists(F.array(*[F.lit(x) for x in REFUSALS]), lambda r: F.contains(F.lower("answer"), r))
    answerability = F.when(F.size("a") == 0, 0.0).when(~refusal, 1.0).when(F.size("a") <= 25, 0.3).otherwise(0.7)
    return t.select("conv_id", "turn", F.round(share_of(F.col("a"), F.col("q")), 6).alias("faithfulness"), answerability.alias("answerability"))


def unsupported_claims(answer: Column, context_words: Column) -> Column:
    """array<struct<pos, overlap>>: sentences with an absolute claim that share less than 0.4 of their content words with the
    context; sentences without content words claim nothing."""
    each = F.transform(sentences(answer), lambda s, i: F.struct(i.alias("pos"), s.rlike(ABSOLUTE).alias("absolute"), content_words(s).alias("words")))
    share = F.transform(F.filter(each, lambda x: x["absolute"] & (F.size(x["words"]) > 0)), lambda x: F.struct(x["pos"].alias("pos"), F.round(F.size(F.array_intersect(x["words"], context_words)) / F.size(x["words"]), 6).alias("overlap")))
    return F.filter(share, lambda x: x["overlap"] < 0.4)


def f17_unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in answers, each with one more sentence that claims what the question says (turns divisible by 4) or the answer, against the
    question as context."""
    t = turns(spark, sf_dir)
    said = F.array_join(F.slice(F.split(F.when(F.col("turn") % 4 == 0, F.col("question")).otherwise(F.col("answer")), " "), 1, 8), " ")
    found = t.select("conv_id", "turn", unsupported_claims(F.concat("answer", F.lit(" It must always hold that "), said, F.lit(".")), content_words("question")).alias("f"))
    return found.select("conv_id", "turn", F.explode("f").alias("f")).select("conv_id", "turn", "f.pos", "f.overlap")


def f22_rollout_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of users: eight bytes of a salted hash modulo 10 000 against 25 percent."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    digest = F.sha2(F.concat(F.lit("reranker:v1\0"), F.col("user_id").cast("string")), 256)
    bucket = (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % 10000).cast("int")
    return users.select("user_id", bucket.alias("bucket"), (bucket < 2500).alias("treatment"))


def allowed_hosts(host: Column, allowed: list[str]) -> Column:
    """Whether a host is one of the allowed domains or below one."""
    out = F.lit(False)
    for domain in allowed:
        out = out | (host == domain) | host.endswith("." + domain)
    return out


#: Domains that pages may come from.
ALLOWED = ["example.com", "example.org"]
_AUTHORITY = r"^[A-Za-z]+://([^/?#]*)"


def web_address(url: str) -> tuple[Column, Column, Column]:
    """(host without www. and port, canonical URL, whether it may be read): HTTPS, no user data, an allowed domain."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, ":[0-9]*$", "")), "[.]+$", ""), "^www[.]", "")
    path, query = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    ok = F.lower(url).startswith("https://") & ~F.contains(authority, F.lit("@")) & (host != "") & allowed_hosts(host, ALLOWED)
    return host, F.concat(F.lit("https://"), authority, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query)), ok


def f23_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URL (fragment gone, / for an empty path, query kept) and domain (no www., no port) of pages; null where a URL
    is not HTTPS, holds user data or leaves the allowed domains."""
    host, url, ok = web_address("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(ok, host).alias("domain"), F.when(ok, url).alias("canonical_url"), ok.alias("allowed"))


#: Characters of a page that are kept, of a host's pages together, and pages of a host.
PAGE_LENGTH, HOST_LENGTH, HOST_PAGES = 6000, 20000, 5


def p6_web_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may be read, without tags: HOST_PAGES of a host at most, within PAGE_LENGTH characters each and HOST_LENGTH
    together, in page order. The window ranks within a host; only its first pages leave a task."""
    host, _, ok = web_address("url")
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), SPACE, " "))
    by_host = Window.partitionBy("host").orderBy("page_id")
    first = table(spark, sf_dir, "pages").where(ok).withColumn("host", host).withColumn("place", F.row_number().over(by_host)).where(F.col("place") <= HOST_PAGES)
    sized = first.select("page_id", "host", F.least(F.length(text), F.lit(PAGE_LENGTH)).alias("n"))
    before = F.coalesce(F.sum("n").over(by_host.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("before", before).where(F.col("before") < HOST_LENGTH).select("page_id", "host", F.least("n", HOST_LENGTH - F.col("before")).cast("long").alias("used"))


def query_reason(c: Column | str) -> Column:
    """Why a text can't serve as a retrieval query; ok if it can. Control characters count before white space collapses."""
    c = F.col(c) if isinstance(c, str) else c
    bad = F.exists(F.array(*[F.lit(m) for m in QUERY_MARKERS]), lambda m: F.contains(F.lower(collapsed(c)), m))
    return F.when(c.rlike("\\p{Cc}"), "control").when(~F.length(collapsed(c)).between(*QUERY_LENGTH), "length").when(bad, "marker").otherwise("ok")


def p10_query_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns by whether they can serve as a query, and by whether they may go to the public regulatory web."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    public = F.exists(F.array(*[F.lit(m) for m in PUBLIC_MARKERS]), lambda m: F.contains(F.lower(collapsed(F.col("text"))), m))
    return c.groupBy(query_reason("text").alias("reason"), public.alias("public")).agg(F.count("*").alias("n"))


def p12_cell_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of more than 2000 characters end in an ellipsis."""
    d = table(spark, sf_dir, "documents")
    cell = F.when(F.length("text") > 2000, F.concat(F.substring("text", 1, 2000), F.lit("…"))).otherwise(F.col("text"))
    return d.select("doc_id", F.length(cell).cast("long").alias("shown"), F.md5(cell).alias("cell_md5"))


QUERIES = {f.__name__: f for f in (f3_sensitive_scan, f5_redact, f7_sentences, f10_faithfulness, f17_unsupported_claims, f22_rollout_bucket, f23_canonical_url, p6_web_text, p10_query_validator, p12_cell_bound)}

_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2))"
_FLAT = "trim(regexp_replace({0}, '[ \\t\\n\\r]+', ' ', 'g'))"
_SENTENCES = "list_filter(string_split(regexp_replace(" + _FLAT + ", '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')"
_REFINER = "list_filter(string_split(regexp_replace(" + _FLAT + ", '([.!?]) ([A-Z0-9(])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda x: x <> '')"
_SHARE = "case when len({0}) = 0 or len({1}) = 0 then 0.0 else len(list_intersect({0}, {1})) / len({0}) end"
#: RE2 has no look-around: a digit's edge is matched as another character.
_SQL_PATTERNS = PATTERNS | {"phone": r"(?:^|[^0-9])(?:\+?91[-\s]?)?[6-9][0-9]{9}(?:[^0-9]|$)", "aadhaar": r"(?:^|[^0-9])[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}(?:[^0-9]|$)"}
_DIGITS = r"list_transform(regexp_extract_all({0}, '(?:^|[^0-9])((?:[0-9][-\s]?){{13,19}})(?:[^0-9]|$)', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"
_LUHN = "list_sum(list_transform(range(length(x)), lambda i: case when i % 2 = 1 then (2 * substr(reverse(x), i + 1, 1)::int) // 10 + (2 * substr(reverse(x), i + 1, 1)::int) % 10 else substr(reverse(x), i + 1, 1)::int end)) % 10 = 0"


def sql_holds(text: str, kind: str) -> str:
    """DuckDB: whether a text holds a kind."""
    if kind == "card":
        return f"len(list_filter({_DIGITS.format(text)}, lambda x: length(x) between 13 and 19 and {_LUHN})) > 0"
    return f"regexp_matches({text}, '{_SQL_PATTERNS[kind]}')"


def sql_findings(text: str) -> str:
    """DuckDB: a list of details, nulls between them, in the order of FINDINGS."""
    return "[" + ", ".join(f"case when {' or '.join(sql_holds(text, k) for k in kinds)} then '{detail}' end" for _, detail, _, kinds in FINDINGS) + "]"


_TURNS = "t as (select q.conv_id, q.turn, q.text question, a.text answer from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant')"
_ADDRESS = f"with p as (select page_id, url, html, regexp_extract(url, '{_AUTHORITY}', 1) a, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(url, '{_AUTHORITY}', 1), ':[0-9]*$', '')), '[.]+$', ''), '^www[.]', '') host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) path, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) q from pages), k as (select *, starts_with(lower(url), 'https://') and not contains(a, '@') and host <> '' and ({' or '.join(f"host = '{d}' or ends_with(host, '.{d}')" for d in ALLOWED)}) ok from p)"

ORACLES = {
    "f3_sensitive_scan": f"with f as (select doc_id, list_filter({sql_findings('text')}, lambda x: x is not null) f from documents) select doc_id, array_to_string(f, ',') details, list_max(list_transform(f, lambda x: case x when 'credential_shaped_token' then 1.0::double when 'contact_identifier' then 0.8::double when 'government_id' then 0.95::double else 0.9::double end)) score from f where len(f) > 0",
    "f7_sentences": f"select conv_id, turn, (generate_subscripts(s, 1) - 1)::int pos, unnest(s) sentence from (select conv_id, turn, {_REFINER.format('text')} s from conversations)",
    "f10_faithfulness": f"with {_TURNS}, w as (select *, {_WORDS.format('answer')} a, {_WORDS.format('question')} q from t) select conv_id, turn, round({_SHARE.format('a', 'q')}, 6) faithfulness, (case when len(a) = 0 then 0.0 when not ({' or '.join(f'contains(lower(answer), {chr(39)}{r.replace(chr(39), chr(39) * 2)}{chr(39)})' for r in REFUSALS)}) then 1.0 when len(a) <= 25 then 0.3 else 0.7 end)::double answerability from w",
    "f17_unsupported_claims": f"with {_TURNS}, k as (select conv_id, turn, question, answer || ' It must always hold that ' || array_to_string(string_split(case when turn % 4 = 0 then question else answer end, ' ')[1:8], ' ') || '.' answer from t), s as (select conv_id, turn, {_WORDS.format('question')} c, {_SENTENCES.format('answer')} s from k), e as (select conv_id, turn, c, (generate_subscripts(s, 1) - 1)::int pos, unnest(s) sentence from s), w as (select conv_id, turn, pos, c, {_WORDS.format('sentence')} a from e where regexp_matches(sentence, '{ABSOLUTE.replace(chr(39), chr(39) * 2)}')) select conv_id, turn, pos, round(len(list_intersect(a, c)) / len(a), 6) as overlap from w where len(a) > 0 and round(len(list_intersect(a, c)) / len(a), 6) < 0.4",
    "f22_rollout_bucket": "select user_id, b bucket, b < 2500 treatment from (select user_id, (('0x' || substr(sha256('reranker:v1' || chr(0) || user_id::varchar), 1, 16))::ubigint % 10000)::int b from (select distinct user_id from events))",
    "f23_canonical_url": f"{_ADDRESS} select page_id, case when ok then host end as domain, case when ok then 'https://' || a || case when path = '' then '/' else path end || case when q = '?' then '' else q end end canonical_url, ok allowed from k",
    "p6_web_text": f"{_ADDRESS}, f as (select *, row_number() over (partition by host order by page_id) place from k where ok), s as (select page_id, host, least(length({_FLAT.format(chr(39).join(['regexp_replace(html, ', '<[^>]*>', ', ', ' ', ', ', 'g', ')']))}), 6000) n from f where place <= 5), b as (select *, coalesce(sum(n) over (partition by host order by page_id rows between unbounded preceding and 1 preceding), 0) before from s) select page_id, host, least(n, 20000 - before)::bigint used from b where before < 20000",
    "p10_query_validator": f"with c as (select text, lower({_FLAT.format('text')}) flat from conversations where role = 'user') select case when regexp_matches(text, '\\p{{Cc}}') then 'control' when not length(flat) between 3 and 500 then 'length' when {' or '.join(f"contains(flat, '{m}')" for m in QUERY_MARKERS)} then 'marker' else 'ok' end reason, {' or '.join(f"contains(flat, '{m}')" for m in PUBLIC_MARKERS)} as public, count(*) n from c group by all",
    "p12_cell_bound": "select doc_id, length(c)::bigint shown, md5(c) cell_md5 from (select doc_id, case when length(text) > 2000 then substring(text, 1, 2000) || '…' else text end c from documents)",
}
