"""The queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmere.functions import keys
from leafmere.functions.extract import extracted, html_text, markdown_text
from leafmere.functions.text import STOP_WORDS, TOKEN, language, stems, tokens
from leafmere.operators import blobs, change_feed, chunks, indexes, log, schema, search
from leafmere.operators.cutting import new_folder
from leafmere.operators.filters import Field, Filter, parse_filter
from leafmere.operators.query import Collection
from leafmere.operators.running import running
from leafmere.sources import ndjson
from leafmere.sources.tables import verified
from leafmere.streaming import live

NOW_MS = 1_775_001_600_000
AS_OF = 1_768_000_000_000 << 16
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def filtered(name: str, source: str, key: str, condition: Filter, sql_condition: str, prepare: Callable[[DataFrame], DataFrame] | None = None, sql_source: str | None = None) -> None:
    """Register a query for the keys of ``source`` that a filter lets through."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return Collection(prepare(df) if prepare else df, key).where(condition).df().select(key)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"select {key} from {sql_source or source} where {sql_condition}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Collection(table(spark, sf_dir, "orders"), "o_orderkey")
    return orders.where(Field("o_orderstatus").equals("F")).order_by("o_totalprice", descending=True).limit(20).df()


# Filters over typed columns. Nulls are made by nullif, in the same way on both sides.
BAL = "nullif(c_mktsegment, 'BUILDING')"
with_null = lambda df: df.withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
SEG = f"(select *, {BAL} as seg from customer)"
words_of = lambda df: df.withColumn("words", F.split(F.col("p_name"), " "))
WORDS = "(select *, string_split(p_name, ' ') as words from part)"
filtered("filter_eq", "orders", "o_orderkey", Field("o_orderstatus").equals("F"), "o_orderstatus = 'F'")
filtered("filter_eq_ci", "customer", "c_custkey", Field("c_mktsegment").equals("building", case_sensitive=False), "lower(c_mktsegment) = 'building'")
filtered("filter_ne_null", "customer", "c_custkey", Field("seg").not_equals("MACHINERY"), "seg is distinct from 'MACHINERY'", with_null, SEG)
filtered("filter_cmp", "orders", "o_orderkey", Field("o_totalprice").is_greater_than(100000) & Field("o_custkey").is_less_than_or_equal_to(900.0), "o_totalprice > 100000 and o_custkey <= 900")
filtered("filter_between", "lineitem", "l_orderkey", Field("l_quantity").is_between(10, 20) & Field("l_linenumber").is_greater_than_or_equal_to(3), "l_quantity between 10 and 20 and l_linenumber >= 3")
filtered("filter_in_null", "customer", "c_custkey", Field("seg").is_in(["MACHINERY", None, 7]), "seg = 'MACHINERY' or seg is null", with_null, SEG)
filtered("filter_notin_null", "customer", "c_custkey", Field("seg").is_not_in(["MACHINERY", "HOUSEHOLD"]), "seg is null or seg not in ('MACHINERY', 'HOUSEHOLD')", with_null, SEG)
filtered("filter_isnull", "customer", "c_custkey", Field("seg").is_null(), "seg is null", with_null, SEG)
filtered("filter_isnotnull", "customer", "c_custkey", Field("seg").is_not_null(), "seg is not null", with_null, SEG)
filtered("filter_bool", "orders", "o_orderkey", Field("dear").is_true() & ~Field("old").is_false(), "o_totalprice > 150000 and o_orderdate < timestamp '1998-01-01'",
         lambda df: df.withColumn("dear", F.col("o_totalprice") > 150000).withColumn("old", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")))
filtered("filter_prefix", "part", "p_partkey", Field("p_type").starts_with("promo", case_sensitive=False), "starts_with(lower(p_type), 'promo')")
filtered("filter_suffix", "part", "p_partkey", Field("p_type").ends_with("UM"), "ends_with(p_type, 'UM')")
filtered("filter_contains", "documents", "doc_id", Field("text").contains("50%") | Field("text").contains("manifest"), "contains(text, '50%') or contains(text, 'manifest')")
filtered("filter_list_contains", "part", "p_partkey", Field("words[]").contains("ring"), "list_contains(words, 'ring')", words_of, WORDS)
filtered("filter_contains_all", "part", "p_partkey", Field("words").contains_all([]) & ~Field("words").contains_all(["red", "ring"]), "not list_has_all(words, ['red', 'ring'])", words_of, WORDS)
filtered("filter_contains_any", "part", "p_partkey", Field("words").contains_any(["red", "gear", "none"]), "list_has_any(words, ['red', 'gear', 'none'])", words_of, WORDS)
filtered("filter_and_or_not", "orders", "o_orderkey", Filter.any([Filter.all([Field("o_orderstatus").equals("O"), Filter.negate(Field("o_orderpriority").starts_with("1"))]), Field("o_totalprice").is_less_than(1000)]),
         "(o_orderstatus = 'O' and not starts_with(o_orderpriority, '1')) or o_totalprice < 1000")
filtered("filter_empty_and_or", "nation", "n_nationkey", Filter.all([]) & Filter.negate(Filter.any([])), "true")
filtered("filter_unlike_types", "orders", "o_orderkey", Field("o_totalprice").not_equals("12") & Filter.negate(Field("o_orderstatus").is_greater_than(3)) & Field("absent").not_equals(1), "true")
filtered("filter_json", "orders", "o_orderkey", parse_filter('{"and": [{"field": "o_orderstatus", "op": "in", "value": ["F", "P"]}, {"not": {"field": "o_totalprice", "op": "lt", "value": 50000}}, {"field": "o_orderpriority", "op": "contains", "value": "urgent", "insensitive": true}]}'),
         "o_orderstatus in ('F', 'P') and not o_totalprice < 50000 and contains(lower(o_orderpriority), 'urgent')")
filtered("filter_key_range_time", "kv_store", "kv_key", Field("hlc").is_greater_than(115_000_000_000_000_000), "hlc > 115000000000000000")

# The same predicates over VARIANT documents.
STORE = "(select distinct ns, kv_key, hlc, device_id, try_cast(body as json) as b from kv_store)"
docs_of = lambda df: df.distinct().select(F.concat_ws("/", "ns", "kv_key").alias("_id"), F.try_parse_json("body").alias("doc"))


def variant_query(name: str, condition: Filter, sql_condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Collection(docs_of(table(spark, sf_dir, "kv_store"))).where(condition).df().select("_id")

    QUERIES[name] = run
    SQL[name] = f"select ns || '/' || kv_key as _id from {STORE} where {sql_condition}"


NUM = "json_type(b, '$.{0}') in ('UBIGINT', 'BIGINT', 'DOUBLE')"
variant_query("variant_missing_vs_null", Field("city").is_null() & Field("title").is_not_null(), "(json_type(b, '$.city') is null or json_type(b, '$.city') = 'NULL') and json_type(b, '$.title') <> 'NULL'")
variant_query("variant_eq_number", Field("rev").equals(12.0), "coalesce(json_type(b, '$.rev') in ('UBIGINT', 'BIGINT', 'DOUBLE') and (b->>'$.rev')::double = 12, false)")
variant_query("variant_cmp", Field("score").is_greater_than(50) & Field("rev").is_between(5, 40), "coalesce((b->>'$.score')::double > 50 and (b->>'$.rev')::double between 5 and 40, false)")
variant_query("variant_ne_missing", Field("score").not_equals(50.6), "coalesce((b->>'$.score')::double <> 50.6, true)")
variant_query("variant_text", Field("title").starts_with("remote") | Field("title").contains("ARCHIVE", case_sensitive=False), "coalesce(starts_with(b->>'$.title', 'remote') or contains(lower(b->>'$.title'), 'archive'), false)")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 20")
def orderby_limit(spark, d):
    return flagship(spark, d).select("o_orderkey", "o_totalprice")


@query(f"select c_custkey from {SEG} order by seg asc nulls last, c_custkey limit 40 offset 1180")
def orderby_asc_nulls_last(spark, d):
    return Collection(with_null(table(spark, d, "customer")), "c_custkey").all().order_by("seg").offset(1180).limit(40).df().select("c_custkey")


@query(f"select c_custkey from {SEG} order by seg desc nulls first, c_custkey limit 40 offset 5")
def orderby_desc_nulls_first(spark, d):
    return Collection(with_null(table(spark, d, "customer")), "c_custkey").all().order_by("seg", descending=True).offset(5).limit(40).df().select("c_custkey")


@query("select * from (select row_number() over (order by try_cast(b->>'$.score' as double) desc nulls first, _id) as place, _id from (select ns || '/' || kv_key as _id, b from " + STORE + ")) where place <= 100")
def orderby_variant(spark, d):
    top = Collection(docs_of(table(spark, d, "kv_store"))).all().order_by("score", descending=True).limit(100).df()
    return running(top.withColumn("one", F.lit(1)).withColumn("g", F.lit(1)).withColumn("s", F.try_variant_get("doc", "$.score", "double")).drop("doc"), ["g"], [F.col("s").desc_nulls_first(), F.col("_id").asc()], {"n": ("sum", "one")}).select((F.coalesce("n", F.lit(0)) + 1).alias("place"), "_id")


@query("select o_orderkey from orders order by o_orderkey limit 30 offset 100")
def offset_limit(spark, d):
    return Collection(table(spark, d, "orders"), "o_orderkey").all().offset(100).limit(30).df().select("o_orderkey")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'P' order by o_orderkey limit 1")
def first_match(spark, d):
    return Collection(table(spark, d, "orders"), "o_orderkey").where(Field("o_orderstatus").equals("P")).limit(1).df().select("o_orderkey", "o_totalprice")


@query("select count(*) as n from orders where o_orderstatus = 'O'")
def count_filtered(spark, d):
    return Collection(table(spark, d, "orders"), "o_orderkey").where(Field("o_orderstatus").equals("O")).count_df()


@query("select count(*) as n from (select * from orders where o_orderstatus = 'O' limit 25 offset 10)")
def count_limited(spark, d):
    return Collection(table(spark, d, "orders"), "o_orderkey").where(Field("o_orderstatus").equals("O")).offset(10).limit(25).count_df()


@query("select count(*) as scanned, count(*) filter (o_orderstatus = 'O') as matched from orders")
def explain_counters(spark, d):
    return Collection(table(spark, d, "orders"), "o_orderkey").where(Field("o_orderstatus").equals("O")).counters()


@query("select distinct kv_key from kv_store where starts_with(kv_key, '019a')")
def key_prefix(spark, d):
    return Collection(table(spark, d, "kv_store").select("kv_key").distinct(), "kv_key").all().key_prefix("019a").df()


@query("select distinct ns, kv_key from kv_store where kv_key >= '0190' and kv_key < '0192'")
def key_range(spark, d):
    return Collection(table(spark, d, "kv_store"), "kv_key").range("0190", "0192").select("ns", "kv_key").distinct()


@query("select k.c_custkey * 3 as o_orderkey, o_totalprice from customer k left join orders on o_orderkey = k.c_custkey * 3")
def get_many(spark, d):
    wanted = table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("k"))
    return Collection(table(spark, d, "orders"), "o_orderkey").get_many(wanted).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice as \"price\" from orders")
def project_flat(spark, d):
    return Collection(table(spark, d, "orders"), "o_orderkey").all().select("o_orderkey", "o_totalprice", "absent").df().withColumnRenamed("o_totalprice", "price")


@query("select event_id, user_id as uid, value as val from events")
def project_nested(spark, d):
    nested = table(spark, d, "events").select("event_id", F.struct("user_id", F.struct("value").alias("inner")).alias("who"))
    out = Collection(nested, "event_id").all().select("event_id", "who.user_id", "who.inner.value", nested=True).df()
    return out.select("event_id", F.col("who.user_id").alias("uid"), F.col("who.inner.value").alias("val"))


@query("select p_partkey, words[1] as first_word, words[-1] as last_word from " + WORDS)
def path_index_negative(spark, d):
    out = Collection(words_of(table(spark, d, "part")), "p_partkey").all().select("p_partkey", "words[0]", "words[-1]").df()
    return out.toDF("p_partkey", "first_word", "last_word")


@query("select event_id, cast(props::json->>'$.k' as bigint) as k from events")
def path_variant(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# Text search.
RX = TOKEN.replace("'", "''")
TERM_SQL = f"""
with words as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{RX}'), lambda w: w not in ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) as term from documents),
tfs as (select doc_id, term, count(*) as tf from words group by all),
lens as (select doc_id, sum(tf) as dl from tfs group by all),
stats as (select count(*) as n, sum(dl) as total from lens)
"""


def score_sql(terms: list[str], candidates: str = "true") -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""{TERM_SQL}, hits as (select * from tfs where term in ({wanted}) and doc_id in (select doc_id from documents where {candidates})),
found as (select term, count(*) as df from hits group by all),
scored as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))) as score
  from hits join found using (term) join lens using (doc_id) cross join stats group by doc_id)"""


@query(TERM_SQL + "select doc_id, term, tf from tfs")
def term_freq(spark, d):
    return search.postings(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


@query(TERM_SQL + "select n, cast(total as bigint) as total from stats")
def corpus_stats(spark, d):
    return search.corpus(table(spark, d, "documents"), "doc_id", "text")


@query(score_sql(["manifest", "archive", "teacher"]) + " select doc_id, round(score, 6) as score from scored")
def bm25_single(spark, d):
    out = search.field_scores(table(spark, d, "documents"), "doc_id", "text", "The manifest, an archive & teacher manifest")
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(score_sql(["manifest", "archive"]) + " select doc_id, round(score, 6) as score, rank from (select *, row_number() over (order by score desc, doc_id) as rank from scored) where rank > 10 and rank <= 30")
def bm25_paged(spark, d):
    out = search.lexical(table(spark, d, "documents"), "doc_id", ["text"], "manifest archive", limit=20, offset=10)
    return out.select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(score_sql(["manifest", "weather"], "lang = 'en'") + " select doc_id, round(score, 6) as score from scored")
def bm25_prefiltered(spark, d):
    docs = table(spark, d, "documents")
    out = search.field_scores(docs, "doc_id", "text", "manifest weather", docs.where("lang = 'en'"))
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(score_sql(["manifest"]).replace("with words", "with words", 1) + f""", src_words as (select doc_id, unnest(regexp_extract_all(lower(source), '{RX}')) as term from documents),
s_tf as (select doc_id, term, count(*) as tf from src_words group by all), s_len as (select doc_id, sum(tf) as dl from s_tf group by all), s_stats as (select count(*) as n, sum(dl) as total from s_len),
s_hits as (select * from s_tf where term = 'manifest' or term = 'vault'), s_df as (select term, count(*) as df from s_hits group by all),
t_hits as (select * from tfs where term in ('manifest', 'vault')), t_df as (select term, count(*) as df from t_hits group by all),
t_scored as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))) as score from t_hits join t_df using (term) join lens using (doc_id) cross join stats group by doc_id),
s_scored as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))) as score from s_hits join s_df using (term) join s_len using (doc_id) cross join s_stats group by doc_id)
select doc_id, round(max(score), 6) as score from (select * from t_scored union all select * from s_scored) group by doc_id""")
def bm25_multifield(spark, d):
    out = search.lexical(table(spark, d, "documents"), "doc_id", ["text", "source"], "manifest vault", limit=None)
    return out.select("doc_id", F.round("score", 6).alias("score"))


QV = search.unit([float((i * 37) % 11 - 5) for i in range(64)])
COS_SQL = f"""
with sq as (select vec_id, list_transform(embedding, lambda f: greatest(0, least(255, cast(round((f::double + 1) / 2 * 255) as int))) / 255.0::double * 2 - 1) as v from embeddings where len(embedding) = 64),
cos as (select vec_id, round(list_inner_product(v, {QV}::double[]), 9) as score from sq)
"""


@query("select vec_id, list_sum(list_transform(embedding, lambda f: greatest(0, least(255, cast(round((f::double + 1) / 2 * 255) as int)))))::bigint as units from embeddings")
def sq8_sum(spark, d):
    units = search.quantised(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(units, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("units"))


@query(COS_SQL + "select vec_id, round(score, 6) + 0 as score from cos")
def cosine_all(spark, d):
    return search.cosine_scores(table(spark, d, "embeddings"), "vec_id", "embedding", QV).select("vec_id", F.round("score", 6).alias("score"))


@query(COS_SQL + "select vec_id, round(score, 6) + 0 as score from cos order by score desc, vec_id limit 100")
def cosine_topk(spark, d):
    return search.semantic(table(spark, d, "embeddings"), "vec_id", "embedding", QV, top=100).select("vec_id", F.round("score", 6).alias("score"))


@query(score_sql(["manifest", "archive"]) + ", " + COS_SQL.replace("\nwith ", "", 1) + """,
lex as (select doc_id, row_number() over (order by score desc, doc_id) as r from scored), sem as (select vec_id as doc_id, row_number() over (order by score desc, vec_id) as r from cos),
both_legs as (select * from lex where r <= 100 union all select * from sem where r <= 100)
select doc_id, round(sum(1.0::double / (60 + r)), 6) as score from both_legs group by doc_id""")
def rrf_hybrid(spark, d):
    docs = table(spark, d, "documents")
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    hits, _ = search.search(docs, "doc_id", "manifest archive", text_fields=("text",), vectors=vectors, vec="embedding", query_vector=QV, limit=1000)
    return hits.select("doc_id", F.round("score", 6).alias("score"))


# The mutation log, read from the change feed.
LOG = """
with log as (select distinct ns, lower(replace(doc_key, '-', '')) as _id, hlc, case when lower(trim(change_type)) = 'deleted' then 'delete' else 'put' end as op, device_id
  from sync_delta where doc_key is not null and change_type is not null and hlc is not null),
newest as (select * from log qualify row_number() over (partition by ns, _id order by hlc desc, device_id desc, op) = 1)
"""


def log_of(spark: SparkSession, d: str) -> DataFrame:
    rows = change_feed.change_rows(table(spark, d, "sync_delta"))
    return rows.select("ns", F.col("key").alias("_id"), "hlc", F.when(F.col("deleted"), "delete").otherwise("put").alias("op"), "device_id")


def live_sql(condition: str) -> str:
    return f"(select * from log where {condition} qualify row_number() over (partition by ns, _id order by hlc desc, device_id desc, op) = 1)"


@query("""with v as (select ns, lower(replace(kv_key, '-', '')) as kv_key, hlc, device_id, false as gone from kv_store
  union all select ns, lower(replace(doc_key, '-', '')), hlc, device_id, lower(trim(change_type)) = 'deleted' from sync_delta
  where doc_key is not null and change_type is not null and hlc is not null),
w as (select *, row_number() over (partition by ns, kv_key order by hlc desc nulls last, device_id desc nulls last, gone desc) as r from v)
select ns, kv_key, hlc from w where r = 1 and not gone""")
def p3_found(spark, d):
    return change_feed.current_records(table(spark, d, "kv_store"), table(spark, d, "sync_delta")).select("ns", "kv_key", "hlc")


@query(LOG + "select ns, _id, hlc, op, device_id from log")
def log_merge(spark, d):
    rows = log_of(spark, d)
    return log.merged(rows.where("device_id < '8'"), rows.where("device_id >= '8'"), rows)


@query(LOG + "select ns, _id, hlc, op, device_id from newest where op <> 'delete'")
def lww_snapshot(spark, d):
    return log.snapshot(log_of(spark, d))


@query(LOG + f"select ns, _id, hlc from {live_sql(f'hlc <= {AS_OF}')} where op <> 'delete'")
def as_of_snapshot(spark, d):
    return log.as_of(log_of(spark, d), AS_OF).select("ns", "_id", "hlc")


@query(LOG + "select ns, _id, hlc, op, device_id from log where _id = '019a4c7de3107b2c9f46d0a85e31c7b4'")
def version_history(spark, d):
    return log.history(log.merged(log_of(spark, d)), "019a4c7de3107b2c9f46d0a85e31c7b4", newest_first=True)


@query(LOG + f"""select ns, _id, hlc, op, device_id from (select *, row_number() over w as r, first_value(op) over w as last_op, {NOW_MS} - first_value(hlc >> 16) over w as last_age from log window w as (partition by ns, _id order by hlc desc, device_id desc))
where (r <= 4 or {NOW_MS} - (hlc >> 16) <= 7776000000) and not (last_op = 'delete' and last_age > 7776000000)""")
def retention_versions_or_days(spark, d):
    return log.retained(log.merged(log_of(spark, d)), NOW_MS, 4, 90)


@query(LOG + "select ns, _id, hlc, op, device_id from log qualify row_number() over (partition by ns, _id order by hlc desc, device_id desc) <= 2")
def retention_versions(spark, d):
    return log.retained(log.merged(log_of(spark, d)), NOW_MS, 2, None)


@query(LOG + f"select ns, _id, hlc, op from newest where not (op = 'delete' and hlc < {AS_OF})")
def compaction_tombstone_gc(spark, d):
    return log.compacted(log_of(spark, d), AS_OF).select("ns", "_id", "hlc", "op")


@query(LOG + f"select min(h) as horizon from (select device_id, max(hlc) as h from log group by all) where (h >> 16) >= {NOW_MS} - 7776000000 or device_id = '0b7e41d2'")
def gc_horizon(spark, d):
    marks = log_of(spark, d).groupBy("device_id").agg(F.max("hlc").alias("current_hlc"))
    return log.gc_horizon(marks, NOW_MS, "0b7e41d2")


MARKS = f"(select device_id, max(hlc) as hwm from log where hlc <= {AS_OF} and device_id < 'a' group by all)"


@query(LOG + f"select ns, _id, hlc, device_id from log left join {MARKS} using (device_id) where hlc > coalesce(hwm, 0)")
def hwm_incremental(spark, d):
    rows = log.merged(log_of(spark, d))
    marks = rows.where((F.col("hlc") <= AS_OF) & (F.col("device_id") < "a")).groupBy("device_id").agg(F.max("hlc").alias("hwm"))
    return log.pulled(rows, marks).select("ns", "_id", "hlc", "device_id")


@query(LOG + f", marks as (select device_id, max(hlc) as current_hlc from log group by all) select device_id, current_hlc, coalesce((current_hlc >> 16) < {NOW_MS} and current_hlc < (select min(current_hlc) from marks where (current_hlc >> 16) >= {NOW_MS}), false) as evicted from marks")
def eviction(spark, d):
    marks = log_of(spark, d).groupBy("device_id").agg(F.max("hlc").alias("current_hlc"))
    return log.evicted(marks, NOW_MS, 0)


@query(LOG + f"select ns, _id, hlc from log where hlc > {AS_OF} and (hlc >> 16) <= {NOW_MS - 2000000000} + 60000")
def resurrection_and_drift_guard(spark, d):
    return log.accepted(log.merged(log_of(spark, d)), AS_OF, NOW_MS - 2_000_000_000).select("ns", "_id", "hlc")


@query("""with w as (select distinct ns, lower(replace(doc_key, '-', '')) as _id, device_id, delta_id * 1000 + entry_no as seq, hlc from sync_delta where doc_key is not null and change_type is not null and hlc is not null),
devices as (select distinct device_id from w),
pairs as (select ns, _id, seq as seq_a, w.device_id as device_a, hlc as hlc_a, d.device_id as device_b,
  max(case when w.device_id = d.device_id then seq end) over p as seq_b,
  arg_max(case when w.device_id = d.device_id then hlc end, case when w.device_id = d.device_id then seq end) over p as hlc_b
  from w cross join devices d window p as (partition by ns, _id, d.device_id order by seq rows between unbounded preceding and 1 preceding))
select ns, _id, seq_a, device_a, seq_b, device_b, case when hlc_a > hlc_b or (hlc_a = hlc_b and device_a > device_b) then device_a else device_b end as winner from pairs where seq_b is not null and device_a <> device_b""")
def fork_detection(spark, d):
    feed = table(spark, d, "sync_delta").where("doc_key is not null and change_type is not null and hlc is not null")
    writes = feed.select("ns", change_feed.plain_key(F.col("doc_key")).alias("_id"), "device_id", (F.col("delta_id") * 1000 + F.col("entry_no")).alias("seq"), "hlc").distinct()
    return log.forks(writes)


@query(LOG + f", seen as (select * from log where device_id = '0b7e41d2' or hlc <= {AS_OF}) select ns, _id, hlc from seen qualify row_number() over (partition by ns, _id order by hlc desc, device_id desc, op) = 1 and op <> 'delete'")
def device_view(spark, d):
    rows = log_of(spark, d).withColumn("push_seq", F.col("hlc"))
    cursors = rows.select("device_id").distinct().withColumn("cursor", F.lit(AS_OF))
    return log.visible(rows, "0b7e41d2", cursors).select("ns", "_id", "hlc")


@query(LOG + f", a as (select ns || '/' || _id as _id, hlc from {live_sql(f'hlc <= {AS_OF}')} where op <> 'delete'), b as (select ns || '/' || _id as _id, hlc from newest where op <> 'delete') select _id, case when a.hlc is null then 'added' when b.hlc is null then 'deleted' else 'updated' end as change from a full join b using (_id) where a.hlc is distinct from b.hlc")
def snapshot_delta(spark, d):
    rows = log_of(spark, d)
    whole = lambda s: s.select(F.concat_ws("/", "ns", "_id").alias("_id"), "hlc")
    return log.delta(whole(log.as_of(rows, AS_OF)), whole(log.snapshot(rows)))


@query(LOG + "select ns, _id, cast(hlc as bigint) as promoted_from, op from log where _id = '019a4c7de3107b2c9f46d0a85e31c7b4' and hlc = (select min(hlc) from log where _id = '019a4c7de3107b2c9f46d0a85e31c7b4' and op = 'put')")
def promote_version(spark, d):
    rows = log.merged(log_of(spark, d))
    key = "019a4c7de3107b2c9f46d0a85e31c7b4"
    oldest = rows.where((F.col("_id") == key) & (F.col("op") == "put")).agg(F.min("hlc")).first()[0]
    return log.promoted(rows, key, oldest, (NOW_MS << 16) + 1, "0b7e41d2").select("ns", "_id", "promoted_from", "op")


@query("select hlc, hlc >> 16 as millis, cast(hlc & 65535 as int) as counter, lower(lpad(to_hex(hlc), 16, '0')) as hex from (select distinct hlc from kv_store)")
def hlc_parts(spark, d):
    hlc = F.col("hlc")
    return table(spark, d, "kv_store").select("hlc").distinct().select("hlc", keys.hlc_millis(hlc).alias("millis"), keys.hlc_counter(hlc).alias("counter"), keys.hlc_hex(hlc).alias("hex"))


@query("select distinct kv_key, regexp_full_match(kv_key, '[0-9a-f]{12}7[0-9a-f]{3}[89ab][0-9a-f]{15}') as ok, case when regexp_full_match(kv_key, '[0-9a-f]{12}7[0-9a-f]{3}[89ab][0-9a-f]{15}') then cast('0x' || kv_key[1:12] as bigint) end as millis from kv_store")
def key_parts(spark, d):
    key = F.col("kv_key")
    return table(spark, d, "kv_store").select("kv_key").distinct().select("kv_key", keys.is_key(key).alias("ok"), keys.key_millis(key).alias("millis"))


@query("select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 100000 then 'closed' else o_orderpriority end as o_orderpriority, case when o_orderstatus = 'F' and o_totalprice > 100000 then true end as archived from orders")
def bulk_update_merge(spark, d):
    orders = table(spark, d, "orders")
    where = (Field("o_orderstatus").equals("F") & Field("o_totalprice").is_greater_than(100000)).on(orders.schema)
    return log.updated(orders, {"o_orderpriority": F.lit("closed"), "archived": F.lit(True)}, where).select("o_orderkey", "o_orderpriority", "archived")


def import_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    store = table(spark, d, "kv_store").select(F.concat_ws("/", "ns", "kv_key").alias("_id"), "hlc").distinct()
    incoming = log.snapshot(log_of(spark, d)).select(F.concat_ws("/", "ns", "_id").alias("_id"), "hlc")
    return store, incoming


SIDES = LOG + ", a as (select distinct ns || '/' || kv_key as _id, hlc from kv_store), b as (select ns || '/' || _id as _id, hlc from newest where op <> 'delete') "


@query(SIDES + "select _id, hlc from b union all select _id, hlc from a where _id not in (select _id from b)")
def import_replace(spark, d):
    return ndjson.imported(*import_sides(spark, d), "replace")


@query(SIDES + "select _id, hlc from a union all select _id, hlc from b where _id not in (select _id from a)")
def import_ignore(spark, d):
    return ndjson.imported(*import_sides(spark, d), "ignore")


ARRIVALS = """with b as (select ns || '/' || lower(replace(doc_key, '-', '')) as _id, hlc, delta_id * 1000 + entry_no as place from sync_delta where doc_key is not null),
a as (select distinct ns || '/' || kv_key as _id, hlc from kv_store) """


def arrivals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The store and every entry of the change feed as a line to import, in order of arrival."""
    store = table(spark, d, "kv_store").select(F.concat_ws("/", "ns", "kv_key").alias("_id"), "hlc").distinct()
    feed = table(spark, d, "sync_delta").where("doc_key is not null")
    return store, feed.select(F.concat_ws("/", "ns", change_feed.plain_key(F.col("doc_key"))).alias("_id"), "hlc", (F.col("delta_id") * 1000 + F.col("entry_no")).alias("at"))


@query(ARRIVALS + "select _id, (array_agg(hlc order by place desc))[1] as hlc from b group by _id union all select _id, hlc from a where _id not in (select _id from b)")
def import_last_wins(spark, d):
    """Of several lines of a key the last one counts."""
    return ndjson.imported(*arrivals(spark, d), "replace")


@query(ARRIVALS + "select _id, hlc from a union all select _id, (array_agg(hlc order by place))[1] as hlc from b where _id not in (select _id from a) group by _id")
def import_first_wins(spark, d):
    return ndjson.imported(*arrivals(spark, d), "ignore")


@query(LOG + ", k as (select distinct kv_key as _id from kv_store) select ns, _id, op from (select 'n' as ns, _id, 'delete' as op from newest semi join k using (_id) where ns = (select min(ns) from log) and op <> 'delete') group by all")
def delete_existing(spark, d):
    """Deletions of the store's keys that one namespace still has."""
    rows = log_of(spark, d)
    ns = rows.agg(F.min("ns")).select(F.col("min(ns)").alias("first"))
    current = log.snapshot(rows).join(F.broadcast(ns), F.col("ns") == F.col("first"), "left_semi").withColumn("ns", F.lit("n"))
    keys_of = table(spark, d, "kv_store").select(F.col("kv_key").alias("_id"))
    return log.deletions(keys_of, current, "n", NOW_MS << 16, "me").select("ns", "_id", "op")


@query(LOG + "select ns, count(*) as mutations, count(distinct _id) as records, min(hlc) as least_hlc, max(hlc) as most_hlc from log group by ns")
def log_statistics(spark, d):
    rows = log.merged(log_of(spark, d))
    return rows.groupBy("ns").agg(F.count("*").alias("mutations"), F.countDistinct("_id").alias("records"), F.min("hlc").alias("least_hlc"), F.max("hlc").alias("most_hlc"))


@query("select r_name as collection, n_nationkey as n from nation join region on n_regionkey = r_regionkey")
def restore_headers(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    heads = region.select(F.concat(F.lit("# collection: "), "r_name").alias("line"), (F.col("r_regionkey") * 1000).alias("n"))
    body = nation.select(F.to_json(F.struct("n_nationkey")).alias("line"), (F.col("n_regionkey") * 1000 + 10 + F.col("n_nationkey")).alias("n"))
    notes = region.select(F.lit("# a note").alias("line"), (F.col("r_regionkey") * 1000 + 5).alias("n"))
    out = ndjson.restored(heads.unionAll(body).unionAll(notes))
    return out.select("collection", F.get_json_object("line", "$.n_nationkey").cast("int").alias("n"))


@query("select count(*) as checked, count(*) filter (body is null or not json_valid(body)) as errors from kv_store")
def verify_documents(spark, d):
    return verified(table(spark, d, "kv_store"), "kv_key", "body")


SCHEMA = {"type": "object", "required": ["c_name", "seg"], "properties": {"c_acctbal": {"type": "number", "minimum": 0, "exclusiveMaximum": 9000}, "seg": {"type": "string", "enum": ["MACHINERY", "HOUSEHOLD", "FURNITURE"]}, "c_name": {"type": "string", "maxLength": 18, "pattern": "^Customer#"}, "c_nationkey": {"type": "integer"}}}


@query(f"""with c as {SEG} select c_custkey, '$.seg' as path, 'is required' as message from c where seg is null
union all select c_custkey, '$.c_acctbal', 'must be at least 0' from c where c_acctbal < 0
union all select c_custkey, '$.c_acctbal', 'must be below 9000' from c where c_acctbal >= 9000
union all select c_custkey, '$.seg', 'must be one of the allowed values' from c where seg not in ('MACHINERY', 'HOUSEHOLD', 'FURNITURE')
union all select c_custkey, '$.c_name', 'must have at most 18 characters' from c where length(c_name) > 18
union all select c_custkey, '$.c_name', 'must match ^Customer#' from c where not regexp_matches(c_name, '^Customer#')""")
def schema_violations(spark, d):
    checked = schema.validated(with_null(table(spark, d, "customer")), SCHEMA)
    return checked.select("c_custkey", F.explode("violations").alias("v")).select("c_custkey", "v.path", "v.message")


# Blobs.
FILES = "(select distinct sha256, extracted_text from vault_index_result where extracted_text is not null)"


def files_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vault_index_result").where("extracted_text is not null").select("sha256", "extracted_text").distinct()


CHUNKS = f"""
with files as (select sha256, regexp_extract_all(extracted_text, '{RX}') as words from {FILES}),
windows as (select sha256, words, unnest(range(0, case when len(words) = 0 then 0 when len(words) <= 300 then 1 else 1 + cast(ceil((len(words) - 300) / 250.0) as bigint) end)) as chunk from files),
chunks as (select sha256, chunk, words[chunk * 250 + 1 : chunk * 250 + 300] as words from windows)
"""


@query(CHUNKS + "select sha256, cast(chunk as int) as chunk, cast(len(words) as int) as word_count, words[1] as first_word, words[-1] as last_word from chunks")
def chunk_windows(spark, d):
    out = chunks.chunks(files_of(spark, d), "sha256", "extracted_text")
    return out.select("sha256", "chunk", "word_count", F.get("words", F.lit(0)).alias("first_word"), F.element_at("words", -1).alias("last_word"))


@query(f"select count(*) as n, cast(sum(len(extracted_text)) as bigint) as signs from {FILES} where len(regexp_extract_all(extracted_text, '{RX}')) between 1 and 300")
def chunk_spans(spark, d):
    """Texts of one window, whose span and what stands around it make up the whole text again."""
    files = files_of(spark, d)
    one = chunks.chunks(files, "sha256", "extracted_text").join(files, "sha256")
    raw = F.encode("extracted_text", "UTF-8")
    again = F.concat(F.substring(raw, F.lit(1), F.col("byte_start")), F.encode("chunk_text", "UTF-8"), F.substring(raw, F.col("byte_end") + 1, F.octet_length(raw)))
    one = one.where((F.col("chunk") == 0) & (F.col("end_word") == F.size("words")) & (F.size("words") == F.size(F.regexp_extract_all("extracted_text", F.lit(TOKEN), F.lit(0)))))
    return one.where(F.decode(again, "UTF-8") == F.col("extracted_text")).agg(F.count("*").alias("n"), F.sum(F.length("extracted_text")).alias("signs"))


@query(f"""
with files as (select sha256, regexp_extract_all(extracted_text, '{RX}') as words, regexp_extract_all(extracted_text, '(?s).*?{RX}') as parts from {FILES}),
sized as (select *, len(words) as n, list_transform(parts, lambda p: strlen(p)) as lens from files),
windows as (select *, unnest(range(0, case when n = 0 then 0 when n <= 300 then 1 else 1 + cast(ceil((n - 300) / 250.0) as bigint) end)) as chunk from sized),
places as (select *, chunk * 250 as s, least(n, chunk * 250 + 300) as e from windows)
select sha256, cast(chunk as int) as chunk, cast(list_sum(lens[1 : s + 1]) - strlen(words[s + 1]) as int) as byte_start, cast(list_sum(lens[1 : e]) as int) as byte_end,
  md5(words[s + 1] || array_to_string(parts[s + 2 : e], '')) as text_md5 from places""")
def chunk_bytes(spark, d):
    """Byte spans and contents of all windows of all texts."""
    out = chunks.chunks(files_of(spark, d), "sha256", "extracted_text")
    return out.select("sha256", "chunk", "byte_start", "byte_end", F.md5("chunk_text").alias("text_md5"))


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
BLOB_BM25 = CHUNKS + f""", terms as (select sha256, chunk, len(words) as dl, list_filter(regexp_extract_all(lower(array_to_string(words, ' ')), '{RX}'), lambda w: w not in ({STOP})) as terms from chunks),
stats as (select sha256, count(*) as n, sum(len(terms)) as total from terms group by all),
tfs as (select sha256, chunk, dl, term, count(*) as tf from (select sha256, chunk, dl, unnest(terms) as term from terms) where term in ('manifest', 'kitchen') group by all),
dfs as (select sha256, term, count(*) as df from tfs group by all),
best as (select sha256, term, max(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))) as s from tfs join dfs using (sha256, term) join stats using (sha256) group by all),
scores as (select sha256, sum(s) as score from best group by all)
"""


@query(BLOB_BM25 + "select sha256, round(score, 6) as score from scores")
def blob_bm25(spark, d):
    out = chunks.blob_bm25(chunks.chunks(files_of(spark, d), "sha256", "extracted_text"), "sha256", "manifest kitchen")
    return out.select("sha256", F.round("score", 6).alias("score"))


def items_of(spark: SparkSession, d: str) -> DataFrame:
    """Work items as documents that refer to their file."""
    return table(spark, d, "vault_work_item").select(F.col("item_id").alias("_id"), F.to_json(F.struct(F.struct(F.concat(F.lit(blobs.SCHEME), "sha256").alias("uri"), "media_type").alias("file"))).alias("doc"))


@query(BLOB_BM25 + ", refs as (select distinct item_id as _id, sha256 from vault_work_item) select _id, sha256, round(score, 6) as score from refs join scores using (sha256)")
def blob_hits(spark, d):
    scores = chunks.blob_bm25(chunks.chunks(files_of(spark, d), "sha256", "extracted_text"), "sha256", "manifest kitchen")
    return chunks.best_blob(scores, blobs.reference_rows(items_of(spark, d)), limit=None).select("_id", "sha256", F.round("score", 6).alias("score"))


@query("select item_id as _id, sha256 from (select item_id, sha256 from vault_work_item)")
def uri_refs(spark, d):
    return blobs.reference_rows(items_of(spark, d))


@query("select distinct item_id as _id, sha256, '$.file.uri' as path from vault_work_item")
def uri_paths(spark, d):
    return blobs.reference_paths(items_of(spark, d))


@query("select sha256, count(distinct item_id) as n from vault_work_item group by sha256")
def ref_counts(spark, d):
    return blobs.reference_counts(blobs.reference_rows(items_of(spark, d)))


@query("select distinct sha256 from vault_work_item where sha256 not in (select sha256 from vault_index_result where err is not null)")
def gc_candidates(spark, d):
    all_blobs = table(spark, d, "vault_work_item").select("sha256").distinct()
    return blobs.garbage(all_blobs, table(spark, d, "vault_index_result").where("err is not null").select("sha256"))


@query("with s as (select sha256, case when bool_or(extracted_text is not null) then 'indexed' else 'failed' end as state from vault_index_result group by all) select coalesce(state, 'pending') as state, count(*) as n from (select distinct sha256 from vault_work_item) left join s using (sha256) group by 1")
def status_counts(spark, d):
    have = table(spark, d, "vault_work_item").groupBy("sha256").agg(F.max(F.col("blob_bytes").isNotNull()).alias("present"))
    states = table(spark, d, "vault_index_result").groupBy("sha256").agg(F.when(F.max(F.col("extracted_text").isNotNull()), "indexed").otherwise("failed").alias("state"))
    return blobs.indexing_states(have, states)


WORD_SHARE = "list_transform(['manifest', 'kitchen', 'archive', 'weather'], lambda t: len(list_filter(words, lambda w: lower(w) = t)) + case when t = 'weather' then 1 else 0 end)"
BLOB_COS = f""", raw as (select sha256, {WORD_SHARE}::double[] as v from chunks), unit_v as (select sha256, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from raw),
sq as (select sha256, list_transform(v, lambda f: greatest(0, least(255, cast(round((f + 1) / 2 * 255) as int))) / 255.0::double * 2 - 1) as v from unit_v),
near as (select sha256, max(round(list_inner_product(v, {search.unit([1.0, 2.0, 0.0, 0.0])}::double[]), 9)) as score from sq group by all)
"""


def chunk_vectors(chunked: DataFrame) -> DataFrame:
    """A small bag-of-words vector of each chunk, in place of a model's embedding."""
    count = lambda t, plus: F.size(F.filter("words", lambda w: F.lower(w) == t)) + plus
    raw = F.array(*[count(t, 1 if t == "weather" else 0).cast("double") for t in ("manifest", "kitchen", "archive", "weather")])
    vectors = chunked.select("sha256", raw.alias("v"))
    return vectors.select("sha256", F.transform("v", lambda x: x / F.sqrt(search.dot(F.col("v"), F.col("v")))).alias("vec"))


@query(CHUNKS + BLOB_COS + "select sha256, round(score, 6) as score from near")
def blob_vector_max(spark, d):
    vectors = chunk_vectors(chunks.chunks(files_of(spark, d), "sha256", "extracted_text"))
    return chunks.blob_cosine(vectors, "sha256", "vec", [1.0, 2.0, 0.0, 0.0]).select("sha256", F.round("score", 6).alias("score"))


@query(BLOB_BM25 + BLOB_COS + """, legs as (select sha256, row_number() over (order by round(score, 9) desc, sha256) as r from scores union all select sha256, row_number() over (order by score desc, sha256) as r from near),
fused as (select sha256, sum(1.0::double / (60 + r)) as score from legs where r <= 100 group by sha256), refs as (select distinct item_id as _id, sha256 from vault_work_item)
select _id, sha256, round(score, 6) as score from refs join fused using (sha256)""")
def blob_rrf(spark, d):
    chunked = chunks.chunks(files_of(spark, d), "sha256", "extracted_text")
    hits = chunks.search_blobs(chunked, blobs.reference_rows(items_of(spark, d)), "manifest kitchen", chunk_vectors(chunked), [1.0, 2.0, 0.0, 0.0], limit=None)
    return hits.select("_id", "sha256", F.round("score", 6).alias("score"))


@query(LOG + "select ns, _id, hlc, op from newest")
def streaming_lww(spark, d):
    """The newest version of each record, kept by a streaming query over the log's files."""
    folder = new_folder(spark, "streaming-lww")
    log_of(spark, d).write.parquet(f"{folder}/log")
    rows = live.log_stream(spark, f"{folder}/log", "ns string, _id string, hlc bigint, op string, device_id string", files_a_batch=64)
    live.current_table(rows, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return live.current_rows(spark, f"{folder}/state", rows.schema).select("ns", "_id", "hlc", "op")


@query("select ns, count(distinct kv_key) as n from kv_store group by ns")
def watch_stream(spark, d):
    """A live count by namespace, evaluated again after each batch of a log; the last result is given."""
    folder = new_folder(spark, "watch")
    rows = table(spark, d, "kv_store").select(F.lit("all").alias("ns"), F.concat_ws("/", "ns", "kv_key").alias("_id"), "hlc", F.lit("put").alias("op"), "device_id")
    rows.write.parquet(f"{folder}/log")
    stream = live.log_stream(spark, f"{folder}/log", rows.schema)
    count = lambda docs: docs.groupBy(F.split_part("_id", F.lit("/"), F.lit(1)).alias("ns")).agg(F.count("*").alias("n"))
    live.watch(stream, f"{folder}/log", "all", count, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("select distinct ns || '/' || kv_key as _id, json_extract_string(body, '$.title') as title from kv_store where body is not null")
def ndjson_roundtrip(spark, d):
    """The store's documents exported as NDJSON and read again."""
    folder = new_folder(spark, "ndjson")
    ndjson.export(docs_of(table(spark, d, "kv_store").where("body is not null")).select("_id", "doc"), folder)
    return ndjson.read_documents(spark, folder).select("_id", F.try_variant_get("doc", "$.title", "string").alias("title"))


@query(score_sql(["manifest", "archive", "teacher"]) + " select doc_id, round(score, 6) as score from scored")
def indexed_search(spark, d):
    """BM25 from a stored index, without reading a text."""
    index = indexes.TextIndex(spark, new_folder(spark, "index"), "text", "doc_id")
    index.build(table(spark, d, "documents").select("doc_id", "text"))
    return index.scores("manifest archive teacher").select("doc_id", F.round("score", 6).alias("score"))


def changed_index(spark: SparkSession, d: str) -> indexes.TextIndex:
    """An index over all documents with a word added, after which the English ones lost it and those of no language went."""
    docs = table(spark, d, "documents")
    index = indexes.TextIndex(spark, new_folder(spark, "index"), "text", "doc_id")
    index.build(docs.select("doc_id", F.concat("text", F.lit(" manifest")).alias("text")))
    index.sync(docs.where("lang = 'en'").select("doc_id", "text"))
    index.sync(docs.where("lang = 'und'").select("doc_id", F.lit(None).cast("string").alias("text")))
    return index


CHANGED_SQL = score_sql(["manifest", "archive", "teacher"]).replace("from documents)", "from (select doc_id, case when lang = 'en' then text else text || ' manifest' end as text from documents where lang is distinct from 'und'))", 1) + " select doc_id, round(score, 6) as score from scored"


@query(CHANGED_SQL)
def indexed_search_overlay(spark, d):
    """Overlays replace changed documents and take deleted ones away; totals follow."""
    return changed_index(spark, d).scores("manifest archive teacher").select("doc_id", F.round("score", 6).alias("score"))


@query(CHANGED_SQL)
def index_compacted(spark, d):
    """The same after the overlays went into the base."""
    index = changed_index(spark, d)
    index.compact()
    return index.scores("manifest archive teacher").select("doc_id", F.round("score", 6).alias("score"))


@query()
def html_extraction(spark, d):
    return table(spark, d, "vault_work_item").where("lower(media_type) like 'text/html%'").select("item_id", html_text(F.col("blob_bytes")).alias("text"))


@query()
def markdown_extraction(spark, d):
    return table(spark, d, "vault_work_item").where("lower(media_type) like 'text/markdown%'").select("item_id", markdown_text(F.col("blob_bytes")).alias("text"))


@query()
def extraction_pipeline(spark, d):
    return table(spark, d, "vault_work_item").select("item_id", extracted(F.col("blob_bytes"), F.col("media_type")).alias("r")).select("item_id", "r.status", F.length("r.text").cast("bigint").alias("signs"))


# Words and their stems by the public Snowball algorithms.
STEMS = {"en": "skies sky dying die news news generously generous consigned consign knightly knight running run happiness happi relational relat conditional condit communication communic hopping hop hoping hope agreed agre flies fli ties tie gas gas gaps gap luxuriously luxuri sized size national nation archives archiv youth youth proceed proceed generalizations general",
         "de": "aufeinander aufeinand aufgaben aufgab häuser haus kategorischen kategor jahreszeiten jahreszeit schönheit schonheit"}
STEM_ROWS = [(k, w, t) for k, v in STEMS.items() for w, t in zip(v.split()[::2], v.split()[1::2])] + [("fr", "maisons", "maisons")]


@query("select * from (values " + ", ".join(f"('{k}', '{w}', '{t}')" for k, w, t in STEM_ROWS) + ") t(language, word, stem)")
def stem_values(spark, d):
    """The stemmers over a table of known stems; a language without one leaves words as they are."""
    words = spark.createDataFrame([(k, w) for k, w, _ in STEM_ROWS], "language string, word string")
    of = lambda k: F.get(stems(F.array("word"), k), F.lit(0))
    return words.select("language", "word", F.when(F.col("language") == "en", of("en")).when(F.col("language") == "de", of("de")).otherwise(of("fr")).alias("stem"))


@query()
def stemmed_terms(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", F.get(stems(F.array("word")), F.lit(0)).alias("stem"))


@query()
def language_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", language(F.col("text")).alias("language"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
