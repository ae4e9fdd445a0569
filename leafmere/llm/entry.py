"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmere.llm import bpe, markup, neighbours, packing, ranking, reading, splitting


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.marked_files(table(spark, sf_dir, "vault_index_result"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = markup.distinct_texts(table(spark, sf_dir, "vault_index_result"))
    return texts.select("sha256", markup.cleaned(F.col("extracted_text")).alias("clean_text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ruled_queries(table(spark, sf_dir, "search_hit"))


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.median_ranking(table(spark, sf_dir, "search_hit"))
    return ranked.select("query_id", "ns", "doc_key", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"), F.col("place").cast("bigint").alias("place"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.usable_vectors(table(spark, sf_dir, "vec_entry"), table(spark, sf_dir, "vec_index_state"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(vectors(spark, sf_dir), 0.90).select("vec_id_a", "vec_id_b")


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = vectors(spark, sf_dir)
    return neighbours.nearest(usable, usable.where("vec_id % 100 = 0")).select("vec_id", "rank", "neighbour", F.round("cosine", 5).alias("cosine"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_items(splitting.pieces_of_files(table(spark, sf_dir, "vault_work_item"), table(spark, sf_dir, "vault_index_result")))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces_of_files(table(spark, sf_dir, "vault_work_item"), table(spark, sf_dir, "vault_index_result"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_items(packing.pack_texts(table(spark, sf_dir, "documents")))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where("level = 4").select("doc_id")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.with_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_sample"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_ranking, p4_found, p4_nearest, p5_found, p5_pieces, p6_ids, p7_found, p7_packing, p8_found, p8_levels)}


_ENTRIES = """
hits as (select distinct query_id, ns, doc_key, score, field_scores from search_hit),
entries as (select query_id, ns, doc_key, score, e.key as name, case when not isnan(e.value) then e.value end as value
  from (select *, unnest(map_entries(field_scores)) as e from hits))
"""

_P2_FOUND = f"""
with {_ENTRIES},
carried as (select * from entries where value is not null),
by_value as (select query_id, name, value, count(*) as n, min(score) as least, max(score) as most from carried group by all),
checked as (select *, max(most) over (partition by query_id, name order by value rows between unbounded preceding and 1 preceding) as under from by_value),
rules as (select query_id, name from checked group by all having sum(n) >= 8 and count(*) > 1 and not coalesce(bool_or(least <= under), false))
select distinct query_id from rules
where query_id in (select query_id from entries group by query_id having count(distinct name) > 1)
"""

_P2_RANKING = f"""
with {_ENTRIES},
ranks as (select query_id, ns, doc_key, rank() over w + (count(*) over (partition by query_id, name, value) - 1) / 2.0 as r
  from entries where value is not null window w as (partition by query_id, name order by value desc)),
items as (select query_id, ns, doc_key, median(r) as median_rank, avg(r) as mean_rank
  from (select distinct query_id, ns, doc_key from search_hit) left join ranks using (query_id, ns, doc_key) group by all)
select query_id, ns, doc_key, round(median_rank, 6) as median_rank, round(mean_rank, 6) as mean_rank,
  row_number() over (partition by query_id order by median_rank nulls last, mean_rank nulls last, ns, doc_key) as place
from items
"""

_P4_FOUND = """
with models as (select ns, field_name, min(lower(trim(model_id))) as model from vec_index_state
  where lower(trim(index_status)) = 'current' and trim(model_id) <> '' group by all),
usable as (select distinct vec_id, model, vec from vec_entry join models using (ns, field_name)
  where vec is not null and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0)
select a.vec_id as vec_id_a, b.vec_id as vec_id_b from usable a join usable b
  on a.model = b.model and len(a.vec) = len(b.vec) and a.vec_id < b.vec_id
where list_cosine_similarity(a.vec::double[], b.vec::double[]) >= 0.90
"""

# Words of UTF-16LE files are counted over the hexadecimal units, those of the others over the bytes, since white space is ASCII.
_P5_FOUND = r"""
with charsets as (select sha256, min(case when replace(lower(coalesce(charset, 'utf-8')), '-', '') = 'utf8' then 'utf-8' else lower(charset) end) as charset
  from vault_index_result group by sha256),
files as (select item_id, chunk_size, hex(blob_bytes) as h, coalesce(charset, 'utf-8') as charset from vault_work_item left join charsets using (sha256)
  where blob_bytes is not null and lower(trim(split_part(coalesce(media_type, ''), ';', 1))) <> 'application/octet-stream'),
units as (select item_id, chunk_size, case when charset = 'utf-16le' then
    list_transform(regexp_extract_all(h, '....'), lambda u: u in ('2000', '0900', '0A00', '0D00'))
    else list_transform(regexp_extract_all(h, '..'), lambda u: u in ('20', '09', '0A', '0D')) end as blank,
    starts_with(h, case when charset = 'utf-16le' then 'FFFE' else 'EFBBBF' end) as marked, charset from files),
bare as (select item_id, chunk_size, case when not marked then blank when charset = 'utf-16le' then blank[2:] else blank[4:] end as blank from units),
words as (select item_id, chunk_size, len(list_filter(range(1, len(blank) + 1), lambda i: not blank[i] and (i = 1 or blank[i - 1]))) as n from bare)
select distinct item_id from words where n > chunk_size
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2_FOUND, "p2_ranking": _P2_RANKING, "p4_found": _P4_FOUND, "p5_found": _P5_FOUND}
