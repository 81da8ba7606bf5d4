"""Splits, weights, draws and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import SEED, SUBSET_CAPS
from kuchikomi.operators import sampling, splits
from kuchikomi.operators.frequency import distinct_values
from kuchikomi.operators.ranks import with_rank
from kuchikomi.plans import views
from kuchikomi.plans.catalogue.registry import query


def _split_sql(rows: str, key: str) -> str:
    return f"""
ids as (select distinct {key} as k from {rows}),
ranked as (select k, row_number() over (order by md5(k || '|{SEED}'), k) as place, count(*) over () as total from ids),
cuts as (select *, ceil(0.2::double * total) as held_out, ceil(0.5::double * ceil(0.2::double * total)) as test from ranked),
assigned as (
  select k, case when place <= total - held_out then 'train' when place <= total - test then 'val' else 'test' end as split
  from cuts)
"""


REVIEW_SPLIT_SQL = _split_sql("rated_rows", "review_id")
NAMED_SQL = "named as (select * replace (coalesce(hotel_name, 'Unknown_Hotel') as hotel_name) from rated_rows)"
HOTEL_SPLIT_SQL = _split_sql("named", "hotel_name")


@query(
    "D1 J1 U3",
    "select r.review_id, r.aspect, r.sentiment_label, a.split from rated_rows r join assigned a on r.review_id = a.k",
    (views.REVIEWS_SQL, REVIEW_SPLIT_SQL),
)
def review_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.review_split(views.rated_rows(spark, sf_dir)).select("review_id", "aspect", "sentiment_label", "split")


@query(
    "D2 P10",
    "select r.review_id, r.aspect, r.hotel_name, a.split from named r join assigned a on r.hotel_name = a.k",
    (views.REVIEWS_SQL, NAMED_SQL, HOTEL_SPLIT_SQL),
)
def hotel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hotel_split(views.rated_rows(spark, sf_dir)).select("review_id", "aspect", "hotel_name", "split")


def _report_sql(group: str) -> str:
    label = ", ".join(f"count(*) filter (sentiment_label = {k}) as label_{k}" for k in (0, 1, 2))
    share = ", ".join(f"100.0::double * count(*) filter (sentiment_label = {k}) / count(*) as label_{k}_pct" for k in (0, 1, 2))
    return f"select split, count(*) as n_rows, count(distinct {group}) as n_groups, {label}, {share}"


@query(
    "A27 (hotels)",
    _report_sql("hotel_name") + " from named r join assigned a on r.hotel_name = a.k group by split",
    (views.REVIEWS_SQL, NAMED_SQL, HOTEL_SPLIT_SQL),
)
def hotel_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_report(splits.hotel_split(views.rated_rows(spark, sf_dir)))


@query(
    "A27 (reviews)",
    _report_sql("review_id") + " from rated_rows r join assigned a on r.review_id = a.k group by split",
    (views.REVIEWS_SQL, REVIEW_SPLIT_SQL),
)
def review_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_report(splits.review_split(views.rated_rows(spark, sf_dir)), group="review_id")


@query(
    "J1",
    """select review_id, aspect, score from rated_rows
       where review_id in (select k from assigned where split = 'test')""",
    (views.REVIEWS_SQL, REVIEW_SPLIT_SQL),
)
def rows_of_test_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows looked up by the ids of a split."""
    rows = views.rated_rows(spark, sf_dir)
    ids = distinct_values(splits.review_split(rows).where(F.col("split") == "test"), "review_id")
    return splits.rows_of_ids(rows, ids).select("review_id", "aspect", "score")


ROW_KEY_SQL = "keyed as (select *, review_id || '/' || aspect as row_key from rated_rows)"


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.rated_rows(spark, sf_dir).withColumn("row_key", F.concat("review_id", F.lit("/"), "aspect"))


RANKED_SQL = f"""
ranked as (
  select *, row_number() over (partition by sentiment_label order by md5(row_key || '|{SEED}'), row_key) as place,
         count(*) over (partition by sentiment_label) as total from keyed)
"""


@query(
    "D3 (rank within class)",
    "select row_key, sentiment_label, place from ranked",
    (views.REVIEWS_SQL, ROW_KEY_SQL, RANKED_SQL),
)
def rank_within_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = with_rank(keyed_rows(spark, sf_dir), "row_key", ("sentiment_label",), rank="place")
    return ranked.select("row_key", "sentiment_label", "place")


@query(
    "D3 J5",
    """select row_key, sentiment_label, case when place <= total - ceil(0.2::double * total) then 'train' else 'val' end as split
       from ranked""",
    (views.REVIEWS_SQL, ROW_KEY_SQL, RANKED_SQL),
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.stratified_split(keyed_rows(spark, sf_dir), "row_key", "sentiment_label")
    return rows.select("row_key", "sentiment_label", "split")


@query(
    "D3 on labels",
    f"""
    with placed as (select *, row_number() over (partition by quality order by md5(doc_id || '|{SEED}'), doc_id::varchar) as place,
                        count(*) over (partition by quality) as total from labels)
    select doc_id, quality, case when place <= total - ceil(0.2::double * total) then 'train' else 'val' end as split
    from placed""",
)
def stratified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(views.quality_rows(spark, sf_dir), "doc_id", "quality", classes=(0, 1)).select("doc_id", "quality", "split")


DRAWS_SQL = f"""
classes as (
  select sentiment_label, count(*) as n, row_number() over (order by sentiment_label) - 1 as idx, count(*) over () as k
  from keyed group by sentiment_label),
draws as (
  select draw_id, md5('{SEED}|' || draw_id) as h from (select unnest(range((select count(*) from keyed))) as draw_id)),
drawn as (
  select d.draw_id, c.sentiment_label,
         floor(('0x' || substr(d.h, 14, 13))::bigint::double / 4503599627370496::double * c.n)::bigint + 1 as place
  from draws d join classes c on c.idx = floor(('0x' || substr(d.h, 1, 13))::bigint::double / 4503599627370496::double * c.k))
"""


@query(
    "D4 J5",
    """select d.draw_id, r.row_key, r.sentiment_label, r.score from drawn d
       join ranked r on d.sentiment_label = r.sentiment_label and d.place = r.place""",
    (views.REVIEWS_SQL, ROW_KEY_SQL, RANKED_SQL, DRAWS_SQL),
)
def balanced_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_rows(spark, sf_dir).select("row_key", "sentiment_label", "score")
    return sampling.balanced_sample(rows, "row_key", "sentiment_label")


# Unequal weights within a class: long documents weigh more, one in a hundred a thousandfold, some nothing at all.
_WEIGHT = "case when doc_id % 11 = 3 then null when doc_id % 11 = 4 then -1.0D when doc_id % 101 = 5 then n_chars * 1000.0D else n_chars / 3.0D end"


@query(
    "D4 (any weights)",
    f"""
    with weights as (select doc_id, ({_WEIGHT.replace("D", "::double")}) as w from documents),
    units as (
      select doc_id, md5(doc_id || '|{SEED}') as h,
             greatest(floor(w / (select max(w) from weights) * {sampling.WEIGHT_UNITS}.0::double)::bigint, 1)::hugeint as u
      from weights where w > 0),
    placed as (
      select *, u * {sampling.WEIGHT_BUCKETS} >= (select sum(u) from units) as heavy from units),
    line as (
      select doc_id, heavy, sum(u) over (order by heavy desc, h, doc_id rows unbounded preceding) - u as start from placed),
    draws as (select draw_id, md5('{SEED}|' || draw_id) as h from (select unnest(range((select count(*) from units))) as draw_id)),
    points as (
      select draw_id, (('0x' || substr(h, 1, 13))::bigint::hugeint * (select sum(u) from units)::hugeint) // 4503599627370496 as point from draws)
    select draw_id, l.doc_id, l.heavy from points p asof join line l on p.point >= l.start""",
)
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").withColumn("w", F.expr(_WEIGHT))
    return sampling.weighted_draws(rows, "doc_id", "w")


@query(
    "D4 (more draws than rows)",
    """
    with sizes as (select quality, count(*) as n, row_number() over (order by quality) - 1 as idx, count(*) over () as k
                   from labels group by quality),
    draws as (select draw_id, md5('42|' || draw_id) as h from (select unnest(range(3 * (select count(*) from documents))) as draw_id))
    select d.draw_id, s.quality, floor(('0x' || substr(d.h, 14, 13))::bigint::double / 4503599627370496::double * s.n)::bigint + 1 as rank
    from draws d join sizes s on s.idx = floor(('0x' || substr(d.h, 1, 13))::bigint::double / 4503599627370496::double * s.k)""",
)
def oversampled_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three draws for every document out of the fewer labelled ones."""
    draws = 3 * views.table(spark, sf_dir, "documents").count()
    return sampling.class_draws(views.quality_rows(spark, sf_dir), "quality", draws=draws, classes=(0, 1))


@query(
    "A31 D4",
    """select draw_id // 8 as batch, sentiment_label, count(*) as n from drawn where draw_id < 160
       group by draw_id // 8, sentiment_label""",
    (views.REVIEWS_SQL, ROW_KEY_SQL, DRAWS_SQL),
)
def batch_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batch_composition(views.rated_rows(spark, sf_dir), "sentiment_label")


@query(
    "D5 J4",
    """select review_id, aspect, sentiment_label, 1.0::double / n as weight from rated_rows
       join (select sentiment_label, count(*) as n from rated_rows group by sentiment_label) using (sentiment_label)""",
    (views.REVIEWS_SQL,),
)
def inverse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = sampling.inverse_weights(views.rated_rows(spark, sf_dir), "sentiment_label")
    return weighted.select("review_id", "aspect", "sentiment_label", "weight")


@query(
    "D6 W4 U1 F9",
    "select review_id, aspect, sentiment_label from ("
    + " union all ".join(
        f"(select * from rated_rows where sentiment_label = {k} order by review_id, aspect limit {n})"
        for k, n in SUBSET_CAPS.items()
    )
    + ")",
    (views.REVIEWS_SQL,),
)
def capped_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset = sampling.capped_subset(views.rated_rows(spark, sf_dir), "sentiment_label", ["review_id", "aspect"])
    return subset.select("review_id", "aspect", "sentiment_label")


@query(
    "D7 F4 A1",
    "select split, count(*) as n from labelled where split in ('train', 'dev', 'test') group by split",
    (views.LABELLED_SQL,),
)
def routed_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.routed(views.labelled_sentences(spark, sf_dir)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
