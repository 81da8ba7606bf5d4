"""Quality, duplicate and distribution audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS
from kuchikomi.functions.hashing import compact
from kuchikomi.functions.text import char_length
from kuchikomi.functions.time import parse_lenient
from kuchikomi.operators import audit, duplicates, frequency, sketches
from kuchikomi.operators.corpus import flatten_scores
from kuchikomi.operators.corpus import usable_comments as usable
from kuchikomi.plans import views
from kuchikomi.plans.catalogue.registry import query
from kuchikomi.session import fresh_path
from kuchikomi.sources import assets, sinks

# Fixture for date audits: pending orders carry a word instead of a date, returned ones none at all.
DATED_SQL = """
dated as (
  select review_id, hotel_name, case status when 'P' then 'soon' when 'F' then null else post_datetime end as post_datetime,
         case when status not in ('P', 'F') then post_utc end as instant from reviews)
"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("status") == "P", "soon").when(F.col("status") != "F", F.col("post_datetime"))
    return views.reviews(spark, sf_dir).withColumn("post_datetime", text)


@query(
    "A14 P12 P18 A2",
    """
    select count(*) as total_rows, count(*) filter (post_datetime is null) as null_dates,
           100.0::double * count(*) filter (post_datetime is null) / count(*) as null_dates_pct,
           count(*) filter (post_datetime is not null and instant is null) as malformed_dates,
           100.0::double * count(*) filter (post_datetime is not null and instant is null) / count(*) as malformed_dates_pct,
           count(*) filter (hotel_name is null) as null_hotels,
           100.0::double * count(*) filter (hotel_name is null) / count(*) as null_hotels_pct
    from dated""",
    (views.REVIEWS_SQL, DATED_SQL),
)
def date_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.date_audit(_dated(spark, sf_dir))


@query(
    "A13 P12",
    """
    select strftime(min(instant), '%Y-%m-%d %H:%M:%S') as first_post, strftime(max(instant), '%Y-%m-%d %H:%M:%S') as last_post,
           count(*) filter (instant is null) as missing_or_invalid, count(*) filter (hotel_name is null) as check_in_missing
    from dated""",
    (views.REVIEWS_SQL, DATED_SQL),
)
def temporal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = audit.temporal_coverage(_dated(spark, sf_dir), check_in="hotel_name")
    shown = "yyyy-MM-dd HH:mm:ss"
    return covered.withColumns(
        {c: F.date_format(c, shown) for c in ("first_post", "last_post")}
    )


@query(
    "P12",
    "select review_id, coalesce(strftime(instant, '%Y-%m-%d %H:%M:%S'), 'none') as instant from dated",
    (views.REVIEWS_SQL, DATED_SQL),
)
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.date_format(parse_lenient(F.col("post_datetime")), "yyyy-MM-dd HH:mm:ss")
    return _dated(spark, sf_dir).select("review_id", F.coalesce(shown, F.lit("none")).alias("instant"))


_AUDITED = ("hotel_name", "post_datetime", "review_id")


@query(
    "A2",
    " union all ".join(
        f"select '{c}' as column_name, count(*) filter ({c} is null) as nulls from dated" for c in _AUDITED
    ),
    (views.REVIEWS_SQL, DATED_SQL),
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.null_counts(_dated(spark, sf_dir).select(*_AUDITED))


@query(
    "A3",
    " union all ".join(
        f"select '{c}' as column_name, count(distinct {c}) as distinct_values from documents" for c in ("doc_id", "text", "source")
    ),
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distinct_counts(views.table(spark, sf_dir, "documents"), ["doc_id", "text", "source"])


@query(
    "A4",
    """
    select 'hotel_name' as column_name, count(*) - count(distinct hotel_name) - max((hotel_name is null)::bigint) as repeated from dated
    union all
    select 'post_datetime', count(*) - count(distinct post_datetime) - max((post_datetime is null)::bigint) from dated""",
    (views.REVIEWS_SQL, DATED_SQL),
)
def repeated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated_values(_dated(spark, sf_dir), ["hotel_name", "post_datetime"])


@query(
    "A5",
    """with twice as (select * from documents union all select * from documents where doc_id % 3 = 0)
       select sum(n - 1)::bigint as repeated_rows from (select count(*) as n from twice group by doc_id, text, lang, source, n_chars)""",
)
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in all columns; a third of the documents is given twice."""
    documents = views.table(spark, sf_dir, "documents")
    return audit.repeated_rows(documents.union(documents.where("doc_id % 3 = 0")))


@query(
    "A6 F9 F12",
    "select hotel_name, count(*) as n from reviews where hotel_name is not null group by hotel_name",
    (views.REVIEWS_SQL,),
)
def value_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.by_count(frequency.frequencies(views.reviews(spark, sf_dir), "hotel_name"))


@query(
    "A6 (null kept) F6",
    """select coalesce(post_datetime, 'none') as post_datetime, count(*) as n from dated
       group by post_datetime having count(*) > 1""",
    (views.REVIEWS_SQL, DATED_SQL),
)
def repeated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = frequency.frequencies(_dated(spark, sf_dir), "post_datetime", keep_null=True).where(F.col("n") > 1)
    return frequency.by_value(table).select(F.coalesce("post_datetime", F.lit("none")).alias("post_datetime"), "n")


@query(
    "A7 P18",
    """
    select sentiment_label, count(*) as n, 100.0::double * count(*) / (select count(*) from rated_rows) as pct,
           round_even(100.0::double * count(*) / (select count(*) from rated_rows), 2) as pct_shown
    from rated_rows group by sentiment_label""",
    (views.REVIEWS_SQL,),
)
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.shares(views.rated_rows(spark, sf_dir), "sentiment_label")


@query(
    "A8",
    """select hotel_name, sentiment_label, count(*) as n from rated_rows where hotel_name is not null
       group by hotel_name, sentiment_label""",
    (views.REVIEWS_SQL,),
)
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.contingency(views.rated_rows(spark, sf_dir), "hotel_name", "sentiment_label")


@query(
    "A8 (wide)",
    """
    select split, count(*) filter (label = -1) as "label_-1", count(*) filter (label = 0) as label_0,
           count(*) filter (label = 1) as label_1 from labelled group by split""",
    (views.LABELLED_SQL,),
)
def labels_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.crosstab(views.labelled_sentences(spark, sf_dir), "split", "label", [-1, 0, 1])


@query(
    "A11 P15",
    """
    select min(length(text)) as min_chars, max(length(text)) as max_chars,
           sum(length(text))::double / count(*) as mean_chars, median(length(text)) as median_chars from documents""",
)
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.length_summary(views.table(spark, sf_dir, "documents"), "text")


@query(
    "A12",
    """
    select statistic, round(value, 4) as value from (
      select unnest(['count', 'mean', 'std', 'min', 'p25', 'p50', 'p75', 'p90', 'p99', 'max']) as statistic,
             unnest([count(n)::double, avg(n), stddev_samp(n), min(n)::double, quantile_cont(n, 0.25), quantile_cont(n, 0.5),
                     quantile_cont(n, 0.75), quantile_cont(n, 0.9), quantile_cont(n, 0.99), max(n)::double]) as value
      from (select length(text)::double as n from documents))""",
)
def length_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = audit.length_description(views.table(spark, sf_dir, "documents"), "text")
    return described.select("statistic", F.round("value", 4).alias("value"))


@query("A32 P16", f"select count(*) filter ({views.strip_sql('text')} = '') as empty_texts from documents")
def empty_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.empty_texts(views.table(spark, sf_dir, "documents"), "text")


# Every whole text, and beside it one of 0 to 7 characters, null for every ninth document: both sides of the limit of 5.
_SHORT_SQL = """with short as (
      select text from documents union all select case when doc_id % 9 > 0 then substr(text, 1, doc_id % 8) end as text from documents)"""
_SHORT = "case when doc_id % 9 > 0 then substring(text, 1, cast(doc_id % 8 as int)) end"


def _whole_and_short(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    both = F.explode(F.array("text", F.expr(_SHORT))).alias(column)
    return views.table(spark, sf_dir, "documents").select(both)


@query(
    "A18 P16 F1",
    f"""
    {_SHORT_SQL}
    select count(*) as total_rows, count(*) filter (text is null or {views.strip_sql('text')} = '') as null_or_empty,
           100.0::double * count(*) filter (text is null or {views.strip_sql('text')} = '') / count(*) as null_or_empty_pct,
           count(*) filter (length({views.strip_sql('text')}) < 5) as short_with_empty,
           100.0::double * count(*) filter (length({views.strip_sql('text')}) < 5) / count(*) as short_with_empty_pct
    from short""",
)
def missing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_texts(_whole_and_short(spark, sf_dir, "text"), "text")


@query(
    "F1",
    f"{_SHORT_SQL} select md5(text) as text_digest, count(*) as n from short where length({views.strip_sql('text')}) >= 5 group by md5(text)",
)
def usable_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of enough characters, whole ones and those that have just enough."""
    usable_rows = usable(_whole_and_short(spark, sf_dir, "comment"))
    return usable_rows.groupBy(F.md5("comment").alias("text_digest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "A19 A3",
    """
    select count(distinct doc_id) as unique_ids, count(distinct text) as unique_texts,
           abs(count(distinct doc_id) - count(distinct text)) as difference,
           case when count(distinct text) < count(distinct doc_id) then 'texts repeat across ids'
                when count(distinct text) = count(distinct doc_id) then 'one text per id'
                else 'ids repeat across texts' end as verdict from documents""",
)
def ids_against_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ids_against_texts(views.table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "A16 F10",
    """
    select aspect, count(*) as n, count(*) filter (score is null) as null_scores,
           100.0::double * count(*) filter (score is null) / count(*) as null_scores_pct,
           count(*) filter (sentiment_label is null) as null_labels,
           100.0::double * count(*) filter (sentiment_label is null) / count(*) as null_labels_pct
    from aspect_rows group by aspect""",
    (views.REVIEWS_SQL,),
)
def aspect_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.aspect_nulls(views.aspect_rows(spark, sf_dir))


@query(
    "A17 U2 U3",
    """
    , found as (select case when aspect = 'bath' then 'Bath' else aspect end as aspect, count(*) as n from rated_rows group by 1)
    select coalesce(f.aspect, w.aspect) as aspect, coalesce(f.n, 0)::bigint as n,
           case when f.aspect is null then 'missing' when w.aspect is null then 'unexpected' else 'ok' end as standing,
           false as matches
    from found f full join (select distinct aspect from slots) w on f.aspect = w.aspect""",
    (views.REVIEWS_SQL,),
)
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aspect domain with one name misspelt, so that all three standings occur."""
    rows = views.rated_rows(spark, sf_dir).replace({ASPECTS[3]: ASPECTS[3].title()}, subset=["aspect"])
    return audit.domain_check(rows)


@query(
    "A20 A6",
    "select aspect, coalesce(score, -1) as score, count(*) as n from aspect_rows group by aspect, score",
    (views.REVIEWS_SQL,),
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = frequency.score_distribution(flatten_scores(views.reviews(spark, sf_dir)))
    return table.withColumn("score", F.coalesce("score", F.lit(-1.0)))


_DUPLICATES_SQL = """
repeated as (
  select text as comment, sha256(text) as digest, count(*) as n_reviews, count(distinct source) as n_hotels
  from documents group by text having count(*) > 1)
"""


@query(
    "A15 W3 F6 J3 P1",
    "select count(*) as repeated_comments, count(*) filter (n_hotels > 1) as cross_hotel_comments from repeated",
    (_DUPLICATES_SQL,),
)
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_summary(views.document_reviews(spark, sf_dir))


@query(
    "A15 T5 P17",
    """
    , chosen as (select * from repeated where n_hotels > 1 order by n_reviews desc, digest limit 5)
    select distinct digest as comment_digest,
           case when length(c.comment) > 50 then substr(c.comment, 1, 50) || '...' else c.comment end as comment,
           n_reviews, n_hotels, d.source as hotel_name
    from chosen c join documents d on d.text = c.comment""",
    (_DUPLICATES_SQL,),
)
def cross_hotel_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.cross_hotel_examples(views.document_reviews(spark, sf_dir))


@query(
    "A15 over aspect rows, null hotel counted",
    """
    , per as (select comment, count(*) as n_reviews,
                     count(distinct hotel_name) + max((hotel_name is null)::bigint) as n_hotels
              from reviews where comment is not null group by comment having count(*) > 1)
    select count(*) as repeated_comments, count(*) filter (n_hotels > 1) as cross_hotel_comments from per""",
    (views.REVIEWS_SQL,),
)
def duplicate_summary_by_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check as run on the aspect corpus: rows of a review are first reduced to one."""
    flat = flatten_scores(views.reviews(spark, sf_dir, comments=True))
    rows = flat.select("review_id", "hotel_name", "comment", F.explode(F.array(*ASPECTS)).alias("score"))
    return duplicates.duplicate_summary(rows)


_SAMPLED = ("doc_id", "text", "lang", "source", "n_chars")


@query(
    "A30",
    "with named as (select * replace (case when source <> 'src7' then source end as source) from documents) "
    + " union all ".join(
        f"""select * from (select '{c}' as column_name, value, (row_number() over (order by value nulls last))::integer as place
            from (select distinct {c}::varchar as value from named)) where place <= 20"""
        for c in _SAMPLED
    ),
)
def value_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column; one has exactly as many values as are asked for, null among them."""
    named = F.when(F.col("source") != "src7", F.col("source"))
    return frequency.value_samples(views.table(spark, sf_dir, "documents").withColumn("source", named).select(*_SAMPLED))


_SCHEMA = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))


@query(
    "S16 A1",
    "select (select count(*) from documents) as n_rows, 5::bigint as n_columns, * from (values "
    + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(_SCHEMA))
    + ") t(position, column_name, data_type)",
)
def table_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.overview(views.table(spark, sf_dir, "documents"))


@query("S16 T6", "select * from orders order by o_orderkey limit 5")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(5)


_ASSETS = ("documents", "labels", "embeddings", "absent")


# A stored table whose columns say what the audit looks for, in several cases.
_RENAMED = {"source": "Provider_Name", "lang": "roomType", "n_chars": "SCORE_total", "doc_id": "id", "text": "HOTEL"}


@query(
    "S15 P24",
    " union all ".join(
        f"""select '{a}' as asset, true as found, (select count(*) from {a}) as n_rows,
            (select count(*) from (describe {a})) as n_columns,
            (select string_agg(column_name, ', ') from (describe {a})) as column_names,
            '' as aspect_columns, '' as hotel_columns"""
        for a in _ASSETS[:3]
    )
    + f""" union all select 'renamed', true, (select count(*) from documents), 5, '{", ".join(_RENAMED.values())}',
           'roomType, SCORE_total', 'Provider_Name, HOTEL'
           union all select 'absent', false, 0, 0, '', '', ''""",
)
def asset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = fresh_path(spark, "renamed")
    documents = views.table(spark, sf_dir, "documents")
    sinks.write_parquet(documents.select(*[F.col(c).alias(n) for c, n in _RENAMED.items()]), renamed)
    return assets.asset_overview(spark, {a: f"{sf_dir}/{a}.parquet" for a in _ASSETS} | {"renamed": renamed})


@query(
    "S15 A6",
    "select 'embeddings' as asset, label::varchar as label, count(*) as n from embeddings where label is not null group by label",
)
def asset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.asset_labels(spark, {a: f"{sf_dir}/{a}.parquet" for a in _ASSETS})


@query(
    "T7 P17",
    """
    with first_row as (select * from documents order by doc_id limit 1)
    select 'text' as column_name, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as value from first_row
    union all select 'lang', lang from first_row union all select 'source', source from first_row
    union all select 'doc_id', doc_id::varchar from first_row union all select 'n_chars', n_chars::varchar from first_row
    """,
)
def sample_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.sample_row(views.table(spark, sf_dir, "documents"), "doc_id")


_LEVELS_SQL = """
with rows as (
  select source as hotel_name, lang, doc_id, text from documents),
levels as (
  select 'group' as level, hotel_name, lang, doc_id, text from rows union all
  select 'hotel', hotel_name, null, doc_id, text from rows union all select 'all', null, null, doc_id, text from rows)
"""
_LEVELS = (("group", ["hotel_name", "lang"]), ("hotel", ["hotel_name"]), ("all", []))


def _at_all_levels(stored: DataFrame, merged) -> DataFrame:
    """The stored groups merged for every level, the columns of smaller groups null."""
    parts = []
    for level, by in _LEVELS:
        named = merged(stored, by).withColumn("level", F.lit(level))
        parts.append(named.withColumns({c: F.lit(None).cast("string") for c in ("hotel_name", "lang") if c not in by}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _documents_at_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.document_reviews(spark, sf_dir).join(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "lang"), "review_id")
    copies = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *[(F.col(c) if c in by else F.lit(None).cast("string")).alias(c) for c in ("hotel_name", "lang")]) for level, by in _LEVELS]))
    return rows.select("review_id", "comment", copies.alias("at")).select("review_id", "comment", "at.*")


@query(
    "A11 A12 (stored sketches)",
    _LEVELS_SQL
    + """
    select level, hotel_name, lang, count(*) as n, min(length(text)) as min_chars, max(length(text)) as max_chars,
           unnest([0.25, 0.5, 0.75, 0.9, 0.99])::double as share, true as within
    from levels group by level, hotel_name, lang""",
)
def stored_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from merged sketches: the rank each of them has among the exact lengths is within the bound."""
    path = fresh_path(spark, "length-sketches")
    documents = views.table(spark, sf_dir, "documents").withColumnRenamed("source", "hotel_name")
    sketches.length_sketches(documents, "text", ["hotel_name", "lang"]).write.parquet(path)
    found = sketches.length_quantiles(_at_all_levels(spark.read.parquet(path), sketches.merged_lengths))
    long = found.unpivot(["level", "hotel_name", "lang", "n", "min_chars", "max_chars"], [f"p{round(p * 100)}" for p in audit.PERCENTILES], "name", "chars")
    long = long.withColumn("share", F.substring("name", F.lit(2), F.length("name")).cast("double") / 100)
    exact = _documents_at_levels(spark, sf_dir).groupBy("level", "hotel_name", "lang", char_length(F.col("comment")).alias("own")).agg(F.count(F.lit(1)).alias("rows"))
    same = long["level"].eqNullSafe(exact["level"]) & long["hotel_name"].eqNullSafe(exact["hotel_name"]) & long["lang"].eqNullSafe(exact["lang"])
    keys = [long[c] for c in ("level", "hotel_name", "lang", "n", "min_chars", "max_chars", "share", "chars")]
    ranks = long.join(exact, same).groupBy(*keys).agg(
        F.sum(F.when(F.col("own") < F.col("chars"), F.col("rows")).otherwise(0)).alias("below"), F.sum(F.when(F.col("own") <= F.col("chars"), F.col("rows")).otherwise(0)).alias("upto")
    )
    error = F.lit(sketches.RANK_ERROR) + F.lit(1.0) / F.col("n")
    within = (F.col("below") / F.col("n") <= F.col("share") + error) & (F.col("upto") / F.col("n") >= F.col("share") - error)
    return ranks.select("level", "hotel_name", "lang", "n", "min_chars", "max_chars", "share", within.alias("within"))


@query(
    "A3 A4 A15 A19 (stored sketches)",
    _LEVELS_SQL
    + """
    select level, hotel_name, lang, count(distinct doc_id) as ids, count(distinct text) as texts, true as ids_within, true as texts_within
    from levels group by level, hotel_name, lang""",
)
def stored_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids and texts from merged sketches, beside the exact counts they are within the bound of."""
    path = fresh_path(spark, "distinct-sketches")
    documents = views.table(spark, sf_dir, "documents").select(F.col("source").alias("hotel_name"), "lang", F.col("doc_id").alias("review_id"), F.col("text").alias("comment"))
    columns = ["review_id", "comment"]
    sketches.distinct_sketches(documents, columns, ["hotel_name", "lang"]).write.parquet(path)
    found = sketches.distinct_estimates(_at_all_levels(spark.read.parquet(path), lambda s, by: sketches.merged_distinct(s, columns, by)), columns)
    exact = _documents_at_levels(spark, sf_dir).groupBy("level", "hotel_name", "lang").agg(
        F.count_distinct("review_id").alias("ids"), F.count_distinct(compact(F.col("comment"))).alias("texts")
    )
    same = found["level"].eqNullSafe(exact["level"]) & found["hotel_name"].eqNullSafe(exact["hotel_name"]) & found["lang"].eqNullSafe(exact["lang"])
    near = lambda estimate, n: F.abs(estimate - n) <= F.greatest(n * sketches.DISTINCT_ERROR, F.lit(1))
    return exact.join(found, same).select(
        exact["level"], exact["hotel_name"], exact["lang"], "ids", "texts", near(F.col("review_id"), F.col("ids")).alias("ids_within"), near(F.col("comment"), F.col("texts")).alias("texts_within")
    )
