"""Pages, first-seen deduplication, resuming and incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import PAGINATION_TERMS, PAGINATION_URL_PARTS
from kuchikomi.functions.text import char_length
from kuchikomi.operators import collection
from kuchikomi.plans import views
from kuchikomi.plans.catalogue.registry import query
from kuchikomi.session import fresh_path
from kuchikomi.sources import pages, review_lines, sinks
from kuchikomi.streaming.indexed import collected_indexed, ingest_indexed
from kuchikomi.streaming.ingest import collected, ingest


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(views.review_pages(spark, sf_dir))


@query(
    "S6 S7",
    """select page_id, position, doc_id::varchar as review_id, source as hotel_name, md5(text) as text_digest,
              (select count(*) from documents) as reported_total, (n_chars % 6)::double as room
       from on_page""",
    (views.PAGES_SQL,),
)
def embedded_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews decoded from the JSON array inside each page."""
    return pages.page_reviews(_extracted(spark, sf_dir)).select(
        "page_id",
        "position",
        F.col("id").alias("review_id"),
        F.col("provider.name").alias("hotel_name"),
        F.md5("comment").alias("text_digest"),
        "reported_total",
        F.try_element_at("scores", F.lit(4))["score"].alias("room"),
    )


@query(
    "S6 (rejects)",
    "select distinct page_id from placed where page_id not in (select page_id from readable)",
    (views.PAGES_SQL,),
)
def unreadable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.unreadable_pages(_extracted(spark, sf_dir)).select("page_id")


@query(
    "P21 S12",
    """select page_id, count(*) as n_reviews, min(doc_id)::varchar as first_id, max(doc_id)::varchar as last_id,
              first(lang order by doc_id) as first_title, last(lang order by doc_id) as last_title
       from on_page group by page_id""",
    (views.PAGES_SQL,),
)
def page_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    readable = _extracted(spark, sf_dir).where(F.col("reviews").isNotNull())
    return pages.page_ends(readable).select("page_id", "n_reviews", "first_id", "last_id", "first_title", "last_title")


@query(
    "W5 P22 F7 U4",
    """select doc_id::varchar as review_id, min(page_id) as page_id, arg_min(position, page_id) as position
       from on_page group by doc_id""",
    (views.PAGES_SQL,),
)
def first_seen_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each review once, from the first page and position that shows it."""
    reviews = collection.identified(pages.page_reviews(_extracted(spark, sf_dir))).select("id", "page_id", "position")
    first = collection.first_per_key(reviews, "id", ["page_id", "position"])
    return first.select(F.col("id").alias("review_id"), "page_id", "position")


@query(
    "S6 on stored pages",
    """
    select page_id, substr(html, instr(html, '<title>') + 7,
                           instr(substr(html, instr(html, '<title>') + 7), '</title>') - 1) as title
    from pages where instr(html, '<title>') > 0
      and instr(substr(html, instr(html, '<title>') + 7), '</title>') > 0""",
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker chain over real markup: what stands between the title tags."""
    title = pages.between(F.col("html"), "<title>", "</title>")
    return views.table(spark, sf_dir, "pages").select("page_id", title.alias("title")).where(F.col("title").isNotNull())


@query(
    "S8",
    " union all ".join(
        f"select page_id, '{t}' as term, len(regexp_extract_all(html, '(?i){t}')) as occurrences from pages"
        for t in PAGINATION_TERMS
    ),
)
def page_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.term_counts(views.table(spark, sf_dir, "pages"))


@query(
    "S8 F11 T6",
    f"""
    with urls as (
      select page_id, list_filter(regexp_extract_all(url || ' ' || html, '{pages.URL.replace("'", "''")}'),
                                  lambda u: regexp_matches(u, '(?i){"|".join(PAGINATION_URL_PARTS)}'))[1:20] as found
      from pages)
    select page_id, (unnest(range(1, len(found) + 1)) - 1)::integer as position, substr(unnest(found), 1, 300) as url from urls""",
)
def pagination_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pagination-like URLs in each page's address and markup."""
    stored = views.table(spark, sf_dir, "pages")
    return pages.pagination_urls(stored.withColumn("html", F.concat("url", F.lit(" "), "html")))


@query("J2", "select doc_id, length(text) as chars from documents where doc_id not in (select doc_id from labels)")
def not_yet_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    stored = views.table(spark, sf_dir, "labels")
    return collection.not_yet_collected(documents, stored, "doc_id").select("doc_id", char_length(F.col("text")).alias("chars"))


@query(
    "S9",
    "select distinct json_extract_string(props, '$.k') as review_id from events where json_extract_string(props, '$.k') <> ''",
)
def collected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids held inside stored JSON text."""
    events = views.table(spark, sf_dir, "events")
    return review_lines.collected_ids(events.select(F.get_json_object("props", "$.k").alias("id")))


@query(
    "A22",
    """select source as hotel_id, count(l.doc_id) as unique_reviews, count(*) as reported_total,
              greatest(count(*) - count(l.doc_id), 0) as remaining
       from documents d left join labels l on d.doc_id = l.doc_id group by source""",
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as the reviews held, all documents of a source as the total it reports."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("hotel_id"))
    held = documents.join(views.table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("doc_id", "review_id")
    totals = documents.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("reported_total"))
    return collection.reconciliation(held, totals)


@query(
    "R1 S10 F7 F8 J2",
    """select doc_id::varchar as id, source as hotel_id, source as hotel_name, md5(text) as text_digest from documents
       where doc_id not in (select doc_id from broken)
       union all select doc_id::varchar, 'other', source, md5(text) from documents
       where doc_id not in (select doc_id from broken) and doc_id % 10 = 0""",
    (views.BROKEN_SQL,),
)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of review files streamed into one table; the second repeats the first and brings some ids to another hotel."""
    source, table, checkpoint = (fresh_path(spark, n) for n in ("arriving", "collected", "progress"))
    lines = views.review_lines(spark, sf_dir, spread=False)
    known = views.table(spark, sf_dir, "labels")
    elsewhere = lines.where("doc_id % 10 = 0").withColumn("file_name", F.lit("hotel_other_reviews.jsonl"))
    for delivery in (lines.join(known, "doc_id", "left_semi"), lines.unionByName(elsewhere)):
        sinks.append_text(delivery, "line", source, split_column="file_name")
        ingest(spark, f"{source}/*", table, checkpoint, buckets=8).awaitTermination()
    held = collected(spark, table)
    return held.select("id", "hotel_id", F.col("provider.name").alias("hotel_name"), F.md5("comment").alias("text_digest"))


_HELD_SQL = """
    select doc_id::varchar as id, source as hotel_id, source as hotel_name, md5(text) as text_digest from documents
    where doc_id not in (select doc_id from broken)
    union all select doc_id::varchar, 'other', source, md5(text) from documents
    where doc_id not in (select doc_id from broken) and doc_id % 10 = 0"""


@query("R1 J2 S9 U4 W5 (key index)", _HELD_SQL, (views.BROKEN_SQL,))
def three_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, then all, then all again with some ids under another hotel; buckets split on the way."""
    source, table, checkpoint = (fresh_path(spark, n) for n in ("arriving", "indexed", "progress"))
    lines = views.review_lines(spark, sf_dir, spread=False)
    known = views.table(spark, sf_dir, "labels")
    elsewhere = lines.where("doc_id % 10 = 0").withColumn("file_name", F.lit("hotel_other_reviews.jsonl"))
    for delivery in (lines.join(known, "doc_id", "left_semi"), lines, lines.unionByName(elsewhere)):
        sinks.append_text(delivery, "line", source, split_column="file_name")
        ingest_indexed(spark, f"{source}/*", table, checkpoint, keys_per_bucket=2_000).awaitTermination()
    held = collected_indexed(spark, table)
    return held.select("id", "hotel_id", F.col("provider.name").alias("hotel_name"), F.md5("comment").alias("text_digest"))


@query("R1 S9 (first run)", _HELD_SQL, (views.BROKEN_SQL,))
def first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with nothing to collect finds no table and makes none; the next one collects everything."""
    source, table, checkpoint = (fresh_path(spark, n) for n in ("arriving", "indexed", "progress"))
    lines = views.review_lines(spark, sf_dir)
    elsewhere = lines.where("doc_id % 10 = 0").withColumn("file_name", F.lit("hotel_other_reviews.jsonl"))
    found = []
    for delivery in (lines.limit(0), lines.unionByName(elsewhere)):
        sinks.append_text(delivery.repartition("file_name"), "line", source, split_column="file_name")
        ingest_indexed(spark, source, table, checkpoint).awaitTermination()
        found.append(collected_indexed(spark, table))
    held = found[0].unionByName(found[1])
    return held.select("id", "hotel_id", F.col("provider.name").alias("hotel_name"), F.md5("comment").alias("text_digest"))


@query(
    "W3 W5 (late fetch)",
    """select doc_id::varchar as review_id, min(page_id) as page_id, arg_min(position, page_id) as position,
              arg_min(md5(text), page_id) as text_digest
       from on_page group by doc_id""",
    (views.PAGES_SQL,),
)
def first_seen_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each review once and whole; only reviews shown twice are moved."""
    path = fresh_path(spark, "shown-reviews")
    sinks.write_parquet(collection.identified(pages.page_reviews(_extracted(spark, sf_dir))).drop("scores"), path)
    first = collection.first_of_key(spark.read.parquet(path), ["id"], ["page_id", "position"])
    return first.select(F.col("id").alias("review_id"), "page_id", "position", F.md5("comment").alias("text_digest"))


@query(
    "S12",
    """select page_id, position, doc_id::varchar as id, lang as title, text as comment, (n_chars % 5 + 1)::double as overall_score,
              '2024-03-01T08:00:00+09:00' as posted, source as hotel_name, 5 as entries, (n_chars % 6)::double as room
       from on_page""",
    (views.PAGES_SQL,),
)
def stored_page_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of all pages written as JSON lines and read back whole."""
    path = fresh_path(spark, "page-reviews")
    written = pages.page_reviews(_extracted(spark, sf_dir))
    sinks.write_json(written, path)
    return spark.read.schema(written.schema).json(path).select(
        "page_id",
        "position",
        "id",
        "title",
        "comment",
        F.col("overallScore").alias("overall_score"),
        F.col("postDateTime").alias("posted"),
        F.col("provider.name").alias("hotel_name"),
        F.size("scores").alias("entries"),
        F.try_element_at("scores", F.lit(4))["score"].alias("room"),
    )
