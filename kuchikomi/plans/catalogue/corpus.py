"""Corpus construction: text cleaning, raw lines to records, unpivot and labels, file round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS, CORRUPT
from kuchikomi.functions.scores import aspect_index, aspect_label, recode_polarity
from kuchikomi.functions.text import char_length, clean_text, preview, strip
from kuchikomi.operators import corpus
from kuchikomi.operators.features import conditioned_text
from kuchikomi.operators.splits import routed, with_known_hotels
from kuchikomi.plans import views
from kuchikomi.plans.catalogue.registry import query
from kuchikomi.session import fresh_path
from kuchikomi.sources import delimited, review_lines, sinks


@query("P2", f"select doc_id, {views.clean_sql('text')} as cleaned from documents")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(
    "P15 P16 P17",
    f"""select doc_id, length(text) as chars, length({views.strip_sql('text')}) as stripped_chars,
        case when length(text) > 50 then substr(text, 1, 50) || '...' else text end as shown from documents""",
)
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id",
        char_length(text).alias("chars"),
        char_length(strip(text)).alias("stripped_chars"),
        preview(text, 50).alias("shown"),
    )


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_lines.parse_review_lines(views.review_lines(spark, sf_dir))


@query(
    "S1 S2 P2 P3 P4 P5 P22 F8",
    f"""
    select source as hotel_id, doc_id::varchar as review_id, source as hotel_name, {views.clean_sql('lang')} as title,
           {views.clean_sql('text')} as comment, (n_chars % 5 + 1)::double as overall_score,
           '2024-03-01T08:00:00+09:00' as post_datetime, 'reviews' as source, (n_chars % 6)::double as room,
           2.5::double as dinner, 3::bigint as score_entries
    from documents where doc_id not in (select doc_id from broken)""",
    (views.BROKEN_SQL,),
)
def research_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines decoded, malformed ones left out, flattened and cleaned; the score map shown by entry."""
    records = corpus.research_corpus(review_lines.accepted(_parsed(spark, sf_dir)), source="reviews")
    flat = corpus.flatten_scores(records.withColumn("score_entries", F.size("scores").cast("bigint")))
    return flat.select(
        "hotel_id", "review_id", "hotel_name", "title", "comment", "overall_score", "post_datetime", "source",
        "room", "dinner", "score_entries",
    )


@query(
    "F8 (rejects)",
    "select source as hotel_id, count(*) as n from documents where doc_id in (select doc_id from broken) group by source",
    (views.BROKEN_SQL,),
)
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_lines.rejected(_parsed(spark, sf_dir)).groupBy("hotel_id").agg(F.count("line").alias("n"))


@query(
    "A21",
    """
    select source as hotel_id, count(*) as input_reviews, count(*) filter (b.doc_id is null) as written_reviews,
           count(*) filter (b.doc_id is not null) as skipped_reviews
    from documents d left join broken b on d.doc_id = b.doc_id group by source""",
    (views.BROKEN_SQL,),
)
def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_lines.ingest_audit(_parsed(spark, sf_dir))


@query(
    "P1 P6 P7 P8 F1 F2 F3 T1",
    f"""
    , usable as materialized (
      select doc_id, length(text) as comment_chars from documents where length({views.strip_sql('text')}) >= 5),
    rated as materialized (select hotel_id, hotel_name, review_id, post_datetime, doc_id, aspect, score, sentiment_label from rated_rows)
    select r.hotel_id, r.hotel_name, r.review_id, r.post_datetime, m.comment_chars, r.aspect, r.score, r.sentiment_label
    from rated r join usable m on m.doc_id = r.doc_id""",
    (views.REVIEWS_SQL,),
)
def aspect_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = views.reviews(spark, sf_dir, comments=True)
    measured = reviews.withColumn("comment_chars", char_length(F.col("comment")))
    keep = ["hotel_id", "hotel_name", "review_id", "post_datetime", "comment_chars"]
    return corpus.aspect_corpus(measured, keep=keep, ordered=True)


@query(
    "S3 P6 (nulls kept)",
    "select review_id, aspect, coalesce(score, -1) as score from aspect_rows",
    (views.REVIEWS_SQL,),
)
def unpivoted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = corpus.flatten_scores(views.reviews(spark, sf_dir))
    long = corpus.unpivot_aspects(flat, ["review_id"])
    return long.select("review_id", "aspect", F.coalesce("score", F.lit(-1.0)).alias("score"))


@query(
    "A1 A3 (corpus summary)",
    """
    select (select count(*) from reviews) as original_reviews,
           (select count(distinct review_id) from rated_rows) as valid_reviews,
           (select count(*) from rated_rows) as aspect_records""",
    (views.REVIEWS_SQL,),
)
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.rated_rows(spark, sf_dir)
    original = views.table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    return rows.agg(
        F.count_distinct("review_id").alias("valid_reviews"), F.count(F.lit(1)).alias("aspect_records")
    ).withColumn("original_reviews", original)


@query(
    "P9",
    "select id, coalesce(case label when -1 then 0 when 0 then 1 when 1 then 2 end, -9)::integer as label from labelled",
    (views.LABELLED_SQL,),
)
def recoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    recoded = F.coalesce(recode_polarity(F.col("label")), F.lit(-9))
    return views.labelled_sentences(spark, sf_dir).select("id", recoded.alias("label"))


@query(
    "P10",
    "select review_id, coalesce(hotel_name, 'Unknown_Hotel') as hotel_name from reviews",
    (views.REVIEWS_SQL,),
)
def known_hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_known_hotels(views.reviews(spark, sf_dir)).select("review_id", "hotel_name")


@query(
    "P19 P20 J4",
    """
    select review_id, case when aspect = 'bath' then -1 else aspect_idx end::integer as aspect_idx,
           case when aspect = 'bath' then '-1' else aspect end as aspect_name,
           md5('[' || case when aspect = 'bath' then 'spa' else aspect end || '] ' || d.text) as conditioned
    from aspect_rows a left join documents d on d.doc_id = a.doc_id""",
    (views.REVIEWS_SQL,),
)
def conditioned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect ids and conditioned texts; one aspect is renamed to a name outside the domain."""
    rows = views.aspect_rows(spark, sf_dir, comments=True).replace({ASPECTS[3]: "spa"}, subset=["aspect"])
    index = aspect_index(F.col("aspect"))
    return rows.select(
        "review_id",
        index.alias("aspect_idx"),
        aspect_label(index).alias("aspect_name"),
        F.md5(conditioned_text(F.col("aspect"), F.col("comment"))).alias("conditioned"),
    )


@query(
    "S10 S11 S9 F7",
    f"""
    select source as hotel_id, doc_id::varchar as review_id, source as hotel_name, {views.clean_sql('lang')} as title,
           {views.clean_sql('text')} as comment, (n_chars % 5 + 1)::double as overall_score,
           '2024-03-01T08:00:00+09:00' as post_datetime, 'reviews' as source, (n_chars % 6)::double as room,
           2.5::double as dinner, 3 as score_entries, 2 as copies, true as collected
    from documents where doc_id not in (select doc_id from broken)""",
    (views.BROKEN_SQL,),
)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written twice as JSON lines, the second time appended, and read back whole with their stored ids."""
    path = fresh_path(spark, "records")
    records = corpus.research_corpus(review_lines.accepted(_parsed(spark, sf_dir)), source="reviews")
    sinks.write_json(records, path)
    sinks.append_json(records, path)
    back = review_lines.read_research(spark, path)
    whole = corpus.flatten_scores(back.withColumn("score_entries", F.size("scores")))
    columns = ["hotel_id", "review_id", "hotel_name", "title", "comment", "overall_score", "post_datetime", "source", "room", "dinner", "score_entries"]
    ids = review_lines.collected_ids(back, "review_id").withColumn("collected", F.lit(True))
    return whole.groupBy(*columns).agg(F.count(F.lit(1)).cast("int").alias("copies")).join(ids, "review_id", "left")


# Texts with blanks and tabs at the ends, quotes, line breaks, nothing, and null.
AWKWARD_SQL = """case id::bigint % 7 when 0 then '  ' || text when 1 then text || chr(9) when 2 then '' when 3 then null
                      when 4 then '"' || text || '", "' when 5 then text || chr(10) || 'end ' else text end"""


def _awkward(rows: DataFrame) -> DataFrame:
    kind, text = F.col("id").cast("bigint") % 7, F.col("text")
    return rows.withColumn(
        "text",
        F.when(kind == 0, F.concat(F.lit("  "), text))
        .when(kind == 1, F.concat(text, F.lit("\t")))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.lit(None))
        .when(kind == 4, F.concat(F.lit('"'), text, F.lit('", "')))
        .when(kind == 5, F.concat(text, F.lit("\nend ")))
        .otherwise(text),
    )


# One line of each document, by its id: as it should be, with fields of other types, no object, or more than one object.
_KINDS = 11


def _mistyped(documents: DataFrame) -> DataFrame:
    doc, text = F.col("doc_id"), F.to_json(F.struct("text"))
    quoted = F.substring(text, F.lit(9), F.length(text) - 9)
    parts = [
        F.concat(F.lit('{"id":'), doc, F.lit(',"overallScore":"4.0","comment":'), quoted, F.lit("}")),
        F.concat(F.lit('{"id":"'), doc, F.lit('","overallScore":3,"scores":[{"code":"ROOM","score":"5"},7,{"code":2,"score":[]}]}')),
        F.concat(F.lit('{"id":"'), doc, F.lit('","provider":"plain","overallScore":[1],"title":{"a":1}}')),
        F.concat(F.lit('{"id":"'), doc, F.lit('","comment":'), quoted),
        F.concat(F.lit("["), doc, F.lit("]")),
        F.concat(F.lit('"'), doc, F.lit('"')),
        F.concat(F.lit(' {"id":"'), doc, F.lit('","comment":null,"scores":{"code":"ROOM"},"provider":{"name":5}}  ')),
        F.lit("\u3000 "),
        F.concat(F.lit('{"id":"'), doc, F.lit('"} {"id":"'), doc, F.lit('"}')),
        F.concat(F.lit('{"id":"'), doc, F.lit('","comment":'), quoted, F.lit('}x}')),
        F.concat(F.lit('{"id":"'), doc, F.lit('"}] {"comment":'), quoted, F.lit("}")),
    ]
    line = F.element_at(F.array(*parts), (doc % _KINDS + 1).cast("int"))
    return documents.select(F.concat(F.lit("x/hotel_"), "source", F.lit("_reviews.jsonl")).alias("file_name"), line.alias("line"))


@query(
    "S1 F8 A21 (fields of other types)",
    """
    with kinds as (select source as hotel_id, doc_id::varchar as review_id, text, doc_id % 11 as kind from documents)
    select hotel_id, case when kind in (0, 1, 2, 6) then review_id end as review_id,
           case kind when 0 then 4.0 when 1 then 3.0 end::double as overall_score,
           case when kind in (0) then md5(text) end as comment_digest, case kind when 2 then '{"a":1}' end as title,
           case kind when 6 then '5' end as hotel_name, case kind when 1 then 5.0 end::double as room,
           case kind when 1 then 2 end as entries, kind in (3, 4, 5, 8, 9, 10) as skipped
    from kinds where kind <> 7""",
)
def mistyped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what is not one JSON object is skipped; a value that does not fit its field is null and costs nothing else."""
    parsed = review_lines.parse_review_lines(_mistyped(views.table(spark, sf_dir, "documents")))
    scored = F.filter("scores", lambda s: s.isNotNull())
    room = F.filter("scores", lambda s: s["code"] == "ROOM")
    return parsed.select(
        "hotel_id",
        F.col("id").alias("review_id"),
        F.col("overallScore").alias("overall_score"),
        F.md5("comment").alias("comment_digest"),
        "title",
        F.col("provider.name").alias("hotel_name"),
        F.get(room, F.lit(0))["score"].alias("room"),
        F.when(F.size(scored) > 0, F.size(scored)).alias("entries"),
        F.col(CORRUPT).isNotNull().alias("skipped"),
    )


@query(
    "S1 S2 A21 F8 (files)",
    """
    select source as hotel_id, count(*) as input_reviews, count(*) filter (b.doc_id is null) as written_reviews,
           count(*) filter (b.doc_id is not null) as skipped_reviews, 1::bigint as files
    from documents d left join broken b on d.doc_id = b.doc_id group by source
    union all select 'blank', null, null, null, 1""",
    (views.BROKEN_SQL,),
)
def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files ``hotel_<id>_reviews.jsonl`` written, one of them without a usable line, and read from the folder."""
    path = fresh_path(spark, "review-files")
    lines = views.review_lines(spark, sf_dir, spread=False).select("file_name", "line")
    blank = spark.range(1).select(F.lit("hotel_blank_reviews.jsonl").alias("file_name"), F.lit("  ").alias("line"))
    # Every task writes its part of each file: one hotel can have most of the lines.
    sinks.append_text(lines.unionByName(blank), "line", path, split_column="file_name")
    parsed = review_lines.parse_review_lines(review_lines.read_review_lines(spark, f"{path}/*"))
    return review_lines.ingest_audit(parsed).join(review_lines.files_read(spark, f"{path}/*"), "hotel_id", "full")


@query(
    "S4 S5 S13 D7 F4",
    f"select split, id, label, {AWKWARD_SQL} as text from labelled where split in ('train', 'dev', 'test')",
    (views.LABELLED_SQL,),
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed sentences written as one CSV folder per split and read back with all blanks, quotes and breaks."""
    path = fresh_path(spark, "splits")
    sinks.write_csv(routed(_awkward(views.labelled_sentences(spark, sf_dir))), path, split_column="split")
    back = delimited.read_csv(spark, path, "id string, label int, text string, annotation string, split string", multi_line=True)
    return back.select("split", "id", "label", "text")


@query(
    "S5",
    f"select id, label, {AWKWARD_SQL} as text, annotation, split from labelled",
    (views.LABELLED_SQL,),
)
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sentences written as TSV, labels with decimals, and read by the reader of that table."""
    path = fresh_path(spark, "sentences")
    rows = _awkward(views.labelled_sentences(spark, sf_dir))
    sinks.write_tsv(rows.withColumn("label", F.col("label").cast("double")), path)
    return delimited.read_labelled_tsv(spark, path, multi_line=True)


@query(
    "S14",
    f"select {views.clean_sql('text')} as line, count(*) as n from documents group by 1",
)
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "texts")
    texts = views.table(spark, sf_dir, "documents").select(clean_text(F.col("text")).alias("line"))
    sinks.write_text(texts, "line", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


