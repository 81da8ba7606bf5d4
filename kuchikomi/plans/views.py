"""Review-shaped views over the test tables, each with the SQL that defines the same rows.

Every view covers its tables whole. The SQL texts are common table expressions for the oracle queries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS, CONTENTS_MARKER, LIST_MARKER, PAGE_SIZE, SUBWORD_VOCABULARY, TOTAL_MARKER
from kuchikomi.functions.text import WHITESPACE
from kuchikomi.functions.tokens import SEGMENT, WORD
from kuchikomi.operators.corpus import aspect_corpus, flatten_scores, unpivot_aspects, with_sentiment
from kuchikomi.operators.trends import with_month
from kuchikomi.operators.vocabulary import MAX_PIECE_CHARS, train_vocabulary
from kuchikomi.session import prepare

NAMELESS_HOTEL = 24


# The test tables lie in a single row group each, which one task reads; these are always spread by a key, the wider the larger.
FIXTURE_PARTITIONS = 8
PARTITION_BYTES = 8 << 20
# Orders are narrow and become eight rows each, so as many bytes hold far more rows than elsewhere.
ROWS_BYTES = {"orders": 1 << 20}
SPREAD_BY = {"orders": "o_orderkey", "documents": "doc_id", "lineitem": "l_orderkey", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A test table; without ``spread`` as it lies, for what moves the rows itself or writes them where they are."""
    path = f"{sf_dir}/{name}.parquet"
    stored = prepare(spark).read.parquet(path)
    return stored.repartition(spread_partitions(spark, path), SPREAD_BY[name]) if spread and name in SPREAD_BY else stored


def spread_partitions(spark: SparkSession, path: str) -> int:
    """As many partitions as keep each small; sizes of files are listed, contents not read."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    most = ROWS_BYTES.get(path.rsplit("/", 1)[-1].removesuffix(".parquet"), PARTITION_BYTES)
    return max(FIXTURE_PARTITIONS, math.ceil(size / most))


# --- reviews: one per order, hotels are nations, comments are documents -----------------------------


# How many of 100 hash slots get which score; the SQL twin spells the same limits.
_SCORE_OF_SLOT = (
    "flatten(array(array_repeat(0D, 10), array_repeat(1D, 2), array_repeat(2D, 2), array_repeat(3D, 12),"
    " array_repeat(2.5D, 1), array_repeat(cast(null as double), 1), array_repeat(4D, 32), array_repeat(5D, 40)))"
)


def _score(aspect: str) -> Column:
    slot = f"cast(cast(conv(substr(md5(concat(review_id, '|{aspect}')), 1, 8), 16, 10) as bigint) % 100 as int)"
    return F.expr(f"get({_SCORE_OF_SLOT}, {slot})")


def reviews(spark: SparkSession, sf_dir: str, comments: bool = False) -> DataFrame:
    """Research records: hotel, review, post time with offset, scores by hash; one hotel has no name."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(
        nation, customer["c_nationkey"] == nation["n_nationkey"]
    )
    if comments:
        documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("comment"))
        total = documents.agg(F.count(F.lit(1))).scalar()
        joined = joined.withColumn("_doc", F.col("o_orderkey") % total)
        joined = joined.join(documents, joined["_doc"] == documents["doc_id"], "left")
    hotel = F.when(F.col("n_nationkey") != NAMELESS_HOTEL, F.col("n_name"))
    posted = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    flat = joined.select(
        F.col("n_nationkey").cast("string").alias("hotel_id"),
        F.col("o_orderkey").cast("string").alias("review_id"),
        hotel.alias("hotel_name"),
        *(["comment"] if comments else []),
        posted.alias("post_datetime"),
        F.col("o_orderstatus").alias("status"),
    )
    return flat.withColumn("scores", F.create_map(*[part for a in ASPECTS for part in (F.lit(a), _score(a))]))


def aspect_rows(spark: SparkSession, sf_dir: str, comments: bool = False) -> DataFrame:
    """All eight rows of every review, unrated ones included, labelled."""
    flat = flatten_scores(reviews(spark, sf_dir, comments))
    kept = ["hotel_id", "hotel_name", "review_id", "post_datetime", *(["comment"] if comments else [])]
    return with_sentiment(unpivot_aspects(flat, kept))


def rated_rows(spark: SparkSession, sf_dir: str, months: bool = False) -> DataFrame:
    """The labelled aspect corpus without comments, on demand with the month taken once per review."""
    keep = ["hotel_id", "hotel_name", "review_id", "post_datetime", *(["year_month"] if months else [])]
    research = reviews(spark, sf_dir)
    return aspect_corpus(with_month(research) if months else research, min_chars=None, keep=keep)


_ASPECT_VALUES = ", ".join(f"({i}, '{a}')" for i, a in enumerate(ASPECTS))

REVIEWS_SQL = f"""
numbered_reviews as (
  select n.n_nationkey::varchar as hotel_id, o.o_orderkey::varchar as review_id,
         case when n.n_nationkey <> {NAMELESS_HOTEL} then n.n_name end as hotel_name,
         strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+09:00' as post_datetime,
         o.o_orderdate - interval 9 hour as post_utc, o.o_orderstatus as status,
         o.o_orderkey % (select count(*) from documents) as doc_id
  from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey),
reviews as (select r.*, d.text as comment from numbered_reviews r left join documents d on d.doc_id = r.doc_id),
slots as (
  select r.*, a.aspect_idx::integer as aspect_idx, a.aspect,
         ('0x' || substr(md5(r.review_id || '|' || a.aspect), 1, 8))::bigint % 100 as slot
  from numbered_reviews r cross join (values {_ASPECT_VALUES}) a(aspect_idx, aspect)),
scored as (
  select *, (case when slot < 10 then 0.0 when slot < 12 then 1.0 when slot < 14 then 2.0 when slot < 26 then 3.0
                  when slot < 27 then 2.5 when slot < 28 then null when slot < 60 then 4.0 else 5.0 end)::double as score
  from slots),
aspect_rows as (
  select *, (case when score is null then null when score <= 2 then 0 when score = 3 then 1 else 2 end)::integer
            as sentiment_label from scored),
rated_rows as (
  select a.* from aspect_rows a
  where a.score > 0 and a.review_id in (select review_id from aspect_rows where aspect = 'room' and score is not null))
"""

# --- documents as reviews: source is the hotel -----------------------------------------------------


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("hotel_name"), F.col("text").alias("comment")
    )


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: id, quality, toxic."""
    return table(spark, sf_dir, "labels")


def labelled_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled-sentence table: polarity from labels, split from the language; one language has no known split."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    polarity = F.when(F.col("toxic") == 1, 9).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1).otherwise(0)
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "dev").when(F.col("lang") == "fr", "test")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        polarity.cast("int").alias("label"),
        "text",
        F.col("source").alias("annotation"),
        F.coalesce(split, F.lit("other")).alias("split"),
    )


LABELLED_SQL = """
labelled as (
  select d.doc_id::varchar as id,
         (case when l.toxic = 1 then 9 when l.quality = 1 then 1 when l.quality = 0 then -1 else 0 end)::integer as label,
         d.text, d.source as annotation,
         case d.lang when 'en' then 'train' when 'de' then 'dev' when 'fr' then 'test' else 'other' end as split
  from documents d left join labels l on l.doc_id = d.doc_id)
"""

# --- raw review lines and pages --------------------------------------------------------------------


def raw_reviews(documents: DataFrame) -> Column:
    """One document as a raw review; its scores hold a repeated, an empty and an unscored code."""
    code = lambda name, score: F.struct(F.lit(name).alias("code"), score.cast("double").alias("score"))
    return F.struct(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("title"),
        F.col("text").alias("comment"),
        (F.col("n_chars") % 5 + 1).cast("double").alias("overallScore"),
        F.lit("2024-03-01T08:00:00+09:00").alias("postDateTime"),
        F.struct(F.col("source").alias("name")).alias("provider"),
        F.array(
            code("ROOM", F.lit(1)),
            code("Bath", F.lit(None)),
            code("", F.lit(4)),
            code("room", F.col("n_chars") % 6),
            code("DINNER", F.lit(2.5)),
        ).alias("scores"),
    )


def review_lines(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """``(file_name, line, doc_id)``: a JSON line per document, cut short for documents of low quality, and
    a blank line beside every toxic one."""
    documents = table(spark, sf_dir, "documents", spread)
    labels = table(spark, sf_dir, "labels")
    line = F.to_json(raw_reviews(documents), {"ignoreNullFields": "false"})
    cut = F.when(F.col("quality") == 0, F.substring(line, F.lit(1), F.length(line) - 10)).otherwise(line)
    lines = F.when(F.col("toxic") == 1, F.array(cut, F.lit("  　"))).otherwise(F.array(cut))
    return documents.join(labels, "doc_id", "left").select(
        F.concat(F.lit("hotel_"), "source", F.lit("_reviews.jsonl")).alias("file_name"),
        F.explode(lines).alias("line"),
        "doc_id",
    )


BROKEN_SQL = "broken as (select doc_id from labels where quality = 0)"


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML pages of consecutive documents; the last review of a page shows up again on the next one.

    Pages whose first document is German lack the marker. At most one page size plus one rows are gathered
    per page.
    """
    documents = table(spark, sf_dir, "documents")
    total = documents.agg(F.count(F.lit(1))).scalar()
    page = F.floor(F.col("doc_id") / PAGE_SIZE).cast("bigint")
    last = F.col("doc_id") % PAGE_SIZE == PAGE_SIZE - 1
    placed = documents.select(
        "doc_id",
        "lang",
        raw_reviews(documents).alias("review"),
        F.explode(F.when(last, F.array(page, page + 1)).otherwise(F.array(page))).alias("page_id"),
    )
    gathered = placed.groupBy("page_id").agg(
        F.min(F.struct("doc_id", "lang"))["lang"].alias("first_lang"),
        F.array_sort(F.collect_list(F.struct("doc_id", "review"))).alias("rows"),
    )
    contents = F.to_json(F.transform("rows", lambda r: r["review"]))
    marker = F.when(F.col("first_lang") == "de", F.lit('"reviews":{')).otherwise(F.lit(LIST_MARKER))
    html = F.concat(
        F.lit('<html><head><script>var state={"total":7,'),
        marker,
        F.lit(f'"page":1,{TOTAL_MARKER}'),
        total.cast("string"),
        F.lit(f",{CONTENTS_MARKER}"),
        contents,
        F.lit(',"next":["a","b"]}}}</script></head><body>[reviews]</body></html>'),
    )
    return gathered.select("page_id", html.alias("html"))


PAGES_SQL = f"""
placed as (
  select unnest(case when doc_id % {PAGE_SIZE} = {PAGE_SIZE - 1} then [doc_id // {PAGE_SIZE}, doc_id // {PAGE_SIZE} + 1]
                     else [doc_id // {PAGE_SIZE}] end) as page_id, * from documents),
readable as (
  select page_id, first(lang order by doc_id) as first_lang from placed group by page_id having first_lang <> 'de'),
on_page as (
  select p.*, (row_number() over (partition by p.page_id order by p.doc_id) - 1)::integer as position
  from placed p join readable r on p.page_id = r.page_id)
"""

# --- predictions -----------------------------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores from embeddings: three entries as logits and a fourth to be ignored; aspect -1 is unknown."""
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings.select(
        "vec_id",
        F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("logits"),
        (F.col("vec_id") % 9 - 1).cast("int").alias("aspect_idx"),
        (F.col("label") % 3).cast("int").alias("label"),
    )


PREDICTIONS_SQL = """
logits as (
  select vec_id, (vec_id % 9 - 1)::integer as aspect_idx, (label % 3)::integer as label,
         embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings),
predictions as (
  select *, (case when a >= b and a >= c then 0 when b >= c then 1 else 2 end)::integer as predicted from logits)
"""

# --- vocabulary ------------------------------------------------------------------------------------


_VOCABULARIES: dict[tuple[str, str], DataFrame] = {}


def stored_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents, trained once per session and folder and kept in memory: it is small by construction."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = train_vocabulary(table(spark, sf_dir, "documents"), "text").persist()
    return _VOCABULARIES[key]


def _re2(pattern: str) -> str:
    """Script classes are spelled without the ``Is`` prefix there; quotes are doubled for SQL."""
    return pattern.replace(r"\p{Is", r"\p{").replace("'", "''")


WORD_SQL = _re2(WORD)
SEGMENT_SQL = _re2(SEGMENT)


def clean_sql(text: str) -> str:
    return f"coalesce(trim(regexp_replace({text}, '[{WHITESPACE}]+', ' ', 'g'), ' '), '')"


def strip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{WHITESPACE}]+|[{WHITESPACE}]+\z', '', 'g')"


VOCABULARY_SQL = f"""
segments as (
  select segment, count(*) as n
  from (select unnest(regexp_extract_all(text, '{SEGMENT_SQL}')) as segment from documents) group by segment),
chars as (
  select piece, sum(n)::bigint as n
  from (select unnest(regexp_extract_all(segment, '(?s:.)')) as piece, n from segments) group by piece),
grams as (
  select piece, sum(n)::bigint as n
  from (select unnest([substr(segment, i, k) for i in range(1, length(segment) - k + 2)]) as piece, n
        from segments cross join range(2, {MAX_PIECE_CHARS + 1}) t(k) where length(segment) >= k)
  group by piece order by sum(n) * length(piece) desc, piece limit {SUBWORD_VOCABULARY - 4}),
numbered as (
  select (row_number() over (order by is_char desc, n * length(piece) desc, piece) + 3)::integer as id, piece, n, is_char
  from (select piece, n, true as is_char from chars union all select piece, n, false from grams)),
vocabulary as (
  select id, piece, n from numbered where is_char or id < {SUBWORD_VOCABULARY}
  union all select * from (values (0, '<pad>', 0), (1, '<unk>', 0), (2, '<s>', 0), (3, '</s>', 0)) s(id, piece, n)),
matcher as (
  select string_agg(regexp_escape(piece), '|' order by length(piece) desc, piece) || '|(?s:.)' as pattern
  from vocabulary where id > 3 and length(piece) > 1)
"""
