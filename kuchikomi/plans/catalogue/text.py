"""Tokens, vocabulary and features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kuchikomi.domain import SAMPLED_PIECE_IDS, TRAINING_SEQUENCE_LENGTH
from kuchikomi.functions import tokens
from kuchikomi.functions.text import char_length
from kuchikomi.operators import features, unigram, vocabulary
from kuchikomi.plans import views
from kuchikomi.plans.catalogue.registry import query
from kuchikomi.session import fresh_path

LENGTH = TRAINING_SEQUENCE_LENGTH


def _joined(ids: Column) -> Column:
    """Id sequences as text: array columns look different in every client."""
    return F.array_join(ids.cast("array<string>"), " ")


def _pad_sql(ids: str, length: int = LENGTH) -> str:
    return f"array_to_string(list_resize({ids}, {length}, 0), ' ')"



def _chars(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s:.)')"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{views.WORD_SQL}')"


def _char_ids(text: str) -> str:
    return f"list_transform({_chars(text)}, lambda c: unicode(c) % 5000)"


def _word_ids(text: str) -> str:
    return f"list_transform({_words(text)}, lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 50000)"


@query(
    "G1 G2 G3",
    f"select doc_id, len({_chars('text')}) as n_tokens, {_pad_sql(_char_ids('text'))} as ids from documents",
)
def char_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = tokens.char_tokens(F.col("text"))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(chars).cast("bigint").alias("n_tokens"), _joined(tokens.padded(tokens.char_ids(chars), LENGTH)).alias("ids")
    )


@query(
    "G4 G5 G3",
    f"""select doc_id, len({_words('text')}) as n_tokens, array_to_string({_words('text')}, ' ') as words,
        {_pad_sql(_word_ids('text'))} as ids from documents""",
)
def word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens.word_tokens(F.col("text"))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_tokens"),
        F.array_join(words, " ").alias("words"),
        _joined(tokens.padded(tokens.word_ids(words), LENGTH)).alias("ids"),
    )


@query("G6", "select id, piece, n from vocabulary", (views.VOCABULARY_SQL,))
def subword_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.train_vocabulary(views.table(spark, sf_dir, "documents"), "text")


@query(
    "G7 T6",
    f"select id, piece from vocabulary where id < 20 or id in {SAMPLED_PIECE_IDS}",
    (views.VOCABULARY_SQL,),
)
def vocabulary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty pieces and the sampled ids."""
    stored = views.stored_vocabulary(spark, sf_dir)
    sampled = vocabulary.pieces_by_id(stored, SAMPLED_PIECE_IDS)
    return vocabulary.vocabulary_head(stored).unionByName(sampled).distinct()


_ENCODED_SQL = """
encoded as (
  select doc_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) as place
  from (select doc_id, regexp_extract_all(text, pattern) as pieces from documents cross join matcher))
"""


@query(
    "G7",
    """select doc_id, count(*) as n_pieces, string_agg(e.piece, '' order by place) as text,
              string_agg(coalesce(v.id, 1)::varchar, ' ' order by place) as ids
       from encoded e left join vocabulary v on v.piece = e.piece and v.id > 3 group by doc_id""",
    (views.VOCABULARY_SQL, _ENCODED_SQL),
)
def subword_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces and ids, and put together again."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = vocabulary.encode(documents, "text", views.stored_vocabulary(spark, sf_dir))
    return encoded.select(
        "doc_id",
        F.size("subword_pieces").cast("bigint").alias("n_pieces"),
        F.array_join("subword_pieces", "").alias("text"),
        _joined(F.col("subword_ids")).alias("ids"),
    )


@query(
    "A28 A29",
    f"""
    , counts as (
      select length(text) as character, len(regexp_extract_all(text, pattern)) as subword, len({_words('text')}) as word
      from documents cross join matcher),
    long as (unpivot counts on character, subword, word into name granularity value tokens)
    select granularity, sum(tokens)::double / count(*) as mean_tokens, median(tokens) as median_tokens,
           min(tokens) as min_tokens, max(tokens) as max_tokens,
           sum(tokens)::double / (select sum(character) from counts) as tokens_per_character
    from long group by granularity""",
    (views.VOCABULARY_SQL,),
)
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    return features.token_statistics(documents, "text", views.stored_vocabulary(spark, sf_dir))


@query(
    "G8 T6",
    f"""
    , sample as (select conv_id, turn, text from conversations order by conv_id, turn limit 10)
    select conv_id, turn, text, array_to_string({_chars('text')}, ' | ') as characters,
           array_to_string(regexp_extract_all(text, pattern), ' | ') as subwords,
           array_to_string({_words('text')}, ' | ') as words
    from sample cross join matcher""",
    (views.VOCABULARY_SQL,),
)
def token_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten conversation turns cut by the vocabulary of the documents, unknown characters included."""
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return features.token_preview(turns, "text", views.stored_vocabulary(spark, sf_dir), ["conv_id", "turn"])


@query(
    "P21 on conversations",
    """select conv_id, count(*) as n_turns, arg_min(role, turn) as first_role, arg_max(text, turn) as last_text
       from conversations group by conv_id""",
)
def conversation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last element of a group, as an aggregate, so that no group is gathered."""
    return (
        views.table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.min_by("role", "turn").alias("first_role"),
            F.max_by("text", "turn").alias("last_text"),
        )
    )


_FEATURE_TEXT_SQL = f"""
conditioned as (
  select r.review_id, r.aspect, r.aspect_idx, r.sentiment_label as label, '[' || r.aspect || '] ' as bracket, d.text as comment
  from rated_rows r join (select * from documents where length({views.strip_sql('text')}) >= 5) d on d.doc_id = r.doc_id)
"""


@query(
    "G9 (characters, words) G3 P19 P20",
    f"""
    , texts as (select comment, {_char_ids('comment')}[1:{LENGTH}] as chars, {_word_ids('comment')}[1:{LENGTH}] as words
                from (select distinct comment from conditioned))
    select review_id, aspect_idx, label,
           {_pad_sql(f"list_concat({_char_ids('bracket')}, chars)")} as char_ids,
           {_pad_sql(f"list_concat({_word_ids('bracket')}, words)")} as word_ids
    from conditioned join texts using (comment)""",
    (views.REVIEWS_SQL, _FEATURE_TEXT_SQL),
)
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character and word sequences of every example."""
    rows = _examples(spark, sf_dir)
    return rows.select("review_id", "aspect_idx", "label", _joined(F.col("char_ids")).alias("char_ids"), _joined(F.col("word_ids")).alias("word_ids"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.stored_vocabulary(spark, sf_dir)
    return features.corpus_features(views.reviews(spark, sf_dir, comments=True), stored, LENGTH)


@query(
    "G9 (subwords, mask) G7",
    f"""
    , distinct_texts as (select distinct comment as text from conditioned union select distinct bracket from conditioned),
    text_pieces as (
      select text, unnest(pieces) as piece, generate_subscripts(pieces, 1) as place
      from (select text, regexp_extract_all(text, pattern)[1:{LENGTH}] as pieces from distinct_texts cross join matcher)),
    text_ids as (
      select text, list(coalesce(v.id, 1) order by place) as ids
      from text_pieces p left join vocabulary v on v.piece = p.piece and v.id > 3 group by text)
    select review_id, aspect_idx, {_pad_sql('list_concat(b.ids, t.ids)')} as subword_ids,
           least(len(b.ids) + len(t.ids), {LENGTH}) as attended
    from conditioned c join text_ids b on b.text = c.bracket join text_ids t on t.text = c.comment""",
    (views.REVIEWS_SQL, _FEATURE_TEXT_SQL, views.VOCABULARY_SQL),
)
def subword_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword sequences of every example, and how many positions the mask leaves open."""
    return _examples(spark, sf_dir).select(
        "review_id",
        "aspect_idx",
        _joined(F.col("subword_ids")).alias("subword_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda total, m: total + m).cast("bigint").alias("attended"),
    )


@query(
    "G6 (text feed) A1",
    "select count(*) as sentences, sum(length(text))::bigint as chars from documents",
)
def vocabulary_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(char_length(F.col("text"))).alias("chars")
    )




_UNIGRAM_SIZE = 600


@query(
    "G6 (by likelihood)",
    """
    , many as (select count(*) as n from chars)
    select fact, value from (
      select 'characters' as fact, n::double as value from many union all
      select 'pieces', greatest(n, 596)::double + 4 from many union all
      select 'likelihood_never_falls', 1.0 union all select 'likelier_than_counted', 1.0 union all select 'probabilities_add_up', 1.0)""",
    (views.VOCABULARY_SQL,),
)
def unigram_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary trained by expectation-maximisation, and what must hold of it; the counted one is less likely."""
    documents = views.table(spark, sf_dir, "documents").select("text")
    found, history = unigram.train_unigram(documents, "text", _UNIGRAM_SIZE)
    rows = found.where("id > 3").collect()
    falls = [b[1] < a[1] - 1e-9 * abs(a[1]) for a, b in zip(history, history[1:]) if a[0] == b[0]]
    runs = vocabulary.segments(documents, "text")
    counted = {r.piece: r.n for r in vocabulary.train_vocabulary(documents, "text", _UNIGRAM_SIZE).where("n > 0").collect()}
    by_count = {p: math.log(n / sum(counted.values())) for p, n in counted.items()}
    own = {r.piece: r.score for r in rows}
    facts = {
        "characters": float(sum(len(r.piece) == 1 for r in rows)),
        "pieces": float(len(rows) + 4),
        "likelihood_never_falls": float(not any(falls)),
        "likelier_than_counted": float(unigram.expected_uses(runs, own)[0] > unigram.expected_uses(runs, by_count)[0]),
        "probabilities_add_up": float(abs(sum(map(math.exp, own.values())) - 1) < 1e-9),
    }
    return spark.createDataFrame(list(facts.items()), "fact string, value double")


@query("G7 (best segmentation)", "select doc_id, length(text) as chars, md5(text) as text_digest, 0::bigint as unknown, true as in_order from documents")
def best_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into its most likely pieces, put together again, all of them known."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "unigram")
    unigram.train_unigram(documents, "text", _UNIGRAM_SIZE, rounds=1)[0].write.parquet(path)
    cut = unigram.segmented(documents, "text", spark.read.parquet(path))
    joined = F.array_join("subword_pieces", "")
    return cut.select(
        "doc_id",
        char_length(joined).alias("chars"),
        F.md5(joined).alias("text_digest"),
        F.size(F.filter("subword_ids", lambda i: i < 4)).cast("bigint").alias("unknown"),
        (F.size("subword_ids") == F.size("subword_pieces")).alias("in_order"),
    )
