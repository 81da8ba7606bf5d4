"""Fixed domains and table schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Aspects in id order, 0 to 7.
ASPECTS = (
    "room",
    "hospitality",
    "location",
    "bath",
    "facility",
    "cleanliness",
    "breakfast",
    "dinner",
)

# Sentiment classes.
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2
LABELS = (NEGATIVE, NEUTRAL, POSITIVE)

# Thresholds, page size and seed.
MIN_COMMENT_CHARS = 5
MIN_GROUP_REVIEWS = 5
PAGE_SIZE = 20
SEED = 42
UNKNOWN_HOTEL = "Unknown_Hotel"

# Split names.
TRAIN, VALIDATION, TEST = "train", "val", "test"
PREASSIGNED_SPLITS = ("train", "dev", "test")

# Rows per class in the small balanced-training subset.
SUBSET_CAPS = {POSITIVE: 240, NEUTRAL: 45, NEGATIVE: 15}

# Sampler check, batches inspected and rows per batch.
CHECKED_BATCHES = 20
BATCH_ROWS = 8

# Id spaces and sequence lengths.
WORD_ID_SPACE = 50_000
CHAR_ID_SPACE = 5_000
SEQUENCE_LENGTH = 128
TRAINING_SEQUENCE_LENGTH = 64

# Subword vocabulary.
SUBWORD_VOCABULARY = 1600
PAD_ID, UNKNOWN_ID, BEGIN_ID, END_ID = 0, 1, 2, 3
SPECIAL_PIECES = ("<pad>", "<unk>", "<s>", "</s>")
SAMPLED_PIECE_IDS = (10, 50, 100, 500, 1000)

# Markers around the JSON array embedded in a review page.
LIST_MARKER = '"reviewList":{"data":{'
TOTAL_MARKER = '"total":'
CONTENTS_MARKER = '"contents":'

# Terms counted and URL fragments looked for in page markup.
PAGINATION_TERMS = ("pagination", "page", "offset", "limit", "reviewList", "currentPage", "total")
PAGINATION_URL_PARTS = ("page=", "offset=", "review")
PAGINATION_URLS_SHOWN = 20
PAGINATION_URL_CHARS = 300

# Keywords by which an asset audit recognises columns.
ASPECT_COLUMN_KEYWORDS = ("room", "hospitality", "location", "bath", "facility", "cleanliness", "score")
HOTEL_COLUMN_KEYWORDS = ("hotel", "provider")

CORRUPT = "_corrupt"

# What null is written as in delimited files, so that it differs from an empty text.
NULL_TEXT = r"\N"

RAW_REVIEW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("overallScore", T.DoubleType()),
        T.StructField("postDateTime", T.StringType()),
        T.StructField("provider", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("reservation", T.StructType([T.StructField("checkInDate", T.StringType())])),
        T.StructField(
            "scores",
            T.ArrayType(
                T.StructType(
                    [T.StructField("code", T.StringType()), T.StructField("score", T.DoubleType())]
                )
            ),
        ),
    ]
)

RESEARCH = T.StructType(
    [
        T.StructField("hotel_id", T.StringType()),
        T.StructField("review_id", T.StringType()),
        T.StructField("hotel_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("overall_score", T.DoubleType()),
        T.StructField("post_datetime", T.StringType()),
        T.StructField("check_in_date", T.StringType()),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("source", T.StringType()),
    ]
)

ASPECT_ROWS = T.StructType(
    [
        T.StructField("hotel_id", T.StringType()),
        T.StructField("hotel_name", T.StringType()),
        T.StructField("review_id", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("post_datetime", T.StringType()),
        T.StructField("aspect", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("sentiment_label", T.IntegerType()),
    ]
)

LABELLED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("annotation", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)
