from __future__ import annotations

import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS
from kuchikomi.operators import audit, collection, corpus, duplicates, frequency, trends

RESEARCH = "hotel_id string, hotel_name string, review_id string, comment string, post_datetime string, scores map<string,double>"


@pytest.fixture(scope="module")
def research(spark):
    rows = [
        ("2", "B", "r1", "　とても良い　", "2024-02-01", {"room": 4.0, "bath": 0.0, "dinner": 2.5}),
        ("1", "A", "r2", "四文字だ", "2024-01-01", {"room": 4.0}),
        ("1", "A", "r3", "五文字です", "2024-03-01", {"room": None, "bath": 5.0}),
        ("1", "A", "r4", "部屋は普通です", None, {"room": 3.0, "location": 2.0}),
        ("1", "A", "r5", None, "2024-01-01", {"room": 3.0}),
        ("1", "A", "r6", "採点なしの感想", "2024-01-02", {}),
        (None, None, "r7", "宿の名前がない", "2024-01-03", {"room": 0.0, "facility": float("nan"), "breakfast": 1.0}),
    ]
    return spark.createDataFrame(rows, RESEARCH)


def test_aspect_corpus(research):
    rows = corpus.aspect_corpus(research, ordered=True).collect()
    assert [(r.review_id, r.aspect, r.score, r.sentiment_label) for r in rows] == [
        ("r4", "room", 3.0, 1),
        ("r4", "location", 2.0, 0),
        ("r1", "room", 4.0, 2),
        ("r1", "dinner", 2.5, 2),
        ("r7", "breakfast", 1.0, 0),
    ]
    assert rows[0].__fields__ == [*corpus.REVIEW_COLUMNS, "aspect", "score", "sentiment_label"]


def test_aspect_corpus_without_required_aspect(research):
    found = corpus.aspect_corpus(research, required_aspect=None, min_chars=None)
    assert ("r3", "bath") in {(r.review_id, r.aspect) for r in found.collect()}


def test_unpivot_skips_absent_columns(spark):
    flat = spark.createDataFrame([("r", 1.0, None)], "review_id string, bath double, room double")
    found = corpus.unpivot_aspects(flat, ["review_id"]).collect()
    assert [(r.aspect, r.score) for r in found] == [("room", None), ("bath", 1.0)]


def _aspect_rows(spark, counts):
    """Rows for {(hotel, month, aspect): scores}."""
    rows = [
        (h, f"{h}{m}{a}{i}", f"{m}-15T00:00:00Z", a, float(s), 0 if s <= 2 else 1 if s == 3 else 2)
        for (h, m, a), scores in counts.items()
        for i, s in enumerate(scores)
    ]
    return spark.createDataFrame(
        rows, "hotel_name string, review_id string, post_datetime string, aspect string, score double, sentiment_label int"
    )


def test_trend_compares_with_last_kept_month(spark):
    rows = _aspect_rows(
        spark,
        {
            ("A", "2024-01", "room"): [4] * 5,
            ("A", "2024-02", "room"): [1] * 4,
            ("A", "2024-03", "room"): [2] * 6,
            ("B", "2024-02", "room"): [5],
            ("A", "2024-01", "bath"): [3] * 5,
        },
    )
    found = {(r.year_month, r.aspect): r for r in trends.global_trend(rows).collect()}
    assert set(found) == {("2024-01", "room"), ("2024-02", "room"), ("2024-03", "room"), ("2024-01", "bath")}
    assert found["2024-02", "room"].avg_score == 1.8 and found["2024-02", "room"].review_count == 5
    hotel = {(r.hotel_name, r.year_month, r.aspect): r for r in trends.hotel_trend(rows).collect()}
    assert set(hotel) == {("A", "2024-01", "room"), ("A", "2024-03", "room"), ("A", "2024-01", "bath")}
    assert hotel["A", "2024-03", "room"].score_delta == -2.0 and hotel["A", "2024-03", "room"].sentiment_delta == -2.0
    assert hotel["A", "2024-01", "room"].score_delta is None


def test_trend_drops_null_hotels_only_by_hotel(spark):
    rows = _aspect_rows(spark, {("A", "2024-01", "room"): [4] * 5}).withColumn("hotel_name", F.lit(None).cast("string"))
    assert trends.global_trend(rows).count() == 1
    assert trends.hotel_trend(rows).count() == 0
    undated = rows.withColumn("post_datetime", F.lit(None).cast("string"))
    assert trends.global_trend(undated).count() == 0
    assert trends.global_trend(trends.with_month(undated)).count() == 0


def test_top_movers_ties_and_nulls(spark):
    rows = spark.createDataFrame(
        [("2024-02", "room", 1.0), ("2024-03", "bath", 1.0), ("2024-01", "bath", None), ("2024-04", "bath", -1.0)],
        "year_month string, aspect string, score_delta double",
    )
    assert [(r.aspect, r.year_month) for r in trends.top_movers(rows).collect()] == [
        ("bath", "2024-03"), ("room", "2024-02"), ("bath", "2024-04"),
    ]
    assert [r.score_delta for r in trends.top_movers(rows, rises=False, n=4).collect()] == [-1.0, 1.0, 1.0, None]


def test_first_per_key_with_a_hot_key(spark):
    rows = [("hot", i % 7, i, f"p{i}") for i in range(1000)] + [(None, 3, 1, "n1"), (None, 2, 9, "n2"), ("x", 1, 1, "x")]
    df = spark.createDataFrame(rows, "id string, page int, position int, payload string").repartition(5)
    found = {r.id: r for r in collection.first_per_key(df, "id", ["page", "position"]).collect()}
    assert len(found) == 3
    assert (found["hot"].page, found["hot"].position, found["hot"].payload) == (0, 0, "p0")
    assert found[None].payload == "n2"
    assert collection.first_per_key(df, "id", ["page", "position"]).columns == df.columns


def test_first_per_key_keeps_one_row_per_map_task(spark):
    df = spark.range(10_000).select(F.concat(F.lit("hot"), F.col("id") % 1).alias("id"), F.col("id").alias("n"))
    plan = collection.first_per_key(df, "id", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Aggregate" not in plan


def test_identified_and_resuming(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",), ("b",)], "id string")
    left = collection.identified(rows)
    assert [r.id for r in collection.not_yet_collected(left, spark.createDataFrame([("a",)], "id string"), "id").collect()] == ["b"]


def test_reconciliation(spark):
    held = spark.createDataFrame([("h", "1"), ("h", "1"), ("h", "2"), ("g", "9")], "hotel_id string, review_id string")
    totals = spark.createDataFrame([("h", 5), ("h", 4), ("g", 0), ("i", 3)], "hotel_id string, reported_total bigint")
    found = {r.hotel_id: tuple(r)[1:] for r in collection.reconciliation(held, totals).collect()}
    assert found == {"h": (2, 5, 3), "g": (1, 0, 0), "i": (0, 3, 3)}


def test_null_distinct_and_repeated_counts(spark):
    long = "x" * 100
    df = spark.createDataFrame([(1, "a"), (1, None), (2, long), (None, long), (1, "a")], "k int, t string")
    assert {r.column_name: r.nulls for r in audit.null_counts(df).collect()} == {"k": 1, "t": 1}
    assert {r.column_name: r.distinct_values for r in audit.distinct_counts(df, ["k", "t"]).collect()} == {"k": 2, "t": 2}
    assert {r.column_name: r.repeated for r in audit.repeated_values(df, ["k", "t"]).collect()} == {"k": 2, "t": 2}
    assert audit.repeated_rows(df).first().repeated_rows == 1
    assert audit.repeated_rows(df.limit(0)).first().repeated_rows == 0


def test_lengths(spark):
    texts = ["", "a", "あい", "abcd", "x" * 10, None]
    lengths = [len(t) for t in texts if t is not None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert tuple(audit.length_summary(df, "t").first()) == (0, 10, statistics.mean(lengths), statistics.median(lengths))
    found = {r.statistic: r.value for r in audit.length_description(df, "t").collect()}
    assert found["count"] == 5 and found["max"] == 10 and found["p50"] == 2
    assert found["std"] == pytest.approx(statistics.stdev(lengths))
    assert found["p90"] == pytest.approx(4 + 0.6 * 6)
    single = audit.length_description(df.limit(1), "t").collect()
    assert {r.statistic: r.value for r in single}["std"] is None


def test_text_audits(spark):
    df = spark.createDataFrame([(1, None), (2, "　 "), (3, "四文字だ"), (4, "五文字です"), (4, "五文字です")], "review_id int, comment string")
    found = audit.missing_texts(df).first()
    assert (found.null_or_empty, found.short_with_empty, found.null_or_empty_pct) == (2, 2, 40.0)
    assert audit.empty_texts(df, "comment").first().empty_texts == 1
    verdict = audit.ids_against_texts(df).first()
    assert (verdict.unique_ids, verdict.unique_texts, verdict.difference, verdict.verdict) == (4, 3, 1, "texts repeat across ids")


def test_date_audit_and_coverage(spark):
    df = spark.createDataFrame(
        [("2024-01-01T00:00:00+09:00", "A", None), ("2024/99", None, "x"), (None, "A", None), ("2024-03-01", "A", "y")],
        "post_datetime string, hotel_name string, check_in_date string",
    )
    found = audit.date_audit(df).first()
    assert (found.null_dates, found.malformed_dates, found.null_hotels, found.malformed_dates_pct) == (1, 1, 1, 25.0)
    covered = audit.temporal_coverage(df).select(F.date_format("first_post", "yyyy-MM-dd HH").alias("f"), "missing_or_invalid", "check_in_missing").first()
    assert tuple(covered) == ("2023-12-31 15", 2, 2)
    empty = audit.date_audit(df.limit(0)).first()
    assert (empty.total_rows, empty.null_dates_pct) == (0, None)


def test_domain_check(spark):
    df = spark.createDataFrame([(a,) for a in ASPECTS] + [(None,)], "aspect string")
    assert {r.standing for r in audit.domain_check(df).collect()} == {"ok"}
    assert audit.domain_check(df).first().matches is True
    wrong = audit.domain_check(df.replace({"room": "Room"}, subset=["aspect"])).collect()
    assert {(r.aspect, r.standing) for r in wrong if r.standing != "ok"} == {("room", "missing"), ("Room", "unexpected")}
    assert {r.matches for r in wrong} == {False}


def test_aspect_nulls(spark):
    df = spark.createDataFrame([("room", None, None), ("room", 1.0, 0), ("bath", 2.0, None)], "aspect string, score double, sentiment_label int")
    found = {r.aspect: (r.n, r.null_scores, r.null_scores_pct, r.null_labels) for r in audit.aspect_nulls(df).collect()}
    assert found == {"room": (2, 1, 50.0, 1), "bath": (1, 0, 0.0, 1)}


def test_frequencies_and_shares(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), (None, 2), ("c", None)], "k string, l int")
    assert [tuple(r) for r in frequency.by_count(frequency.frequencies(df, "k")).collect()] == [("a", 2), ("b", 1), ("c", 1)]
    kept = frequency.by_value(frequency.frequencies(df, "k", keep_null=True)).collect()
    assert tuple(kept[-1]) == (None, 1)
    assert {r.k: r.pct for r in frequency.shares(df, "k").collect()} == {"a": 50.0, "b": 25.0, "c": 25.0}
    assert {r.k: r.pct for r in frequency.shares(df, "k", of_all_rows=True).collect()}["a"] == 40.0
    assert {tuple(r) for r in frequency.contingency(df, "k", "l").collect()} == {("a", 1, 1), ("a", 2, 1), ("b", 1, 1)}
    assert {tuple(r) for r in frequency.crosstab(df, "k", "l", [1, 2]).collect()} == {("a", 1, 1), ("b", 1, 0)}


def test_shown_percentages_round_half_to_even(spark):
    from kuchikomi.functions.scores import shown_percent

    rows = spark.createDataFrame([(1, 800), (3, 800)], "n int, total int")
    assert [r.v for r in rows.select(shown_percent(F.col("n"), F.col("total")).alias("v")).collect()] == [0.12, 0.38]


def test_value_samples_against_sorting(spark):
    values = [f"{'common-prefix-of-many-values' if i % 3 else 'z'}{i:04d}" for i in range(300)] + [None]
    df = spark.createDataFrame([(v, i % 5) for i, v in enumerate(values)] * 2, "t string, k int")
    found = frequency.value_samples(df, 20).collect()
    sampled = sorted((r.place, r.value) for r in found if r.column_name == "t")
    assert [v for _, v in sampled] == sorted(v for v in values if v)[:20]
    assert sorted(r.value for r in found if r.column_name == "k") == ["0", "1", "2", "3", "4"]
    few = spark.createDataFrame([("b",), (None,), ("a",)], "t string")
    assert [r.value for r in sorted(frequency.value_samples(few).collect(), key=lambda r: r.place)] == ["a", "b", None]


def test_duplicates_against_counting(spark):
    rows = [(i, ["A", "B", None][i % 3], "同じ" if i < 90 else f"text {i // 2}") for i in range(150)]
    rows += [(200, "A", "only A"), (201, "A", "only A"), (202, "B", None), (203, "B", None), (0, "C", "ignored repeat of a review")]
    firsts = {}
    for review, hotel, comment in rows:
        firsts.setdefault(review, (hotel, comment))
    groups = {}
    for hotel, comment in firsts.values():
        if comment is not None:
            groups.setdefault(comment, []).append(hotel)
    repeated = {c: hotels for c, hotels in groups.items() if len(hotels) > 1}
    order = ["place"]
    placed = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "place int, review_id int, hotel_name string, comment string"
    ).repartition(7)
    found = duplicates.duplicate_summary(placed, order_by=order).first()
    assert found.repeated_comments == len(repeated)
    assert found.cross_hotel_comments == sum(len(set(h)) > 1 for h in repeated.values())
    top = duplicates.cross_hotel_examples(placed, order_by=order, examples=1).collect()
    assert {r.hotel_name for r in top} == {"A", "B", None}
    assert {(r.comment, r.n_reviews, r.n_hotels) for r in top} == {("同じ", 90, 3)}
    assert Counter(r.n_hotels for r in duplicates.repeated_comments(placed, order_by=order).collect())[1] == 1
