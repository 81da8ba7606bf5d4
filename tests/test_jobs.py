"""The whole way from review lines and pages to a trained classifier, on hand-made files."""

from __future__ import annotations

import json
import random

import pytest

from kuchikomi.__main__ import main
from kuchikomi.plans import jobs

WORDS = {0: "最悪 汚い 狭い 臭い", 1: "普通 まあまあ 並", 2: "最高 綺麗 広い 快適"}


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lines")
    rng = random.Random(1)
    for hotel in range(10):
        rows = []
        for i in range(30):
            stars = rng.choice([1, 2, 3, 3, 4, 5, 5, 5])
            kind = 0 if stars <= 2 else 1 if stars == 3 else 2
            rows.append(
                {
                    "id": hotel * 1000 + i,
                    "comment": "　".join(rng.choices(WORDS[kind].split(), k=5)),
                    "postDateTime": f"2024-{1 + i % 3:02d}-10T00:00:00+09:00",
                    "provider": {"name": f"宿{hotel}"},
                    "scores": [{"code": c, "score": stars} for c in ("ROOM", "BATH", "DINNER")] + [{"code": "LOCATION", "score": 0}],
                }
            )
        text = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n{broken\n"
        (folder / f"hotel_{hotel}_reviews.jsonl").write_text(text, encoding="utf8")
    return str(folder / "hotel_*_reviews.jsonl")


@pytest.fixture(scope="module")
def stored(spark, lines, tmp_path_factory):
    """Run the jobs that feed the others."""
    root = tmp_path_factory.mktemp("stored")
    paths = {n: str(root / n) for n in ("research", "aspects", "splits", "vocabulary", "trends", "features", "model", "small")}
    reports = {
        "research": jobs.build_research(spark, lines, paths["research"], source="site"),
        "aspects": jobs.build_aspects(spark, paths["research"], paths["aspects"]),
        "splits": jobs.make_splits(spark, paths["aspects"], paths["splits"]),
        "vocabulary": jobs.build_vocabulary(spark, paths["research"], paths["vocabulary"], size=120),
        "trends": jobs.analyse_trends(spark, paths["aspects"], paths["trends"]),
    }
    return paths, reports


def test_corpus_jobs(stored):
    paths, reports = stored
    ingest = reports["research"]["ingest"].collect()
    assert {(r.input_reviews, r.written_reviews, r.skipped_reviews) for r in ingest} == {(31, 30, 1)} and len(ingest) == 10
    assert reports["research"]["rejected"].count() == 10
    assert tuple(reports["research"]["totals"].first()) == (310, 300, 10)
    # Counted while writing: what is reported needs no table.
    plans = [reports["aspects"][name]._jdf.queryExecution().executedPlan().toString() for name in ("aspects", "labels")]
    assert not any("Scan parquet" in plan for plan in plans)
    stored_rows = reports["aspects"]["aspects"].sparkSession.read.parquet(paths["aspects"])
    for name, column in (("aspects", "aspect"), ("labels", "sentiment_label")):
        again = {r[column]: r["count"] for r in stored_rows.groupBy(column).count().collect()}
        assert {r[column]: r.n for r in reports["aspects"][name].collect()} == again
    summary = reports["aspects"]["summary"].first()
    assert (summary.reviews, summary.records) == (300, 900)
    assert {r.aspect: r.n for r in reports["aspects"]["aspects"].collect()} == {"room": 300, "bath": 300, "dinner": 300}


def test_split_jobs(stored):
    _, reports = stored
    assert {r.split: r.n_groups for r in reports["splits"]["review"].collect()} == {"train": 240, "val": 30, "test": 30}
    assert {r.split: r.n_groups for r in reports["splits"]["hotel"].collect()} == {"train": 8, "val": 1, "test": 1}


def test_trend_job(spark, stored):
    paths, reports = stored
    assert spark.read.option("header", True).csv(f"{paths['trends']}/global").count() == 9
    assert reports["trends"]["rises"].count() == 3 and reports["trends"]["chart"].count() == 9


def test_audit_jobs(spark, stored):
    paths, _ = stored
    quality = jobs.check_quality(spark, paths["aspects"])
    assert quality["dates"].first().malformed_dates == 0
    assert {r.standing for r in quality["domain"].collect()} == {"ok", "missing"}
    assert all(report.count() >= 0 for report in quality.values())
    profile = jobs.profile_research(spark, paths["research"])
    assert {r.column_name: r.nulls for r in profile["missing"].collect()}["check_in_date"] == 300
    assert all(report.count() > 0 for report in profile.values())
    overview = jobs.audit_assets(spark, aspects=paths["aspects"], nothing=paths["model"] + "x")["overview"].collect()
    assert [(r.asset, r.found) for r in overview] == [("aspects", True), ("nothing", False)]


def test_token_and_feature_jobs(spark, stored):
    paths, _ = stored
    compared = jobs.compare_tokens(spark, paths["research"], paths["vocabulary"])
    assert compared["statistics"].count() == 3 and compared["preview"].count() == 10
    rows = jobs.build_features(spark, paths["research"], paths["vocabulary"], paths["features"], length=16)["rows"]
    assert rows.first().rows == 900


def test_classifier_jobs(spark, stored):
    paths, _ = stored
    table = f"{paths['splits']}/hotel"
    options = {"grid": (0.01,), "features": 256, "max_iter": 8}
    trained = jobs.train_classifier(spark, table, paths["vocabulary"], paths["model"], **options)
    metrics = {r.metric: r.value for r in trained["metrics"].collect()}
    assert metrics["macro_f1"] > 0.9 and "macro_f1_bath" in metrics
    cells = jobs.diagnose_classifier(spark, table, paths["vocabulary"], paths["model"])["confusion"].collect()
    assert sum(r.n for r in cells) == 90 and len(cells) == 9
    small = jobs.try_classifier(spark, table, paths["vocabulary"], paths["small"], **options)
    assert sum(r.n for r in small["confusion"].collect()) == 60


def test_page_job(spark, tmp_path):
    def page(ids, total):
        reviews = [{"id": i, "comment": f"感想{i}", "provider": {"name": "宿"}} for i in ids]
        return f'x"reviewList":{{"data":{{"total":{total},"contents":{json.dumps(reviews)}}}}}'

    stored, output = str(tmp_path / "pages"), str(tmp_path / "reviews")
    rows = [("h", 1, page([1, 2, 3], 7)), ("h", 2, page([3, 4], 7)), ("h", 3, "no reviews here")]
    spark.createDataFrame(rows, "hotel_id string, page_id int, html string").write.parquet(stored)
    for _ in range(2):
        reports = jobs.collect_pages(spark, stored, output)
    assert sorted(r.id for r in spark.read.parquet(output).collect()) == ["1", "2", "3", "4"]
    assert tuple(reports["remaining"].first()) == ("h", 4, 7, 3)
    assert [r.page_id for r in reports["unreadable"].collect()] == [3]


def test_line_job(spark, lines, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for _ in range(2):
        held = jobs.collect_lines(spark, lines, out, progress)["held"]
    assert {r.reviews for r in held.collect()} == {30} and held.count() == 10


def test_labelled_jobs(spark, tmp_path):
    tsv, out = tmp_path / "pn.tsv", str(tmp_path / "out")
    tsv.write_text("1\t1\t良い\tx\ttrain\n2\t0\t普通\tx\tdev\n3\t-1\t悪い\tx\ttest\n3\t-1\t悪い\tx\ttest\n4\t1\t　\tx\tspare\n", encoding="utf8")
    counts = {r.split: r.n for r in jobs.prepare_labelled(spark, str(tsv), out)["splits"].collect()}
    assert counts == {"train": 1, "dev": 1, "test": 2}
    back = spark.read.option("header", True).csv(f"{out}/split=test").collect()
    assert {(r.id, r.label, r.text) for r in back} == {("3", "0", "悪い")}
    profile = jobs.profile_labelled(spark, str(tsv))
    assert profile["repeated"].first().repeated_rows == 1 and profile["empty"].first().empty_texts == 1
    assert profile["shape"].first().n_rows == 5 and profile["values"].count() == 4 + 3 + 4 + 1 + 4


def test_command_line(spark, stored, capsys):
    paths, _ = stored
    main(["audit_assets", f"aspects={paths['aspects']}"])
    shown = capsys.readouterr().out
    assert "== overview" in shown and "aspects" in shown
