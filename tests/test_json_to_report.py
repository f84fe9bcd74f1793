"""From JSON files to report files, as a user would run it."""

import json

from pyspark.sql import functions as F

from reviewminer.operators import filters
from reviewminer.operators.templates import Template
from reviewminer.plans.pipeline import mine
from reviewminer.sources import json_lines, reports


def test_json_to_reports(spark, tmp_path):
    texts = [
        ("L1", "Honestly a much better display", 5.0), ("L1", "Finally a far better display!", 5.0),
        ("L2", "Sadly much worse battery life", 1.0), ("L2", "Just far worse battery, sorry", 2.0),
        ("L2", "Again this has really much worse battery.", 1.0), ("OTHER", "Some much better guitar", 5.0),
        ("L1", "I'm fine", 4.0), ("L1", None, 3.0),
    ]
    (tmp_path / "reviews").mkdir()
    for part in (0, 1):
        lines = [
            json.dumps({"reviewerID": f"R{i}", "asin": a, "reviewText": t, "overall": y, "unixReviewTime": i})
            for i, (a, t, y) in enumerate(texts) if i % 2 == part
        ]
        (tmp_path / "reviews" / f"part{part}.json").write_text("\n".join([*lines, "{cut off"]))
    products = [
        {"asin": "L1", "price": 700.0, "categories": [["Electronics", "Laptops"]]},
        {"asin": "L2", "price": 50.0, "categories": [["Laptops"]]},
        {"asin": "OTHER", "price": 60.0, "categories": [["Music"]]},
    ]
    (tmp_path / "products.json").write_text("\n".join(map(json.dumps, products)))

    raw = json_lines.read_reviews(spark, str(tmp_path / "reviews"))
    assert json_lines.quarantined(raw).count() == 2
    assert json_lines.good_records(raw).select("review_id").distinct().count() == len(texts)
    found = mine(
        json_lines.good_records(raw),
        products=json_lines.good_records(json_lines.read_products(spark, str(tmp_path / "products.json"))),
        product_filter=filters.preset(),
    )
    top = {r.feature: (r["rank"], r.n_reviews, r.n_ngrams) for r in found.top.collect()}
    assert top == {"battery": (1, 3, 2), "display": (2, 2, 2)}
    weights = {(r.modifier, r.feature): r.coef for r in found.weights.collect()}
    assert weights[("better", "display")] > 0 > weights[("worse", "battery")]

    reports.write_lines(reports.cluster_report(found.top, found.members()), str(tmp_path / "clusters"), "rank", "line", "text")
    lines = [r.value for r in spark.read.text(str(tmp_path / "clusters")).collect()]
    assert sorted(lines) == sorted([
        "much worse battery: 3 | Feature: battery", "far, worse, battery", "much, worse, battery",
        "far better display: 2 | Feature: display", "far, better, display", "much, better, display",
    ])
    positive = reports.modifier_report(found.most_positive()).orderBy(F.desc("coef")).first().text
    assert positive.startswith("(better,display): ")
    json_lines.write_json(found.clusters, str(tmp_path / "clusters.json"))
    assert spark.read.json(str(tmp_path / "clusters.json")).count() == 2
    found.close()


def test_window_of_two_has_no_context(spark):
    reviews = spark.createDataFrame([("1", "x y better sound", 5.0)], "review_id string, reviewText string, overall double")
    found = mine(reviews, template=Template(k=2))
    assert found.clusters.first().representative == "better sound"
    lines = [r.text for r in reports.cluster_report(found.top, found.members()).orderBy("line").collect()]
    assert lines == ["better sound: 1 | Feature: sound", "better, sound"]
