import json

import pytest
from pyspark.sql import functions as F

from reviewminer.schemas import PRODUCT, REVIEW
from reviewminer.sources import json_lines as j
from reviewminer.sources import reports, stopwords, tables

REVIEW_LINE = {
    "reviewerID": "R1", "asin": "0001", "reviewerName": "J. Doe", "helpful": [2, 3], "reviewText": "Fine.",
    "overall": 5.0, "summary": "Hymns", "unixReviewTime": 1252800000, "reviewTime": "09 13, 2009",
}


def write(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_files_of_any_name_are_read(spark, tmp_path):
    import gzip

    for name in ("a.json", "b.jsonl", "noext"):
        write(tmp_path, name, json.dumps(REVIEW_LINE))
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(json.dumps(REVIEW_LINE).encode()))
    assert j.read_reviews(spark, str(tmp_path)).count() == 4
    for name in ("b.jsonl", "noext", "c.json.gz"):
        assert j.read_reviews(spark, str(tmp_path / name)).count() == 1


def test_reviews_defaults_and_quarantine(spark, tmp_path):
    write(tmp_path, "a.json", json.dumps(REVIEW_LINE), '{"asin": "0002", "reviewText": null}')
    write(tmp_path, "b.json", "{broken", "{asin: '0003', reviewText: 'größer'}")
    write(tmp_path, "c.txt", json.dumps(REVIEW_LINE))
    df = j.read_reviews(spark, str(tmp_path), glob="*.json")
    good = {r.asin: r for r in j.good_records(df).collect()}
    assert sorted(good) == ["0001", "0002", "0003"]
    assert good["0001"].helpful == [2, 3] and good["0001"].overall == 5.0
    assert good["0002"].overall == 0.0 and good["0002"].unixReviewTime == 0 and good["0002"].reviewText is None
    assert good["0003"].reviewText == "größer"
    assert good["0001"].source_file.endswith("a.json")
    bad = j.quarantined(df).collect()
    assert len(bad) == 1 and bad[0][j.CORRUPT] == "{broken" and bad[0].source_file.endswith("b.json")


def test_fail_fast(spark, tmp_path):
    write(tmp_path, "a.json", "{broken")
    for reader in (j.read_reviews, j.read_products):
        with pytest.raises(Exception, match="(?i)malformed"):
            reader(spark, str(tmp_path), on_error="fail").collect()
    with pytest.raises(ValueError):
        j.read_reviews(spark, str(tmp_path), on_error="ignore")


def test_products_both_rank_spellings(spark, tmp_path):
    write(
        tmp_path, "p.json",
        json.dumps({"asin": "1", "title": "unknown key", "price": 3.17, "SalesRank": {"Toys & Games": 211836},
                    "related": {"also_bought": ["2"], "bought_together": ["3"]}, "categories": [["Sport", "Dance"]]}),
        json.dumps({"asin": "2", "salesRank": {"Music": 5}}),
        "{'asin': '3'}", "nonsense",
    )
    rows = {r.asin: r for r in j.good_records(j.read_products(spark, str(tmp_path))).collect()}
    assert rows["1"].salesRank == {"Toys & Games": 211836} and rows["2"].salesRank == {"Music": 5}
    assert rows["1"].related.also_bought == ["2"] and rows["1"].related.also_viewed is None
    assert rows["3"].price == 0.0 and rows["3"].salesRank is None and rows["3"].related is None
    assert j.quarantined(j.read_products(spark, str(tmp_path))).count() == 1


def test_json_columns_leave_nulls_out(spark):
    df = spark.createDataFrame([("1", 2.5, None, None, None, "B", None)], PRODUCT)
    text = j.to_json_column(df).first().value
    assert json.loads(text) == {"asin": "1", "price": 2.5, "brand": "B"}
    back = j.from_json_column(j.to_json_column(df), PRODUCT).first()
    assert back.brand == "B" and back.price == 2.5
    empty = j.from_json_column(spark.createDataFrame([("{}",)], "value string"), REVIEW).first()
    assert empty.overall == 0.0 and empty.asin is None


def test_write_json_is_the_filtered_frame(spark, tmp_path):
    df = spark.createDataFrame([("1", 1), ("2", 2)], "asin string, n int").where("n > 1")
    j.write_json(df, str(tmp_path / "out"))
    assert [r.asin for r in spark.read.json(str(tmp_path / "out")).collect()] == ["2"]


def test_stopword_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("the\nours\tourselves\ncan't\n.\n")
    assert set(stopwords.read_stopwords(spark, str(tmp_path / "stop.txt"))) == {"the", "ours", "ourselves", "ca", "n't", "."}


def test_every_part_of_a_hot_order_is_found(spark):
    rows = [(1, k) for k in range(500)] * 2 + [(2, 9), (2, 900), (3, 7), (4, 901), (4, 902), (5, 903), (5, 903), (6, None)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long")

    def found(asin):
        rows = [r.asin for r in tables.bought_with(lines, asin).collect()]
        assert len(rows) == len(set(rows))
        return {int(r) for r in rows}

    assert found("9") == {*range(500), 900}
    assert found("900") == {9, 900} and found("901") == {901, 902}
    assert found("903") == set() and found("77777") == set()


def test_report_lines(spark, tmp_path):
    top = spark.createDataFrame([("s", 1, "far better s", "s", 3)], "cluster_id string, rank int, representative string, feature string, n_reviews long")
    members = spark.createDataFrame(
        [("s", "far", "better", "s", 2), ("s", "", "worse", "s", 1), ("t", "a", "b", "t", 1)],
        "cluster_id string, w2 string, modifier string, feature string, cnt long",
    )
    lines = reports.cluster_report(top, members)
    reports.write_lines(lines, str(tmp_path / "report"), "rank", "line", "text")
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert sorted(text) == ["far better s: 3 | Feature: s", "far, better, s", "worse, s"]
    weights = spark.createDataFrame([("better", "s", 0.5)], "modifier string, feature string, coef double")
    assert reports.modifier_report(weights).first().text == "(better,s): 0.5"
