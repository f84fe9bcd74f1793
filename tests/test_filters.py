import pytest
from pyspark.sql import functions as F

from reviewminer.operators import filters as f
from reviewminer.schemas import PRODUCT


@pytest.fixture(scope="module")
def products(spark):
    def rel(also_bought=None, also_viewed=None, bought_together=None):
        return (also_bought, also_viewed, bought_together)

    rows = [
        ("a", 3.17, None, rel(["x"]), None, "Acme", [["All", "Dance"], ["Sport", "Ring"]]),
        ("b", None, None, rel(None, ["x"]), None, "Acme", [["All"], ["Ring", None]]),
        ("c", 70.0, None, rel(None, None, ["x", "y"]), None, None, None),
        ("x", 500.0, None, None, None, "acme", [["Laptops"]]),
        ("y", 1000.0, None, rel([]), None, "Other", [["Laptops", "Ring"]]),
        ("z", 49.99, None, None, None, "Other", [["Laptops"]]),
    ]
    return spark.createDataFrame(rows, PRODUCT)


def ids(df):
    return sorted(r.asin for r in df.select("asin").collect())


def test_brand_is_exact_and_drops_null(products):
    assert ids(products.transform(f.brand("Acme"))) == ["a", "b"]


def test_category_any_path_null_dropped(products):
    assert ids(products.transform(f.category("Ring"))) == ["a", "b", "y"]
    assert ids(products.transform(f.category("Nope"))) == []


def test_price_bounds_inclusive_and_missing_price(products):
    assert ids(products.transform(f.price(None, 70.0))) == ["a", "b", "c", "z"]
    assert "b" in ids(products.transform(f.price(0.0)))
    assert "b" not in ids(products.transform(f.price(1.0)))
    assert "b" not in ids(products.transform(f.price(None, 70.0, missing_price="drop")))
    assert ids(products.transform(f.price(70.0, 1000.0))) == ["c", "x", "y"]
    with pytest.raises(ValueError):
        f.price(missing_price="other")


def test_float_price_is_widened(products):
    assert "a" not in ids(products.transform(f.price(1.0, 3.17)))
    assert "a" in ids(products.transform(f.price(1.0, 3.18)))


def test_similar_product(products):
    # x itself has no relation list and is dropped; also_viewed does not count
    assert ids(products.transform(f.similar_to("x"))) == ["a", "c"]
    assert ids(products.transform(f.similar_to("y"))) == ["c", "y"]


def test_chain_preset_and_custom(products):
    assert ids(products.transform(f.preset())) == ["x", "y"]
    assert ids(products.transform(f.chain(f.accept_all(), f.category("Ring"), f.brand("Acme")))) == ["a", "b"]
    assert ids(products.transform(f.where(F.col("asin") > "x"))) == ["y", "z"]


def test_samples(spark):
    many = spark.range(2000).select(F.col("id").cast("string").alias("asin"))
    picked = ids(many.transform(f.sample_by_hash(0.25, 3)))
    assert picked == ids(many.repartition(7).transform(f.sample_by_hash(0.25, 3)))
    assert picked != ids(many.transform(f.sample_by_hash(0.25, 4)))
    assert 400 < len(picked) < 600
    assert 400 < many.transform(f.sample(0.25, 3)).count() < 600
    assert many.transform(f.sample_by_hash(1.0, 3)).count() == 2000
    assert many.transform(f.sample_by_hash(0.0, 3)).count() == 0


def test_reviews_of_products_broadcast_and_salted(spark):
    reviews = spark.range(300).select(
        F.col("id").cast("string").alias("review_id"),
        F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("asin"),
    )
    chosen = spark.createDataFrame([("hot",), ("250",), ("250",), (None,), ("none",)], "asin string")
    assert f.reviews_of_products(reviews, None).count() == 300
    assert f.reviews_of_products(reviews, chosen.limit(0)).count() == 0
    assert f.reviews_of_products(reviews, chosen).count() == 201
    salted = f.reviews_of_products(reviews, chosen, broadcast_limit=1, salts=4)
    assert salted.count() == 201 and salted.columns == ["asin", "review_id"]
