"""Product filters (DataFrame -> DataFrame) and the review semi-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Filter = Callable[[DataFrame], DataFrame]

# The preset product filter.
PRESET_CATEGORY = "Laptops"
PRESET_PRICES = (50.0, 1000.0)

BROADCAST_IDS = 2_000_000
ID_SALTS = 64


def where(predicate: Column | Callable[[], Column]) -> Filter:
    """Filter from a boolean column, or from a function that makes one.

    The way to add filters of one's own; a function needs no session yet.
    """
    return lambda products: products.where(predicate() if callable(predicate) else predicate)


def accept_all() -> Filter:
    return lambda products: products


def brand(name: str) -> Filter:
    return where(lambda: F.col("brand") == F.lit(name))


def category(name: str) -> Filter:
    """Any element of any category path equals ``name``."""

    def in_path(path: Column) -> Column:
        return F.coalesce(F.array_contains(path, name), F.lit(False))

    return where(lambda: F.exists("categories", in_path))


def price(low: float | None = None, high: float | None = None, missing_price: str = "zero") -> Filter:
    """Inclusive bounds, None = open. Compared as double, as a widened float.

    An absent price counts as 0.0 or, with ``missing_price="drop"``, never passes.
    """
    if missing_price not in ("zero", "drop"):
        raise ValueError("missing_price is 'zero' or 'drop'")

    def in_range() -> Column:
        value = F.col("price").cast("double")
        if missing_price == "zero":
            value = F.coalesce(value, F.lit(0.0))
        predicate = value.isNotNull()
        if low is not None:
            predicate = predicate & (value >= F.lit(float(low)))
        if high is not None:
            predicate = predicate & (value <= F.lit(float(high)))
        return predicate

    return where(in_range)


def sample(fraction: float, seed: int) -> Filter:
    """Sample without replacement; depends on the partitioning of the input."""
    return lambda products: products.sample(False, fraction, seed)


def sample_by_hash(fraction: float, seed: int, key: str = "asin") -> Filter:
    """Sample by key hash: the same rows whatever the partitioning."""

    def in_sample() -> Column:
        digest = F.md5(F.concat(F.col(key), F.lit(f":{seed}")))
        bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        return bucket < F.lit(int(fraction * 2**32))

    return where(in_sample)


def similar_to(asin: str) -> Filter:
    """Products bought with ``asin``, and itself, among those with a relation list."""

    def listed(kind: str) -> Column:
        return F.coalesce(F.array_contains(F.col(f"related.{kind}"), asin), F.lit(False))

    def related() -> Column:
        itself = F.coalesce(F.col("asin") == F.lit(asin), F.lit(False))
        return F.col("related").isNotNull() & (itself | listed("also_bought") | listed("bought_together"))

    return where(related)


def chain(*filters: Filter) -> Filter:
    def apply(products: DataFrame) -> DataFrame:
        for one in filters:
            products = products.transform(one)
        return products

    return apply


def preset() -> Filter:
    return chain(category(PRESET_CATEGORY), price(*PRESET_PRICES))


def product_ids(products: DataFrame) -> DataFrame:
    return products.select("asin")


def _distinct_ids(ids: DataFrame) -> DataFrame:
    return ids.select("asin").where(F.col("asin").isNotNull()).distinct()


def fits_broadcast(ids: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    """Count the id list, but never further than ``limit``."""
    return _distinct_ids(ids).limit(limit + 1).count() <= limit


def reviews_of_products(
    rows: DataFrame, ids: DataFrame | None, broadcast_limit: int = BROADCAST_IDS, salts: int = ID_SALTS
) -> DataFrame:
    """Rows (reviews or n-grams) whose product is listed; None keeps all, an
    empty list none.

    A short id list is broadcast; beyond ``broadcast_limit`` both sides are
    salted, so a product that owns a third of all reviews is spread out.
    """
    if ids is None:
        return rows
    if fits_broadcast(ids, broadcast_limit):
        return rows.join(F.broadcast(_distinct_ids(ids)), "asin", "left_semi")
    salt = F.pmod(F.xxhash64("review_id"), F.lit(salts)).cast("int")
    copies = _distinct_ids(ids).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", salt).join(copies, ["asin", "salt"], "left_semi").drop("salt")
