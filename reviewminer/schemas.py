"""Explicit record schemas; unknown JSON keys are dropped by construction."""

from __future__ import annotations

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

REVIEW = T.StructType(
    [
        T.StructField("reviewerID", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("reviewerName", T.StringType()),
        T.StructField("helpful", T.ArrayType(T.IntegerType())),
        T.StructField("reviewText", T.StringType()),
        T.StructField("overall", T.FloatType()),
        T.StructField("summary", T.StringType()),
        T.StructField("unixReviewTime", T.IntegerType()),
        T.StructField("reviewTime", T.StringType()),
    ]
)

RELATED = T.StructType(
    [
        T.StructField("also_bought", _strings),
        T.StructField("also_viewed", _strings),
        T.StructField("bought_together", _strings),
    ]
)

PRODUCT = T.StructType(
    [
        T.StructField("asin", T.StringType()),
        T.StructField("price", T.FloatType()),
        T.StructField("imUrl", T.StringType()),
        T.StructField("related", RELATED),
        T.StructField("salesRank", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("brand", T.StringType()),
        T.StructField("categories", T.ArrayType(_strings)),
    ]
)

# Numeric fields that read as zero when the key is absent.
ZERO_DEFAULTS = {"overall": 0.0, "unixReviewTime": 0, "price": 0.0}
CORRUPT = "_corrupt_record"
