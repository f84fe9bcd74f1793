"""JSON-lines sources and sinks for reviews and product metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CORRUPT, PRODUCT, REVIEW, ZERO_DEFAULTS

FILE = "source_file"
LENIENT = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
Paths = str | Sequence[str]


def _records(spark: SparkSession, path: Paths, schema: T.StructType, on_error: str, glob: str | None = None) -> DataFrame:
    """(value, source_file, fields..., [_corrupt_record]) of the lines.

    Every line is parsed once and whole: the generator keeps later filters from
    duplicating the parser, and whether a line is corrupt does not depend on
    the columns a query happens to use.
    """
    if on_error not in ("quarantine", "fail"):
        raise ValueError("on_error is 'quarantine' or 'fail'")
    options = dict(LENIENT)
    if on_error == "fail":
        options["mode"] = "FAILFAST"
    else:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options["columnNameOfCorruptRecord"] = CORRUPT
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    lines = reader.text(path).where(F.trim("value") != "")
    record = F.from_json("value", schema, options)
    return lines.select("value", F.col("_metadata.file_path").alias(FILE), F.inline(F.array(record)))


def _zero_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    defaults = {
        f.name: F.coalesce(f.name, F.lit(ZERO_DEFAULTS[f.name]).cast(f.dataType))
        for f in schema.fields
        if f.name in ZERO_DEFAULTS
    }
    return df.withColumns(defaults)


def read_reviews(spark: SparkSession, path: Paths, on_error: str = "quarantine", glob: str | None = None) -> DataFrame:
    """Reviews of a file, a folder or several of them, plain or compressed.

    ``glob`` limits a read to file names, such as ``*.json``; all are read without it.
    ``source_file`` tells the files apart, so per-file work is a grouping.
    ``review_id`` joins reviewer, product and time, an absent one as ``-``, and a
    digest of the text, so that unlike records have unlike ids.
    """
    df = _zero_defaults(_records(spark, path, REVIEW, on_error, glob).drop("value"), REVIEW)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("reviewerID", "asin", "unixReviewTime")]
    digest = F.substring(F.md5(F.to_json(F.struct("reviewText", "summary", "overall")).cast("binary")), 1, 16)
    return df.withColumn("review_id", F.concat_ws(":", *parts, digest))


def read_products(spark: SparkSession, path: Paths, on_error: str = "quarantine", glob: str | None = None) -> DataFrame:
    """Product metadata; the sales rank is accepted in both of its spellings.

    Column names do not tell cases apart, keys do: the second spelling is taken
    from the line by itself, and only when a query asks for the rank.
    """
    other = T.StructType([T.StructField("SalesRank", PRODUCT["salesRank"].dataType)])
    second = F.from_json("value", other, LENIENT).getField("SalesRank")
    records = _records(spark, path, PRODUCT, on_error, glob)
    ranked = records.withColumn("salesRank", F.coalesce("salesRank", second)).drop("value")
    return _zero_defaults(ranked, PRODUCT)


def good_records(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined(df: DataFrame) -> DataFrame:
    """Lines that did not parse, with the file they came from."""
    return df.where(F.col(CORRUPT).isNotNull()).select(FILE, CORRUPT)


def to_json_column(df: DataFrame) -> DataFrame:
    """One JSON string per row; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def from_json_column(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Parse ``value`` strings against a fixed schema."""
    parsed = df.select(F.from_json("value", schema).alias("record")).select("record.*")
    return _zero_defaults(parsed, schema)


def write_json(df: DataFrame, path: str) -> None:
    """Save exactly the rows of ``df`` as JSON lines."""
    df.write.mode("errorifexists").json(path)
