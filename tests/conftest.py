import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from reviewminer.session import local_session

    session = local_session("*", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def reviews_of(spark):
    """Build reviews(review_id, asin, reviewText, overall) from texts or (text, rating)."""

    def make(rows):
        full = [(r, 3.0) if isinstance(r, str) or r is None else r for r in rows]
        data = [(str(i), str(i % 3), text, float(y)) for i, (text, y) in enumerate(full)]
        return spark.createDataFrame(data, "review_id string, asin string, reviewText string, overall double")

    return make
