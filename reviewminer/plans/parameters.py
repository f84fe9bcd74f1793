"""Parameters shared by the registered queries and their SQL."""

BRAND = "Brand#2"
CATEGORY = "ring"
PRICES = (905.0, 915.0)
CHAIN_PRICES = (903.0, 950.0)
SAMPLE_FRACTION = 0.1
SAMPLE_SEED = 7
SIMILAR_ASIN = "25"
VECTOR_THRESHOLD = 0.3
TOP_TERMS = 3
SYNONYMS = 10
