"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from ..functions.tagging import ADJECTIVE_TAGS, DEFAULT_TAGGER, NOUN_TAGS, UNKNOWN_TAG
from ..functions.text import TOKEN_PATTERN
from ..functions.wordlists import STOPWORDS
from ..operators.bow import MIN_COUNT
from ..operators.clusters import TOP
from ..operators.cooccurrence import CONTEXTS, WINDOW
from ..operators.filters import PRESET_PRICES
from ..operators.synonyms import DIGITS
from ..operators.templates import COMPOUND_NOUN
from ..operators.weights import MIN_WINDOWS, REG_PARAM
from .parameters import (
    BRAND, CATEGORY, CHAIN_PRICES, PRICES, SAMPLE_FRACTION, SAMPLE_SEED, SIMILAR_ASIN, SYNONYMS, TOP_TERMS, VECTOR_THRESHOLD,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(quoted(w) for w in words)


def tag_sql(word: str) -> str:
    """Lexicon, plural of a lexicon noun, then suffixes, rule by rule."""
    grouped = DEFAULT_TAGGER.words_by_tag()
    rules = [f"WHEN {word} IN ({listed(words)}) THEN {quoted(tag)}" for tag, words in grouped.items()]
    rules.append(
        f"WHEN suffix({word}, 's') AND left({word}, length({word}) - 1) IN ({listed(grouped['NN'])}) THEN 'NNS'"
    )
    rules += [f"WHEN suffix({word}, {quoted(s)}) THEN {quoted(t)}" for s, t in DEFAULT_TAGGER.suffix_rules()]
    return f"CASE {' '.join(rules)} ELSE {quoted(UNKNOWN_TAG)} END"


ADJ, NOUN = listed(ADJECTIVE_TAGS), listed(NOUN_TAGS)

# Products -------------------------------------------------------------------

PRODUCTS = """products AS (
  SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS asin, CAST(p_retailprice AS FLOAT) AS price, p_brand AS brand,
         [['All', p_type], string_split(p_name, ' ')] AS categories
  FROM part)"""
IN_CATEGORY = f"list_contains(flatten(categories), {quoted(CATEGORY)})"
LISTED = "SELECT asin, CAST(price AS DOUBLE) AS price, brand FROM products"

PARTNERS = f"""partners AS (
  SELECT DISTINCT b.l_partkey AS part
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey
  WHERE a.l_partkey = {SIMILAR_ASIN})"""

# Words ----------------------------------------------------------------------

REVIEWS = """reviews AS (
  SELECT CAST(doc_id AS VARCHAR) AS review_id, CAST(doc_id % 200 AS VARCHAR) AS asin, text AS reviewText
  FROM documents WHERE text IS NOT NULL)"""
_PREPARED = r"regexp_replace(replace(lower(reviewText), 'n''t', ' n''t'), '\bcannot\b', 'can not', 'g')"
TOKENS = f"""{REVIEWS},
lists AS (SELECT review_id, regexp_extract_all({_PREPARED}, {quoted(TOKEN_PATTERN)}) AS toks FROM reviews),
every_token AS (SELECT review_id, unnest(range(len(toks))) AS pos, unnest(toks) AS word FROM lists),
tokens AS (SELECT * FROM every_token WHERE word NOT IN ({listed(STOPWORDS)}))"""
TAGGED = f"""{TOKENS},
tagged AS (
  SELECT review_id, pos, row_number() OVER (PARTITION BY review_id ORDER BY pos) - 1 AS i, word, {tag_sql('word')} AS tag
  FROM tokens)"""
COUNTS = f"{TOKENS}, counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word)"
TERMS = f"{TOKENS}, terms AS (SELECT review_id, word AS term, count(*) AS tf FROM tokens GROUP BY review_id, word)"
SCORES = f"""{TERMS},
freq AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM reviews),
scores AS (
  SELECT review_id, t.term, tf, tf / greatest(df / n, 1.0::DOUBLE / n) AS tfidf
  FROM terms t JOIN freq f ON t.term = f.term, total)"""

# N-grams --------------------------------------------------------------------

MATCHES = f"""{TAGGED},
placed AS (
  SELECT review_id, i, lag(word, 2) OVER w AS w2, lag(word, 1) OVER w AS modifier, word,
         lead(word, 1) OVER w AS next_word, lag(tag, 1) OVER w AS modifier_tag, tag AS feature_tag,
         lead(tag, 1) OVER w AS next_tag
  FROM tagged WINDOW w AS (PARTITION BY review_id ORDER BY i)),
matched AS (
  SELECT * FROM placed WHERE i >= {COMPOUND_NOUN.k} AND modifier_tag IN ({ADJ}) AND feature_tag IN ({NOUN}))"""
_NGRAM = "review_id, CAST(i AS BIGINT) AS i, w2, modifier, {feature} AS feature, modifier_tag, feature_tag"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY i) = 1"
NGRAMS = f"""{MATCHES},
ngrams AS (SELECT {_NGRAM.format(feature='word')} FROM matched {_FIRST})"""
STATS = f"""{NGRAMS},
rated AS (
  SELECT w2, modifier, feature, CAST(CASE quality WHEN 1 THEN 5 WHEN 0 THEN 1 ELSE 3 END AS DOUBLE) AS y
  FROM ngrams LEFT JOIN labels ON review_id = CAST(doc_id AS VARCHAR)),
stats AS (
  SELECT w2, modifier, feature, count(*) AS cnt, sum(y) AS sum_y, sum(y * y) AS sum_yy
  FROM rated GROUP BY w2, modifier, feature)"""

# Clusters --------------------------------------------------------------------

_BEST = "arg_min(w2 || ' ' || modifier || ' ' || feature, {'a': -cnt, 'b': w2, 'c': modifier, 'd': feature})"
EXACT = f"""{STATS},
clusters AS (
  SELECT feature AS cluster_id, feature, {_BEST} AS representative, CAST(sum(cnt) AS BIGINT) AS n_reviews,
         count(*) AS n_ngrams, CAST(1 AS BIGINT) AS n_features
  FROM stats GROUP BY feature)"""
TOP_CLUSTERS = f"""{EXACT},
top AS (
  SELECT *, row_number() OVER (ORDER BY n_reviews DESC, feature) AS rank FROM clusters
  ORDER BY n_reviews DESC, feature LIMIT {TOP})"""
HISTOGRAM = f"""{TOP_CLUSTERS},
hist AS (
  SELECT feature, modifier, count(*) AS n_windows, CAST(sum(cnt) AS BIGINT) AS n_reviews
  FROM stats GROUP BY feature, modifier)"""


def weights(min_windows: int, scope: str = "any_feature") -> str:
    key = "modifier" if scope == "any_feature" else "feature, modifier"
    return f"""{HISTOGRAM},
per_modifier AS (SELECT {key}, sum(cnt) AS n_j, sum(sum_y) AS s_j FROM stats GROUP BY {key}),
whole AS (SELECT sum(cnt) AS n, sum(sum_y) / sum(cnt) AS mean, sum(sum_yy) / sum(cnt) AS square FROM stats),
inputs AS (
  SELECT rank, h.feature, h.modifier, h.n_windows, h.n_reviews, n_j / n AS p, s_j / n_j - mean AS d,
         sqrt(greatest(square - mean * mean, 0)) AS sigma
  FROM hist h JOIN top USING (feature) JOIN per_modifier m
       ON h.modifier = m.modifier {'' if scope == 'any_feature' else 'AND h.feature = m.feature'}, whole
  WHERE h.n_windows >= {min_windows}),
shrunk AS (
  SELECT *, CASE WHEN sigma > 1e-12 AND p < 1 THEN 1 / (1 + {REG_PARAM}::DOUBLE / sigma * (1 - p)) ELSE 0 END AS u
  FROM inputs),
sums AS (SELECT feature, sum(p * u * d) AS s, sum(p * u) AS q FROM shrunk GROUP BY feature),
weights AS (
  SELECT rank, x.feature, modifier, n_windows, n_reviews,
         round(CASE WHEN u = 0 THEN 0 ELSE u * (d + CASE WHEN q < 1 THEN s / (1 - q) ELSE 0 END) END, 8) + 0.0::DOUBLE AS coef
  FROM shrunk x JOIN sums USING (feature))"""


_WEIGHTS = "SELECT feature, modifier, n_windows, n_reviews, coef FROM weights"


def _top_modifiers(order: str) -> str:
    return f"WITH {weights(1)} {_WEIGHTS} ORDER BY coef {order}, feature, modifier LIMIT {TOP}"


# Vectors ----------------------------------------------------------------------

VECTORS = """vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
KEPT = f"{VECTORS}, kept AS (SELECT min(id) AS id, v FROM vectors GROUP BY v)"
PAIRS = f"""{KEPT}, pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS cosine FROM kept a JOIN kept b ON a.id < b.id
  WHERE list_cosine_similarity(a.v, b.v) > {VECTOR_THRESHOLD})"""


def keyed_items(key: str) -> str:
    """Distinct keys with their counts and vectors, and the similar pairs."""
    return f"""{EXACT}, {VECTORS},
keys AS (SELECT {key} AS key, CAST(sum(cnt) AS BIGINT) AS n FROM stats GROUP BY {key}),
items AS (
  SELECT key, n, v FROM keys JOIN vectors
  ON id = CAST('0x' || left(md5(key), 8) AS BIGINT) % (SELECT count(*) FROM embeddings)),
near AS (
  SELECT a.key AS f, b.key AS g FROM items a JOIN items b
  ON a.key <> b.key AND list_cosine_similarity(a.v, b.v) > {VECTOR_THRESHOLD})"""


def merged(key: str) -> str:
    """Cluster rows from assignment(key, cluster_id)."""
    return f"""
SELECT cluster_id, arg_min(feature, {{'a': -n, 'b': feature}}) AS feature, arg_min(best.t, best.o) AS representative,
       CAST(sum(n) AS BIGINT) AS n_reviews, CAST(sum(m) AS BIGINT) AS n_ngrams, count(*) AS n_features
FROM (
  SELECT cluster_id, feature, sum(cnt) AS n, count(*) AS m,
         min({{'o': {{'a': -cnt, 'b': w2, 'c': modifier, 'd': feature}}, 't': w2 || ' ' || modifier || ' ' || feature}}) AS best
  FROM stats JOIN assignment ON {key} = key GROUP BY cluster_id, feature) GROUP BY cluster_id"""


def allpairs(key: str) -> str:
    return f"""WITH RECURSIVE {keyed_items(key)},
        reach AS (SELECT key AS f, key AS root FROM items
                  UNION SELECT n.g, r.root FROM reach r JOIN near n ON r.f = n.f),
        assignment AS (SELECT f AS key, min(root) AS cluster_id FROM reach GROUP BY f) {merged(key)}"""


ORACLES: dict[str, str] = {
    "filter_brand": f"WITH {PRODUCTS} {LISTED} WHERE brand = {quoted(BRAND)}",
    "filter_category": f"WITH {PRODUCTS} {LISTED} WHERE {IN_CATEGORY}",
    "filter_price": f"WITH {PRODUCTS} {LISTED} WHERE CAST(price AS DOUBLE) BETWEEN {PRICES[0]} AND {PRICES[1]}",
    "filter_similar": f"""WITH {PRODUCTS}, {PARTNERS} {LISTED}
        WHERE p_partkey IN (SELECT part FROM partners)
           OR (asin = {quoted(SIMILAR_ASIN)} AND EXISTS (SELECT 1 FROM partners))""",
    "filter_chain": f"""WITH {PRODUCTS} {LISTED} WHERE {IN_CATEGORY}
        AND CAST(price AS DOUBLE) BETWEEN {CHAIN_PRICES[0]} AND {CHAIN_PRICES[1]}""",
    "filter_sample_hash": f"""WITH {PRODUCTS} {LISTED}
        WHERE CAST('0x' || left(md5(asin || ':{SAMPLE_SEED}'), 8) AS BIGINT) < {int(SAMPLE_FRACTION * 2**32)}""",
    "product_json_roundtrip": f"""WITH {PRODUCTS} SELECT asin, CAST(price AS DOUBLE) AS price, brand,
        array_to_string(flatten(categories), '/') AS path FROM products WHERE {IN_CATEGORY}""",
    "review_json_columns": f"""WITH {REVIEWS} SELECT review_id, asin, CAST(length(reviewText) AS BIGINT) AS n_chars,
        0.0::DOUBLE AS overall, TRUE AS no_summary FROM reviews""",
    "reviews_of_products": f"""WITH {PRODUCTS}, {REVIEWS} SELECT review_id, asin FROM reviews
        WHERE asin IN (SELECT asin FROM products WHERE {IN_CATEGORY})""",
    "tokens_clean": f"WITH {TOKENS} SELECT review_id, pos, word FROM tokens",
    "tagged_words": f"WITH {TAGGED} SELECT review_id, pos, i, word, tag FROM tagged",
    "whitespace_tokens": f"""WITH {REVIEWS} SELECT word, count(*) AS n FROM (
        SELECT unnest(string_split(rtrim(lower(reviewText), ' '), ' ')) AS word FROM reviews
        WHERE trim(reviewText, ' ') <> '' OR reviewText = '') GROUP BY word""",
    "word_counts": f"WITH {COUNTS} SELECT word, n FROM counts",
    "vocabulary": f"""WITH {COUNTS} SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS pos
        FROM counts WHERE n >= {MIN_COUNT}""",
    "vocabulary_size": f"""WITH {COUNTS} SELECT count(*) AS n_terms, count(*) FILTER (n >= {MIN_COUNT}) AS n_kept
        FROM counts""",
    "review_terms": f"WITH {TERMS} SELECT review_id, term, tf FROM terms",
    "tfidf": f"WITH {SCORES} SELECT review_id, term, tf, tfidf FROM scores",
    "tfidf_top_terms": f"""WITH {SCORES} SELECT review_id, row_number() OVER w AS rank, term, tf, tfidf FROM scores
        WINDOW w AS (PARTITION BY review_id ORDER BY tfidf DESC, term) QUALIFY rank <= {TOP_TERMS}""",
    "ngrams_adj_noun": f"WITH {NGRAMS} SELECT * FROM ngrams",
    "ngrams_adj_noun_all": f"WITH {MATCHES} SELECT {_NGRAM.format(feature='word')} FROM matched",
    "ngrams_compound_noun": f"""WITH {MATCHES} SELECT {_NGRAM.format(
        feature=f"CASE WHEN next_tag IN ({NOUN}) THEN word || ' ' || next_word ELSE word END")} FROM matched {_FIRST}""",
    "ngrams_windowed": f"WITH {NGRAMS} SELECT * FROM ngrams",
    "template_accepts": f"""WITH {NGRAMS} SELECT r.review_id, n.review_id IS NOT NULL AS accepted
        FROM reviews r LEFT JOIN ngrams n ON r.review_id = n.review_id""",
    "ngram_counts": f"WITH {NGRAMS} SELECT w2, modifier, feature, count(*) AS cnt FROM ngrams GROUP BY ALL",
    "filter_preset": f"WITH {PRODUCTS} {LISTED} WHERE {IN_CATEGORY} AND price BETWEEN {PRESET_PRICES[0]} AND {PRESET_PRICES[1]}",
    "reviews_json": """SELECT CAST(d.doc_id AS VARCHAR) || ':' || CAST(d.doc_id % 200 AS VARCHAR) || ':0' AS review_id, length(text) AS n_chars,
        CASE WHEN l.doc_id IS NULL THEN 0.0 WHEN quality = 1 THEN 5.0 WHEN quality = 0 THEN 1.0 ELSE 3.0 END::DOUBLE AS overall, true AS no_name
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "clusters_no_singletons": f"WITH {EXACT} SELECT * FROM clusters WHERE n_ngrams > 1",
    "feature_vectors": f"""WITH {MATCHES}, found AS (SELECT {_NGRAM.format(
        feature=f"CASE WHEN next_tag IN ({NOUN}) THEN word || ' ' || next_word ELSE word END")} FROM matched {_FIRST}), {VECTORS},
        words AS (SELECT feature, unnest(string_split(feature, ' ')) AS word FROM (SELECT DISTINCT feature FROM found)),
        parts AS (SELECT feature, unnest(range(len(v))) AS k, unnest(v) AS x FROM words JOIN vectors
          ON id = CAST('0x' || left(md5(word), 8) AS BIGINT) % (SELECT count(*) FROM embeddings))
        SELECT feature, CAST(k AS BIGINT) AS k, round(avg(x), 6) AS value FROM parts GROUP BY feature, k""",
    "vector_synonyms": f"""WITH {VECTORS},
        usable AS (SELECT id, v FROM vectors WHERE list_sum(list_transform(v, lambda x: x * x)) > 0),
        scored AS (
          SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), {DIGITS}) AS cosine FROM usable a JOIN usable b ON a.id <> b.id)
        SELECT id, row_number() OVER w AS rank, other, round(cosine, 6) + 0.0::DOUBLE AS cosine FROM scored
        WINDOW w AS (PARTITION BY id ORDER BY cosine DESC, other) QUALIFY rank <= {SYNONYMS}""",
    "word_contexts": f"""WITH {COUNTS},
        vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS p FROM counts WHERE n >= {MIN_COUNT}),
        placed AS (
          SELECT review_id, word, p, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS i FROM tokens JOIN vocab USING (word)),
        sides AS (
          SELECT x.word AS first, x.p AS p_first, y.word AS second, y.p AS p_second, {WINDOW} + 1 - d AS weight
          FROM (SELECT *, unnest(range(1, {WINDOW} + 1)) AS d FROM placed) x JOIN placed y ON x.review_id = y.review_id AND y.i = x.i + x.d),
        met AS (
          SELECT first AS word, second AS context, weight FROM sides WHERE p_second <= {CONTEXTS}
          UNION ALL SELECT second, first, weight FROM sides WHERE p_first <= {CONTEXTS}),
        pairs AS (SELECT word, context, CAST(sum(weight) AS BIGINT) AS n FROM met GROUP BY word, context),
        shares AS (
          SELECT *, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY word) AS n_word, sum(n) OVER (PARTITION BY context) AS n_context FROM pairs)
        SELECT word, context, n, round(ln(n * total::DOUBLE / (n_word * n_context::DOUBLE)), 6) + 0.0::DOUBLE AS pmi FROM shares
        WHERE ln(n * total::DOUBLE / (n_word * n_context::DOUBLE)) > 0""",
    "clusters_exact": f"WITH {EXACT} SELECT * FROM clusters",
    "clusters_top": f"WITH {TOP_CLUSTERS} SELECT rank, feature, representative, n_reviews, n_ngrams FROM top",
    "clusters_allpairs": allpairs("feature"),
    "clusters_allpairs_first": allpairs("w2"),
    "clusters_similarity": f"""WITH RECURSIVE {keyed_items("feature")},
        queue AS (SELECT row_number() OVER (ORDER BY n DESC, key) AS k, key FROM items),
        adjacent AS (
          SELECT q.k, q.key, coalesce(list(p.k ORDER BY p.k) FILTER (p.k < q.k), []) AS before
          FROM queue q LEFT JOIN near n ON n.f = q.key LEFT JOIN queue p ON p.key = n.g GROUP BY ALL),
        walk AS (
          SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leaders, CAST(NULL AS BIGINT) AS leader
          UNION ALL
          SELECT a.k, CASE WHEN len(list_intersect(a.before, w.leaders)) = 0 THEN list_append(w.leaders, a.k) ELSE w.leaders END,
                 coalesce(list_min(list_intersect(a.before, w.leaders)), a.k)
          FROM walk w JOIN adjacent a ON a.k = w.k + 1),
        assignment AS (
          SELECT q.key, l.key AS cluster_id FROM walk JOIN queue q ON q.k = walk.k JOIN queue l ON l.k = walk.leader)
        {merged("feature")}""",
    "cluster_members": f"WITH {STATS} SELECT feature AS cluster_id, w2, modifier, feature, cnt FROM stats",
    "cluster_report": f"""WITH {TOP_CLUSTERS}
        SELECT rank, CAST(0 AS BIGINT) AS line, representative || ': ' || n_reviews || ' | Feature: ' || feature AS text FROM top
        UNION ALL SELECT rank, 1, w2 || ', ' || modifier || ', ' || feature FROM stats JOIN top USING (feature)""",
    "modifier_histogram": f"WITH {HISTOGRAM} SELECT feature AS cluster_id, modifier, n_windows, n_reviews FROM hist",
    "modifier_weights": f"WITH {weights(MIN_WINDOWS)} {_WEIGHTS}",
    "modifier_weights_min1": f"WITH {weights(1)} {_WEIGHTS}",
    "modifier_weights_same_feature": f"WITH {weights(1, 'same_feature')} {_WEIGHTS}",
    "top_positive": _top_modifiers("DESC"),
    "top_negative": _top_modifiers("ASC"),
    "similar_pairs": f"WITH {PAIRS} SELECT id_a, id_b, round(cosine, 6) + 0.0::DOUBLE AS cosine FROM pairs",
    "components": f"""WITH RECURSIVE {VECTORS},
        near AS (SELECT a.id AS f, b.id AS g FROM vectors a JOIN vectors b
                 ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) > {VECTOR_THRESHOLD}),
        reach AS (SELECT id AS f, id AS root FROM vectors
                  UNION SELECT n.g, r.root FROM reach r JOIN near n ON r.f = n.f)
        SELECT f AS id, min(root) AS component FROM reach GROUP BY f""",
    "matrix_transpose": f"""WITH {VECTORS} SELECT CAST(k AS BIGINT) AS row_id, id AS col_id, v[k + 1] AS value
        FROM vectors, range(len(v)) t(k)""",
    "feature_report": f"""WITH {weights(1)} SELECT t.rank, t.feature, t.representative, t.n_reviews, t.n_ngrams,
        modifier, n_windows, w.n_reviews AS n_modifier_reviews, coef FROM top t LEFT JOIN weights w ON t.rank = w.rank""",
}
