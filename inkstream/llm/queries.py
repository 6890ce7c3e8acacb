"""The operators of this package as queries over the supplied tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkstream.llm import (
    decontamination, language_id, lexical_search, neighbours, ngram_join, packing, periodic_runs, quality,
    sentencepiece_codec, substring_dedup, suffix_dedup, token_counts, toxicity,
)

#: The vocabulary of the token queries.
MODEL = "piece_bpe_32k.model"
#: The vocabulary of packing.
PACKING_MODEL = "word_bpe_49k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, folder, "documents"), n=4, percent=85)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), public_tokenizers.path(MODEL))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digest(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(_table(spark, folder, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, folder, "documents"), public_tokenizers.path(MODEL))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(_table(spark, folder, "documents"), public_tokenizers.path(PACKING_MODEL))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digest(_table(spark, folder, "documents"), rewrite=periodic_runs.repeat_tail)


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_neighbours": op8_neighbours,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_packing": op12_packing,
    "op13_periodic_runs": op13_periodic_runs,
}
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

_NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (x + y - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN least ON least.doc_id = s.doc_id"""

_SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM v JOIN f ON f.h = v.h AND f.first < v.doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT placed.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY placed.p) AS t FROM placed ANTI JOIN gone ON gone.doc_id = placed.doc_id AND gone.p = placed.p GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_SEARCH = r"""WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents) WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY 1),
impact AS (SELECT doc_id, p.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS s FROM p JOIN weights ON weights.t = p.t, total),
scores AS (SELECT item_id, doc_id, CAST(sum(times * s) AS BIGINT) AS score FROM q JOIN impact ON impact.t = q.t GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""

#: The suffix query has none: cutting every 400 bytes out of a text takes SQL minutes on whole tables.
ORACLES: dict[str, str] = {
    "op1_ngram_join": _NGRAM_JOIN,
    "op3_substring_dedup": _SUBSTRINGS,
    "op11_lexical_search": _SEARCH,
}
