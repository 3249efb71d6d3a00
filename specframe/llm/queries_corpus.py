"""Queries on repetition: between documents, within them, and over a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, phrases, runs
from .registry import query, table

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD_SQL = f"""
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS row_no, doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w != '') AS w
  FROM documents),
sets AS (
  SELECT row_no, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM numbered),
items AS (SELECT row_no, unnest(s) AS item FROM sets),
shared AS (
  SELECT a.row_no AS x, b.row_no AS y, count(*) AS n_common FROM items a JOIN items b ON a.item = b.item AND a.row_no != b.row_no GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sets a ON a.row_no = x JOIN sets b ON b.row_no = y
  WHERE 100 * n_common >= 90 * (len(a.s) + len(b.s) - n_common)),
reached(start_no, row_no) AS (
  SELECT row_no, row_no FROM sets
  UNION
  SELECT start_no, y FROM reached JOIN links ON x = row_no),
least AS (
  SELECT start_no, min(doc_id) AS component_id FROM reached JOIN sets USING (row_no) GROUP BY start_no)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN least ON start_no = row_no
"""


@query("op11_jaccard", _JACCARD_SQL)
def near_equal_sets(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(table(spark, folder, "documents"))


@query("op12_runs")
def word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(table(spark, folder, "documents"), runs.planted))


_PHRASE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(coalesce({_LOWER}, ''), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w != '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM words, range(1, 6) sizes(k) WHERE len(w) >= k),
counts AS (SELECT lang, p, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {phrases.LEAST_COUNT}),
inside AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda size: list_transform(range(1, k - size + 2), lambda i: p[i:i + size - 1])))) AS part
    FROM counts WHERE k > 2) GROUP BY ALL),
candidates AS (
  SELECT c.lang, c.p, c.k, c.f AS a FROM counts c LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.p WHERE c.k > 1 AND (i.f IS NULL OR 100 * i.f < 100 * c.f)),
cuts AS (
  SELECT c.lang, c.p, c.a, cut_at, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (l::HUGEINT * r) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut_at FROM candidates) c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:cut_at]
  JOIN counts y ON y.lang = c.lang AND y.p = c.p[cut_at + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut_at) AS pick FROM cuts),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best WHERE pick = 1)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {phrases.TOP}
"""


@query("op13_phrases", _PHRASE_SQL)
def collocated(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
