"""The queries of the operators, one for each, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from barframe.llm import (
    bpe, collision_search, exact_dedup, hard_negatives, html_wrapper, language_id, mixing, ngram_join, pieces, pii,
    spelling, token_counts, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op2_token_counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# DuckDB's class for the white space \x20\x09-\x0D.
SQL_SPACE = r"[\x20\x09-\x0D]"
SQL_WORD = r"[^\x20\x09-\x0D]+"


@query("op9_source_mix", rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM sized GROUP BY source
), lev AS (
  SELECT *, 3 * source_size / w AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(CAST(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source IS NULL, source
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, source
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM src
), top AS (SELECT arg_min(share, ratio) AS share FROM lev WHERE ratio >= share
), goal AS (
  SELECT source, source_size, coalesce(least(w * (SELECT share FROM top), CAST(3 * source_size AS DOUBLE)), 0.0) AS target FROM lev
), rates AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1.0 WHEN target = 0 THEN 0.0 ELSE round(target / source_size, 9) END AS rate FROM goal
), ranked AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS k
  FROM sized s JOIN rates g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + floor(k * (rate - floor(rate)) + 0.5) - floor((k - 1) * (rate - floor(rate)) + 0.5)) AS BIGINT) AS taken
FROM ranked
""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_exact_dedup", rf"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '{SQL_SPACE}', '', 'g') AS body FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY body) AS group_size FROM k
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM r
""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.marks(table(spark, sf, "documents"))


@query("op6_toxicity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_language_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.language_id(table(spark, sf, "documents"))


@query("op8_pii")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf, "documents")))


@query("op4_sampled_pieces")
def _(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return pieces.sampled_pieces(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_html_text")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return html_wrapper.extract_pages(table(spark, sf, "pages"))


@query("op7_nearest_vectors")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf, "embeddings"))


@query("op1_ngram_join", rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SQL_WORD}') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w
), e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.y AS component_id
FROM s JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) c ON s.doc_id = c.x
""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, sf, "documents"))


@query("op11_hard_negatives", """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"))


@query("op12_bpe")
def _(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(bpe.encode(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True))


# A checksum by half bytes, the lower half first; the list is CRC-32's table for half bytes, fixed values.
@query("op13_spelling_variants", """
WITH RECURSIVE f AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-zÀ-ÿ]+')) AS run FROM documents
), x AS (
  SELECT run, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS h FROM f WHERE length(run) >= 7
), c AS (
  SELECT run, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT),
      [CAST(instr('0123456789ABCDEF', h[j + CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END]) - 1 AS BIGINT) FOR j IN range(1, length(h) + 1)]),
    lambda a, n: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, n) & 15) + 1]))) AS crc FROM x
), w AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM c)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), d AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.rest = w.word
), best AS MATERIALIZED (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m, max(m) >= 10 * max(n) AS follows FROM near GROUP BY word
), step(word, root) AS (
  SELECT word, other FROM best WHERE follows
  UNION ALL SELECT s.word, b.other FROM step s JOIN best b ON s.root = b.word AND b.follows
), last AS (SELECT s.word, s.root FROM step s LEFT JOIN best b ON s.root = b.word WHERE b.follows IS NOT TRUE)
SELECT w.word, CASE WHEN b.follows THEN b.other END AS form, coalesce(l.root, w.word) AS root, w.n,
  coalesce(b.n_near, 0) AS n_near, CASE WHEN b.follows THEN b.m END AS form_n
FROM w LEFT JOIN best b ON w.word = b.word LEFT JOIN last l ON w.word = l.word
""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.document_variants(table(spark, sf, "documents"))
