"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.align import align
from tessera.llm.decontaminate import contaminated
from tessera.llm.fingerprints import edits
from tessera.llm.html_text import extract
from tessera.llm.language import identify
from tessera.llm.line_dedup import without_recurring_lines
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.pieces import encode
from tessera.llm.pii import pseudonymise
from tessera.llm.quality import classify
from tessera.llm.repeats import repeats
from tessera.llm.resample import resample
from tessera.llm.top_k import top_k
from tessera.sources.tables import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that stand in several documents."""
    return repeats(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines, and how many went."""
    return without_recurring_lines(table(spark, sf_dir, "documents"), dropped="n_dropped").select("doc_id", "text", "n_dropped")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query vector."""
    return top_k(table(spark, sf_dir, "embeddings"), k=20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return encode(table(spark, sf_dir, "documents"))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The key of op9's permutation here; a user passes one of their own.
PII_KEY = "example key of the registered query"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values under pseudonyms."""
    return pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the ranks of the twentieth that is drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def _crc32_steps() -> list[int]:
    """What each byte does to a CRC state: the reflected polynomial, divided out bit by bit."""
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1 for c in out]
    return out


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, FALSE AS goal FROM documents),
b AS (SELECT -row_number() OVER () AS r, NULL AS doc_id, text, TRUE AS goal FROM benchmark),
w AS (
  SELECT r, doc_id, goal, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT * FROM d UNION ALL SELECT * FROM b)),
g AS (
  SELECT r, goal, unnest(w) AS f FROM w
  UNION ALL SELECT r, goal, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
  UNION ALL SELECT r, goal, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2),
n AS (SELECT r, goal, f, count(*) AS n FROM g GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
c AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 2) AS BIGINT))),
    lambda s, x: xor(s >> 8, {_crc32_steps()}[(xor(s, x) & 255) + 1]))) % 10000 AS bucket FROM u),
m AS (SELECT r, goal, bucket, sum(n) AS n FROM n JOIN c USING (f) GROUP BY ALL),
t AS (SELECT bucket, sum(n) FILTER (NOT goal) AS s, sum(n) FILTER (goal) AS t FROM m GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (a.s + 10000) / ((coalesce(t.s, 0) + 1)::DOUBLE * (a.t + 10000)))) AS gain FROM t, a),
x AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM m JOIN gain USING (bucket) WHERE NOT goal GROUP BY r),
y AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(x.n_features, 0)::BIGINT AS n_features, coalesce(x.weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN x USING (r) WHERE NOT goal),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features DESC) AS place, count(*) OVER () AS n FROM z WHERE n_words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM z LEFT JOIN o USING (r)
"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and how like it is to an edited text's and to the next document's."""
    return edits(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (SELECT doc_id, min(coalesce(text, '')) AS t FROM documents GROUP BY doc_id),
n AS (SELECT doc_id, t, length(t) AS n_chars, lead(doc_id) OVER w AS next_id, first_value(doc_id) OVER w AS first_id, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (SELECT *, left(t, CAST(n_chars - n_chars // 2 AS INTEGER)) || left(next_t, CAST(n_chars // 2 AS INTEGER)) AS e, coalesce(next_id, first_id) AS after FROM n),
x AS (SELECT doc_id, FALSE AS edited, t FROM e UNION ALL SELECT doc_id, TRUE, e FROM e),
w AS (SELECT doc_id, edited, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+') AS w FROM x),
h AS (
  SELECT doc_id, edited, substr(md5(array_to_string(w, ' ')), 1, 16) AS digest,
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))] ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) END AS h FROM w),
k AS (SELECT doc_id, edited, digest, list_sort(list_distinct(list_transform(list_filter(h, lambda x: x < '4'), lambda x: substr(x, 1, 15)))) AS s FROM h),
p AS (
  SELECT e.doc_id, e.n_chars, sha256(e.e) AS edited_sha256, a.digest AS da, b.digest AS db, c.digest AS dc, a.s AS sa, b.s AS sb, len(list_intersect(a.s, b.s)) AS ab, len(list_intersect(a.s, c.s)) AS ac, len(a.s) AS na, len(b.s) AS nb, len(c.s) AS nc
  FROM e JOIN k a ON NOT a.edited AND a.doc_id IS NOT DISTINCT FROM e.doc_id JOIN k b ON b.edited AND b.doc_id IS NOT DISTINCT FROM e.doc_id JOIN k c ON NOT c.edited AND c.doc_id IS NOT DISTINCT FROM e.after)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, da || ':' || array_to_string(sa, '') AS fingerprint, db || ':' || array_to_string(sb, '') AS edited_fingerprint,
  CASE WHEN da = db THEN 1.0::DOUBLE WHEN na + nb - ab = 0 THEN 0.0::DOUBLE ELSE ab::DOUBLE / (na + nb - ab) END AS near_edited,
  CASE WHEN da = dc THEN 1.0::DOUBLE WHEN na + nc - ac = 0 THEN 0.0::DOUBLE ELSE ac::DOUBLE / (na + nc - ac) END AS near_next,
  CASE WHEN da = db THEN 1.0::DOUBLE WHEN na = 0 THEN 0.0::DOUBLE ELSE ab::DOUBLE / na END AS contained_edited,
  CASE WHEN da = dc THEN 1.0::DOUBLE WHEN na = 0 THEN 0.0::DOUBLE ELSE ac::DOUBLE / na END AS contained_next
FROM p
"""


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public tokenizers meet in every document."""
    return align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html": op1_html, "op2_repeats": op2_repeats, "op3_lines": op3_lines, "op4_near_dedup": op4_near_dedup, "op5_topk": op5_topk, "op6_pieces": op6_pieces, "op7_contamination": op7_contamination, "op8_quality": op8_quality, "op9_pii": op9_pii, "op10_language": op10_language, "op11_resample": op11_resample, "op12_fingerprints": op12_fingerprints, "op13_align": op13_align}


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5_SQL, "op11_resample": OP11_SQL, "op12_fingerprints": OP12_SQL}
