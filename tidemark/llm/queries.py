"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.chunk_media import media_columns
from tidemark.llm.common import read
from tidemark.llm.license_scan import TEMPLATES, license_scan
from tidemark.llm.line_dedup import line_dedup, line_digests
from tidemark.llm.lm_score import lm_score
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_jaccard_join
from tidemark.llm.packing import pack
from tidemark.llm.quality import co_train, score_quality
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.token_align import Tokenizers, alignment_digests
from tidemark.llm.toxicity import fit_toxicity, toxicity_scores
from tidemark.llm.url_filter import url_filter


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), budget=16_384, n_buckets=8)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), entropy=0.98, repeats=4.0, block_tokens=1 << 20)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_digests(docs, line_dedup(docs, min_chars=20, min_docs=3))


URL_ALLOW = ["org/", "com/fr/"]
URL_BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"), allow=URL_ALLOW, block=URL_BLOCK)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, co_train(docs, read(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"), threshold=0.8)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), min_chars=5, min_count=3, garble=97)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = fit_toxicity(docs.where(~held_out), labels, fit_rows=5000, fit_chars=40_000)
    return toxicity_scores(docs, model, threshold=0.5).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_windows", "worst_word")


TOKENIZER_FILES = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(read(spark, sf_dir, "documents"), Tokenizers.read(*TOKENIZER_FILES))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_nearest": op6_nearest,
    "op7_media": op7_media,
    "op8_lm_score": op8_lm_score,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "op11_spelling": op11_spelling,
    "op12_toxicity": op12_toxicity,
    "op13_token_align": op13_token_align,
}

_SPACE = "E' \\t\\n\\x0b\\x0c\\r'"
_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), keyed AS (SELECT *, {_FOLDED.format(f"trim(line, {_SPACE})")} AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE holder IS NOT NULL AND holder <> doc_id))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
"""

_OP5_SQL = f"""
WITH parts AS (
  SELECT page_id, {_FOLDED.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

_NOTICES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(sorted(TEMPLATES.items())))
_NORMAL = "list_filter(list_transform(string_split(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), ' '), lambda w: regexp_replace(w, '\\.+$', '')), lambda w: w <> '')"
_OP10_SQL = f"""
WITH words AS (SELECT doc_id, {_NORMAL.format("text")} AS w FROM documents),
grams AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]) ELSE w END AS g FROM words),
notices AS (SELECT t, name, {_NORMAL.format("text")} AS w FROM (VALUES {_NOTICES}) AS v(t, name, text)),
templates AS (SELECT t, name, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS grams FROM notices),
near AS (SELECT doc_id, g, t, name, grams FROM grams, templates WHERE 1.2::DOUBLE * len(list_intersect(g, grams)) + 1e-6::DOUBLE >= 0.8::DOUBLE * len(grams)),
starts AS (SELECT *, unnest(range(1, len(g) + 1)) AS p FROM near),
ends AS (SELECT doc_id, name, grams, p, g, unnest(range(p, least(len(g), p + len(grams) * 3 // 2 - 1) + 1)) AS q FROM starts WHERE list_contains(grams, g[p])),
windows AS (SELECT doc_id, name, grams, p, list_distinct(g[p : q]) AS a FROM ends WHERE list_contains(grams, g[q])),
hits AS (SELECT doc_id, name, p, max(2.0::DOUBLE * len(list_intersect(a, grams)) / (len(a) + len(grams))) AS score FROM windows GROUP BY ALL),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p, name) AS n FROM hits WHERE score >= 0.8::DOUBLE - 1e-9::DOUBLE),
named AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM good GROUP BY doc_id)
SELECT d.doc_id, g.name AS license, round(coalesce(g.score, 0.0::DOUBLE), 6) AS score, g.p::BIGINT AS word_no, coalesce(c.licenses, '') AS licenses
FROM documents d LEFT JOIN good g ON g.doc_id = d.doc_id AND g.n = 1 LEFT JOIN named c ON c.doc_id = d.doc_id
"""

_OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b))
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents) GROUP BY ALL
), keyed AS (
  SELECT doc_id, run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs WHERE length(run) >= 5
), bytes AS (
  SELECT run, n, list_transform(range(octet_length(encode(key))), lambda i: ('0x' || hex(key)[2 * i + 1 : 2 * i + 2])::BIGINT) AS b FROM keyed
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, crc_table
), garbled AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM garbled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS k FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1
), chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed l ON l.word = c.at WHERE l.form IS NULL
"""

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": _OP4_SQL, "op5_url_filter": _OP5_SQL, "op10_license_scan": _OP10_SQL, "op11_spelling": _OP11_SQL}
