"""Registered queries of the package, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwatch.llm import collocations, embedding_dedup, hard_negatives, license_scan, mixing, ngram_join, packing, quality, secret_scan, tokens, toxicity, url_filter, warc
from wardwatch.llm.url_filter import Rule

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

# Share of each domain in the mixture; the clean documents set the scale.
MIXTURE = {"clean": 0.95, "low": 0.04, "toxic": 0.01}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated_archives(_table(spark, sf_dir, "pages")).drop("url", "file")


# base32 of a 160-bit hex digest: twenty bits are five hex digits and four letters
SQL["op1_warc_revisits"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s FROM p),
b AS (
  SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT, 1)), '') AS dig FROM d),
f AS (SELECT dig, min(page_id) AS o FROM b GROUP BY dig)
SELECT page_id, n::BIGINT AS payload_bytes, b.dig AS payload_digest,
  CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = o THEN NULL ELSE o END AS refers_to
FROM b JOIN f USING (dig)
"""


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, cache=400_000)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_file_index(_table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


SQL["op8_ngram_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM w),
d AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.v = documents.doc_id GROUP BY ALL
"""


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


SQL["op9_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id JOIN m ON m.v = e.vec_id
"""


# The url rules of the contract.
URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table is what the rules decide; the model judges the other urls."""
    pages = _table(spark, sf_dir, "pages")
    model = url_filter.fit_table(url_filter.labelled_by_rules(pages, URL_RULES))
    return url_filter.judge(pages, URL_RULES, model)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["errors"].cast("string")))
    return found.withColumn("spans", F.array_join(shown, ","))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled table; rows with a null label have none."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    domain = F.when(toxic, "toxic").when(low, "low").when(~low & ~toxic, "clean")
    return _table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain")).filter("domain is not null")


@query
def op6_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain_labels(spark, sf_dir), MIXTURE, "clean")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # it imports this module

    return run(spark, sf_dir)


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


SQL["op12_phrase_collocations"] = """
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM t),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, unnest(list_transform(range(1, least(5, len(ws) - i + 1) + 1), lambda k: ws[i:i + k - 1])) AS p FROM s),
f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY lang, p HAVING count(*) >= 100),
c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
x AS (SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM x),
e AS (SELECT lang, p[i:j] AS p, f FROM (SELECT lang, p, f, i, unnest(range(i + 1, len(p) + 1)) AS j FROM (SELECT lang, p, f, unnest(range(1, len(p))) AS i FROM f WHERE len(p) > 2)) WHERE j - i + 1 < len(p)),
d AS (SELECT lang, p, max(f) AS f FROM e GROUP BY lang, p),
z AS (SELECT m.lang, array_to_string(m.p, ' ') AS phrase, m.a, m.l, m.r, m.n, m.score
  FROM m LEFT JOIN d ON d.lang = m.lang AND d.p = m.p WHERE o = 1 AND (d.f IS NULL OR 100 * d.f < 100 * m.a)),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, n, score FROM y WHERE rank <= 2000
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS o FROM s WHERE same),
m AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND o <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.toxic_documents(docs, labels.select("doc_id", "toxic"))
