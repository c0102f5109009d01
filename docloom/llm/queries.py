"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, divergence, html_text, minhash, mixing, near_vectors, pii, quality, sentence_pieces, suffix_dedup, token_counts, toxicity


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Folder of the public vocabularies; another place can be named by the environment.
TOKENIZERS = os.environ.get("DOCLOOM_TOKENIZERS", "")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on driver and executors."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.sample_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["quality", "toxic"])
    return toxicity.score(docs, chain)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_repairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_ann": op1_ann,
    "op2_mixing": op2_mixing,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_html_text": op6_html_text,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash": op10_minhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_near_vectors": op12_near_vectors,
    "op13_conversation_repair": op13_conversation_repair,
}

#: SQL twins; the other operators hash, fit or sample and are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op10_minhash": r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.y FROM r JOIN e ON r.other = e.x),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON d.doc_id = c.id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op11_source_divergence": r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS id FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
b AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(b.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN b ON b.lang = x.lang AND b.source = x.source AND b.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE count > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50""",
}
