"""Queries of the training-data operators over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, filter_audit, graph_search, jaccard, lexical, licenses, packing, quality, secret_scan, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, order=("doc_id", "piece", "ids_crc32")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    out = quality.quality(docs, labels)
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", "path_length")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.read_warc(folder, index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_table(spark, sf_dir, "documents"))
    return lexical.search(index, _table(spark, sf_dir, "benchmark"), 10).select("item_id", "rank", "doc_id", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_audit.cells(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.audit(found)


def op13_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return graph_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_jaccard, op3_bpe_codec, op4_best_fit_packing, op5_quality_rules, op6_toxicity, op7_embedding_near_dedup, op8_license_scan, op9_secret_scan, op10_warc, op11_ranked_lexical_search, op12_filter_audit, op13_graph_neighbours)}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 1000 * k >= 800 * (na + nb - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, g.class_id, coalesce(n.n, 0) AS n_links, d.doc_id = g.class_id AS kept FROM documents d JOIN g ON g.a = d.doc_id LEFT JOIN n ON n.a = d.doc_id""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
g AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, g.component_id, x.vec_id = g.component_id AS kept FROM embeddings x JOIN g ON g.a = x.vec_id LEFT JOIN n ON n.a = x.vec_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s FROM p),
f AS (SELECT page_id, n, s, min(page_id) OVER (PARTITION BY s) AS first FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f""",
    "op11_ranked_lexical_search": r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term),
m AS (SELECT doc_id, 25 + (75 * n * docs) // total AS m FROM n, t),
a AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM a JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
    "op12_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o(o) AS (SELECT x FROM x UNION ALL SELECT o || x FROM o, x WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS letter, substr(o, 1, step - 1) AS before FROM o, range(1, 6) r(step) WHERE length(o) = 5),
e AS (SELECT part, filter_order, step, letter, n, good, toxic, fails = letter AS alone, contains(fails, letter) AS here, before <> '' AND regexp_matches(fails, '[' || before || 'x]') AS earlier FROM c, s),
g AS (SELECT part, filter_order, step::INT AS step, any_value(letter) AS letter, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (here AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT earlier), 0)::BIGINT AS toxic_lost FROM e GROUP BY 1, 2, 3)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM g""",
}
