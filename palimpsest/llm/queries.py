"""The queries of this subpackage: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import edited_likeness
from .flac import media_digests
from .hard_negatives import hard_negatives, scaled
from .language_model import score_texts
from .line_dedup import drop_repeated_lines
from .near_dedup import near_duplicates
from .packing import pack_documents
from .personal import KINDS, personal_spans
from .piece_encoding import encode_digests
from .spelling import spelling_variants
from .suffix_dedup import remove_repeats
from .textblocks import read_documents, tokenizer_file
from .toxicity import toxicity
from .url_rules import judge_urls

#: The four rules that op10 judges by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir), with_bytes=False)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read_documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read_documents(spark, sf_dir), with_text=False)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(noisy, F.col("vec_id") % 100 == 0)


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(read_documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    many = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *many, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_model": op2_language_model,
    "op3_packing": op3_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_piece_encoding": op5_piece_encoding,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_media": op8_media,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_personal": op12_personal,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op4_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM words
        ), shingles AS (
            SELECT doc_id, unnest(s) AS g FROM sets
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)
        ), ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
    """,
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, line, lower_ascii AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
                 LATERAL (SELECT translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)
        ), owners AS (
            SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), judged AS (
            SELECT l.doc_id, i, line, coalesce(o.owner <> l.doc_id, false) AS gone FROM lines l LEFT JOIN owners o ON l.key = o.key
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op10_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages
        ), rules(h, p, v) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), fits AS (
            SELECT page_id, host, path, h || p AS rule, v,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS rn
            FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        )
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE rn = 1
    """,
    "op11_hard_negatives": r"""
        WITH valid AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
    """,
    "op13_spelling": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), runs AS (
            SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
        ), hashed AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(s) * 2, 2), lambda i: CAST('0x' || substr(hex(encode(s)), i + 1, 2) AS BIGINT))),
                                           lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h
            FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs), crc_table
        ), slipped AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
        ), words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), deletions AS MATERIALIZED (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest, length(word) AS len, substr(word, i, 1) AS letter FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), pairs AS (
            SELECT DISTINCT d.word, w.word AS near, w.n AS near_n FROM deletions d JOIN words w ON d.rest = w.word
            UNION SELECT w.word, d.word, d.n FROM deletions d JOIN words w ON d.rest = w.word
            UNION SELECT a.word, b.word, b.n FROM deletions a JOIN deletions b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.letter <> b.letter
        ), best AS (
            SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word
        ), formed AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.near_n = top) END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word
        ), follow(word, last, steps) AS (
            SELECT word, word, 0 FROM formed UNION ALL SELECT f.word, g.form, steps + 1 FROM follow f JOIN formed g ON f.last = g.word WHERE g.form IS NOT NULL
        )
        SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed f JOIN (SELECT word, arg_max(last, steps) AS root FROM follow GROUP BY word) r ON f.word = r.word
    """,
}
