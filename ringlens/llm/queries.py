"""The queries of these operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringlens.llm import alignment, bpe, exact_dedup, html_text, language, mixing, neighbours, quality, search, simhash, substring_dedup, token_files, warc
from ringlens.llm.store import read_documents, read_table
from ringlens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(configure(spark), folder)
    return build


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_quality_rules(spark, folder):
    return quality.judged(read_documents(spark, folder))


@query
def op3_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(read_documents(spark, folder))


@query
def op4_token_files(spark, folder):
    return token_files.tokens_round_trip(read_documents(spark, folder), vocabulary("byte_bpe_50k.json"))


@query
def op6_language_id(spark, folder):
    return language.predict_languages(read_documents(spark, folder))


@query
def op7_simhash(spark, folder):
    return simhash.simhash_groups(read_documents(spark, folder))


@query
def op9_bpe(spark, folder):
    return bpe.encode_digests(read_documents(spark, folder), vocabulary("word_bpe_49k.json"))


@query
def op10_mixing(spark, folder):
    return mixing.mix(read_documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query
def op8_warc(spark, folder):
    return warc.archives_round_trip(read_table(spark, folder, "pages"))


@query
def op1_substring_dedup(spark, folder):
    return substring_dedup.removal_digests(read_documents(spark, folder))


@query
def op5_html_text(spark, folder):
    return html_text.main_text(read_table(spark, folder, "pages"))


@query
def op13_alignment(spark, folder):
    return alignment.alignment_digests(read_documents(spark, folder), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op11_lexical_search(spark, folder):
    return search.ranked_documents(read_documents(spark, folder), read_table(spark, folder, "benchmark"))


@query
def op12_nearest_neighbours(spark, folder):
    return neighbours.nearest_of_every(read_table(spark, folder, "embeddings"))


# --- SQL counterparts where SQL can express the result on whole tables --------------

ORACLES["op3_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
h AS (SELECT doc_id, sha256(body) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)"""

ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN latest END AS refers_to
FROM g"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op11_lexical_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS all_docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM d),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
t AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY term, all_docs),
i AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms))) AS impact
  FROM f JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20"""
