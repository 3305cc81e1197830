"""The registered queries and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare
from ringlens.llm import mixing
from ringlens.llm.queries import ORACLES, vocabulary

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    outcome, _ = compare(spark, connection, SF, name, entry.queries()[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_pipeline_against_brute_force(spark):
    from test_dedup import brute_near

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    latest = {}
    for row in rows:
        latest[row[1].encode().lower()] = max(latest.get(row[1].encode().lower(), row), row)
    rows = sorted(latest.values())
    heads = {component for _, _, component in brute_near([(d, t) for d, t, _ in rows])}
    rows = [r for r in rows if r[0] in heads]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for d, t, _ in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += copies[d]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in entry.queries()["pipeline"](spark, SF).collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_stages_keep_clashing_columns(spark, documents, odd_rows):
    """Columns with the names that stages use inside come through with their values."""
    names = ["lang_pred", "score", "_id", "_sha", "_source", "_copies", "_each", "_row", "_wanted", "_number", "_lot", "copies", "text_key",
             "rank", "h", "d", "all", "_Row_"]
    docs = documents(odd_rows)
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left, plain = stage(spark, wide, SF), stage(spark, docs, SF)
        assert left.columns == wide.columns, name
        rows = left.collect()
        assert all(r[n] == f"{n}:{r.text or ''}" for r in rows for n in names), name
        if name in ("language", "exact_dedup", "near_dedup"):
            assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect()), name


def test_mixed_words_are_the_mix(spark):
    """A third of null ids, repeated ids and repeated rows: what the stage delivers is what the mix says, near the target."""
    chance = random.Random(3)
    rows = []
    for i in range(900):
        source = "abc"[i % 3]
        doc_id = None if chance.random() < 0.4 else (7 if chance.random() < 0.3 else i)
        rows.append((doc_id, " ".join(chance.choice("xyz") for _ in range(chance.choice([8, 8, 8, 20]))), source, i % 4))
    rows += [(5, "one two three four", "a", 1)] * 150 + [(5, "one two three four", "a", k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int").repartition(5)
    plan = mixing.mix(docs).collect()
    planned, target = defaultdict(int), {}
    for r in plan:
        planned[r.source] += r.taken
        target[r.source] = r.target
    assert len(plan) == len(rows)
    delivered = defaultdict(int)
    out = mixing.mixed_documents(docs).collect()
    for r in out:
        delivered[r.source] += len(r.text.split())
    assert delivered == planned
    assert all(abs(planned[s] - target[s]) <= 10 for s in target), (planned, target)
    per_key = Counter()
    for r in plan:
        per_key[r.doc_id, r.source, r.text_key] += r.copies
    assert sum(per_key.values()) == len(out)
    kinds = Counter(rows)
    assert all(n <= 2 * kinds[tuple(r)] for r, n in Counter(out).items())


def test_stages_return_documents(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns and left.count() > 0, name
        assert stage(spark, docs.where("false"), SF).count() == 0
    sources = defaultdict(int)
    for r in docs.collect():
        sources[r.source] += 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(odd_rows) and len(sources) == 3
