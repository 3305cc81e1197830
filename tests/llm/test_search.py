"""Ranked search and nearest neighbours against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ringlens.llm import neighbours, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranking(docs, items, top=20):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t, *_ in docs]
    counted = [(d, c) for d, c in counted if c]
    big_n, big_l = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item_id, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return Counter(out)


def ranked(docs, items, **options):
    return Counter(tuple(r) for r in search.ranked_documents(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture
def item_table(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("tile", [(64, 4096, 512, 1 << 53, 1 << 22), (3, 5, 4, 1 << 33, 100)])
def test_ranking_of_odd_rows(documents, odd_rows, item_table, monkeypatch, tile):
    """Also with tiny tiles, slices closed early by a small bound, and long texts read in stretches."""
    for name, value in zip(("TILE_ITEMS", "TILE_TERMS", "TILE_DOCS", "EXACT", "LONG"), tile):
        monkeypatch.setattr(search, name, value)
    items = [(1, "the of and the THE with"), (2, None), (3, ""), (4, "unseen"), (5, "Ünïcödé 漢字 àé x"), (None, "one two"), (1, "one, two; three"),
             (7, odd_rows[5][1]), (8, "of " * 500 + "this be")]
    items += [(20 + i, " ".join(random.Random(i).choices("they be at this was on".split(), k=8))) for i in range(6)]
    assert ranked(documents(odd_rows), item_table(items)) == brute_ranking(odd_rows, items)


def test_equal_scores_go_by_id(documents, item_table):
    rows = [(i, "same words here", "en", "a") for i in range(60, 0, -1)] + [(None, "same words here", "en", "a")] + [(100, "other text", "en", "a")]
    assert [(r.rank, r.doc_id) for r in search.ranked_documents(documents(rows, 7), item_table([(1, "words")])).orderBy("rank").collect()] == \
        [(i, i) for i in range(1, 21)]
    few = ranked(documents(rows[-3:]), item_table([(1, "words")]))
    assert few == brute_ranking(rows[-3:], [(1, "words")])


def test_passes_and_empty_tables(documents, odd_rows, item_table, monkeypatch):
    items = [(i, f"the {w} and") for i, w in enumerate("of to in a is that it".split())]
    docs = documents(odd_rows)
    monkeypatch.setattr(search, "PASS_ITEMS", 3)
    assert ranked(docs, item_table(items)) == brute_ranking(odd_rows, items)
    assert not ranked(docs.where("false"), item_table(items[:1])) and not ranked(docs, item_table([(1, None)]))


def test_slices_stay_exact():
    """Repeats beyond what one product may hold are spread over slices and add up."""
    weight = search.weights(10**9, {0: 1, 1: 5 * 10**8}, 2)
    items = [Counter({0: 10**6, 1: 3}), Counter({1: 2})]
    slices = search.tile_slices(items, weight)
    got = [defaultdict(float) for _ in items]
    for column, counts in slices:
        assert ((counts * weight[[t for t in sorted(range(2), key=lambda t: column[t]) if column[t] >= 0]][:, None]).sum(axis=0)
                * search.LARGEST_RATIO < 2**53).all()
        for t in range(2):
            if column[t] >= 0:
                for i, n in enumerate(counts[column[t]]):
                    got[i][t] += n
    assert len(slices) > 1 and [{t: n for t, n in g.items() if n} for g in got] == [dict(c) for c in items]


# --- Nearest neighbours --------------------------------------------------------------

SCHEMA = "vec_id bigint, embedding array<double>, k1 string, score string, block string, leaves string"


def brute_neighbours(rows, every, top=20):
    """query id -> list of (rank, id, score) per query row, over all rows that take part."""
    right = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = defaultdict(list)
    for n, (i, v) in enumerate(right):
        if i % every == 0:
            scored = sorted((-float((v * w).sum()), j) for m, (j, w) in enumerate(right) if m != n)[:top]
            out[i].append([(rank, j, -s) for rank, (s, j) in enumerate(scored, 1)])
    return out


def answers(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    return out


def vectors(spark, rows, partitions=4):
    full = [(i, v and [x if x is None else float(x) for x in v], "k", "s", "b", "l") for i, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def test_neighbours_of_odd_vectors(spark):
    """Nulls, zeros, non-finite parts, repeated ids, ties, and one vector of a third of all rows; all leaves are visited here."""
    chance = np.random.default_rng(3)
    rows = [(i, chance.standard_normal(8).round(1).tolist()) for i in range(120)]
    rows += [(i, [1.0, 0.0, 0, 0, 0, 0, 0, 0]) for i in range(200, 290)] + [(i, [0.0, 0, 0, 0, 0, 0, 3.0, 0]) for i in range(300, 306)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, float("nan")] + [0.0] * 6), (403, [1.0, None] + [0.0] * 6), (404, [float("inf")] * 8),
             (405, []), (None, [1.0] * 8), (20, [2.0] * 8), (20, [-0.0, 5.0] + [0.0] * 6), (20, [0.0, 5.0] + [0.0] * 6), (420, None)]
    want = brute_neighbours(rows, 20)
    got = answers(neighbours.nearest_of_every(vectors(spark, rows)))
    assert set(got) == set(want)
    met, total = 0, 0
    for q, lists in want.items():
        assert len(got[q]) == sum(map(len, lists))
        wanted = Counter((j, round(s, 9)) for one in lists for _, j, s in one)
        found = Counter((j, round(s, 9)) for _, j, s in got[q])
        met, total = met + (wanted & found).total(), total + wanted.total()
        if len(lists) == 1:
            assert sorted(r for r, _, _ in got[q]) == list(range(1, len(got[q]) + 1))
            assert [(-s, j) for _, j, s in sorted(got[q])] == sorted((-s, j) for _, j, s in got[q])
    assert met >= 0.9 * total


def test_few_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5]), (3, [1.0, 2.0, 3.0])]
    want = {q: lists[0] for q, lists in brute_neighbours(rows[:3], 20).items()}
    assert {q: sorted(found) for q, found in answers(neighbours.nearest_of_every(vectors(spark, rows))).items()} == want
    assert neighbours.nearest_of_every(vectors(spark, rows).where("false")).count() == 0
    assert neighbours.nearest_of_every(vectors(spark, rows[:1])).count() == 0


@pytest.mark.parametrize("block,lot", [(4096, 4096), (64, 10)])
def test_recall_of_a_table(spark, monkeypatch, block, lot):
    """Also with leaves larger than a block and several lots of queries for it."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "LOT", lot)
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute_neighbours(rows, 20), answers(neighbours.nearest_of_every(table))
    exact = {i: np.array(v, dtype=np.float64) for i, v in rows}
    met = 0
    for q, lists in want.items():
        assert len(got[q]) == 20
        assert all(s == pytest.approx(float((exact[q] * exact[j]).sum()), rel=1e-12, abs=1e-15) for _, j, s in got[q])
        met += len({j for _, j, _ in lists[0]} & {j for _, j, _ in got[q]})
    assert met >= 0.9 * 20 * len(want), met / 20 / len(want)
