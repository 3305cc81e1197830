"""Substring, exact and near deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ringlens.llm import exact_dedup, simhash, substring_dedup
from ringlens.llm.components import components


def brute_removal(rows, window):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            if d is not None:
                first[run] = min(d, first.get(run, d))
    result = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        result.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(result)


def as_counter(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_removal_of_odd_rows(documents, odd_rows):
    got = as_counter(substring_dedup.removal_digests(documents(odd_rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_removal(odd_rows, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_of_random_texts(documents, seed):
    """A tiny vocabulary, short windows: branching, overlapping and self-repeating passages."""
    chance = random.Random(seed)
    pool = [[chance.choice("abc") for _ in range(12)] for _ in range(8)]
    rows = [(i, " ".join(sum((chance.choice(pool)[: chance.randint(3, 12)] for _ in range(chance.randint(1, 6))), [])), None, None)
            for i in range(60)]
    got = as_counter(substring_dedup.removal_digests(documents(rows), window=6, seed=3), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_removal(rows, 6)


def test_kept_texts_and_tables(documents, small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.collect()]
    df = substring_dedup.remove_repeated_passages(small_documents)
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())
    assert got == brute_removal(rows, 50)
    assert substring_dedup.removal_digests(documents([(1, "a", None, None)]).where("false")).count() == 0


def test_paths_are_compacted(documents):
    """A long shared passage is one path, not one row per segment."""
    passage = " ".join(f"w{i}" for i in range(400))
    rows = [(i, f"x{i} {passage} y{i}", None, None) for i in range(5)]
    repeated = substring_dedup.repeated_segments(substring_dedup.segments(documents(rows)))
    own = substring_dedup.variants(repeated)
    paths = substring_dedup.compacted_paths(repeated, own)
    plain = paths.where("NOT branching")
    assert plain.count() > 8 and plain.select("path_first").distinct().count() == 1


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        body = (t or "").encode().lower()
        groups[body].append(d)
    result = Counter()
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        for d in ids:
            result[d, max(known, default=None), len(ids), hashlib.sha256(body).hexdigest()] += 1
    return result, len(groups)


@pytest.mark.parametrize("key_bits,bucket_bytes", [(63, 64 << 20), (2, 1 << 20), (63, 500)])
def test_exact_groups(documents, odd_rows, key_bits, bucket_bytes):
    """Also with keys of two bits, where chains hold many texts, and with tiny buckets, where the directory doubles."""
    df = exact_dedup.exact_groups(documents(odd_rows), key_bits, bucket_bytes)
    want, groups = brute_exact(odd_rows)
    rows = df.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    kept = [r for r in rows if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_directory_doubles(documents, odd_rows):
    docs = documents(odd_rows)
    assert len(exact_dedup.build_directory(docs, bucket_bytes=300)) > len(exact_dedup.build_directory(docs))
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


def test_directory_covers_every_prefix():
    """Buckets are whole prefixes, none of several bins is overfull, and splitting keeps up with many buckets."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 100, 1 << 12) * (rng.random(1 << 12) < 0.3)
    bins[1000] = 5000
    directory = exact_dedup.split_directory(bins, 3, 700)
    depth = len(directory).bit_length() - 1
    sizes, places = np.bincount(directory, bins.reshape(len(directory), -1).sum(axis=1)), np.bincount(directory)
    assert sorted(set(directory.tolist())) == list(range(directory.max() + 1)) and (np.diff(directory) >= 0).all()
    for bucket, (size, span) in enumerate(zip(sizes, places)):
        first = int(np.argmax(directory == bucket))
        assert span & (span - 1) == 0 and first % span == 0 and span <= 1 << (depth - 3)
        assert size <= 700 or (1 << (12 - depth)) * span == 1
    large = exact_dedup.split_directory(np.full(1 << 20, 10), 4, 20)
    assert len(large) == 1 << 19


def test_dropping_exact_copies(documents, odd_rows):
    docs = documents(odd_rows)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == brute_exact(odd_rows)[1]


def brute_near_components(rows):
    """(fingerprint, number of the component) of every row."""
    prints = []
    for _, t, *_ in rows:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else ([b" ".join(words)] if words else [])
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                counts[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)))
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [(fp, root(i)) for i, fp in enumerate(prints)]


def brute_near(rows):
    found, low = brute_near_components(rows), {}
    for (d, *_), (_, r) in zip(rows, found):
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return Counter((d, f"{fp:016x}", low[r]) for (d, *_), (fp, r) in zip(rows, found))


def brute_heads(rows):
    """(doc_id, text) of the row that stays of each component: smallest id (null last), then smallest hash of the text."""
    best = {}
    for (d, t, *_), (_, r) in zip(rows, brute_near_components(rows)):
        key = (d is None, d or 0, hashlib.sha256((t or "").encode()).hexdigest())
        best[r] = min(best.get(r, (key, d, t or "")), (key, d, t or ""), key=lambda x: x[0])
    return Counter((d, t) for _, d, t in best.values())


def test_near_groups(documents, odd_rows):
    chance = random.Random(4)
    base = [f"v{chance.randint(0, 500)}" for _ in range(300)]
    near = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 4):
            words[chance.randrange(len(words))] = "changed"
        near.append((100 + i, " ".join(words), "en", "a"))
    rows = odd_rows + near
    got = as_counter(simhash.simhash_groups(documents(rows)), "doc_id", "fingerprint", "component_id")
    assert got == brute_near(rows)
    assert max(Counter(c for _, _, c in got).values()) > 10


def test_near_groups_of_a_table(small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.collect()]
    assert as_counter(simhash.simhash_groups(small_documents), "doc_id", "fingerprint", "component_id") == brute_near(rows)
    assert simhash.simhash_groups(small_documents.where("false")).count() == 0


def test_large_buckets_are_split(spark, monkeypatch):
    """A cloud of fingerprints around one centre, with buckets of eight: same components as all pairs."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    chance = random.Random(9)
    values = set()
    for centre in (0x0123456789ABCDEF, 0xFFFF0000FFFF0000):
        for _ in range(150):
            v = centre
            for _ in range(chance.randint(0, 3)):
                v ^= 1 << chance.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(v, v) for v in signed], "node bigint, fp bigint"))
    got = {r.node: r.label for r in components(links).collect()}
    label = {v: v for v in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if label[a] > label[b] and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                    label[a], changed = label[b], True
    assert all(got.get(v, v) == label[v] for v in signed)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_dropping_near_copies(documents, odd_rows):
    docs = documents(odd_rows)
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == brute_heads(odd_rows)


def test_one_row_of_each_near_component(documents):
    """Null ids alone, and repeated ids with different texts, are still one row for each component."""
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))

    rows = [(None, text(f"n{k}"), "en", "a") for k in range(5)] + [(None, text("n0"), "en", "b")]
    rows += [(7, text("p"), "en", "a"), (7, text("q"), "en", "a"), (7, text("q"), "en", "a"), (8, text("q"), "en", "a"), (9, text("p"), "en", "a")]
    docs = documents(rows)
    left = simhash.drop_near_copies(docs).collect()
    want = [(None, text(f"n{k}")) for k in range(5)] + [(7, text("p")), (7, text("q"))]
    assert Counter((r.doc_id, r.text) for r in left) == Counter(want)
    assert as_counter(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == brute_near(rows)


def test_repeated_ids_link_nothing(documents):
    """Copies of two different texts that share their smallest id stay two components."""
    rows = [(1, "a b c d e f", "en", "a"), (1, "u v w x y z", "en", "a"), (2, "a b c d e f", "en", "a"), (3, "u v w x y z", "en", "a"),
            (4, "u v w x y z", "en", "a")]
    left = simhash.drop_near_copies(documents(rows)).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter({(1, "a b c d e f"): 1, (1, "u v w x y z"): 1})
