"""Quality, language, extraction, archives, encoding and mixing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ringlens.llm import bpe, html_text, language, mixing, quality, token_files, warc
from ringlens.llm.dom import features, parse
from ringlens.llm.queries import vocabulary
from ringlens.llm.store import shared_folder

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# --- Quality rules ---------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = SPLIT.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPLIT.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = [False] * len(words)
    for i in range(len(words) - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            covered[i : i + 8] = [True] * 8
    repeat = sum(covered)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, repeat,
            len(words) < 20 or 100 * repeat > 30 * len(words))


def test_base_counts(documents, odd_rows, small_documents):
    for df in (documents(odd_rows), small_documents):
        rows = quality.judged(df).collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert got == Counter((r.doc_id, *brute_counts(r.text)) for r in df.collect())
        assert not any(r.kept and r.base_failed for r in rows)


def test_fences_adapt(documents):
    chance = random.Random(2)
    plain = [" ".join(chance.choice(("alpha", "beta", "gamma", "of", "in", "delta")) + str(chance.randint(0, 99)) for _ in range(80)) for _ in range(600)]
    rows = [(i, t if i % 3 else t.replace(" ", " # "), "en", "code" if i % 3 == 0 else "prose") for i, t in enumerate(plain)]
    rows += [(1000, plain[0].replace(" ", " # "), "en", "prose"), (1001, plain[1].replace(" ", " # "), "en", "code")]
    kept = {r.doc_id: r.kept for r in quality.judged(documents(rows)).collect()}
    assert not kept[1000] and kept[1001]  # usual in code, unusual in prose
    assert sum(not k for k in kept.values()) == 1
    assert quality.judged(documents(rows).where("false")).count() == 0


def test_word_length_fence_follows_the_spread(documents):
    """Words of 8 characters on average are usual where lengths vary, unusual where all texts have about 5."""
    chance = random.Random(7)

    def text(mean):
        return " ".join("".join(chance.choice("abcdefgh") for _ in range(max(1, round(chance.gauss(mean, 1))))) for _ in range(80))

    rows = [(i, text(5), "en", "narrow") for i in range(300)] + [(1000 + i, text(4 + i % 5), "en", "wide") for i in range(300)]
    rows += [(5000, text(8), "en", "narrow"), (5001, text(8), "en", "wide")]
    verdict = {r.doc_id: r.word_length_inside for r in quality.judged(documents(rows)).collect()}
    assert not verdict[5000] and verdict[5001]
    assert sum(not v for v in verdict.values()) == 1


def test_fences_against_exact_quantiles(spark):
    """The verdict of every document from exact quartiles of its group; documents as near to a fence as a sketch errs are left out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.measured(quality.base_counts(docs)).collect()
    judged = {r.doc_id: r for r in quality.judged(docs).collect()}
    good = [r for r in rows if not r.base_failed]
    compared = outside = 0
    for measure, least, use_low, use_high in quality.MEASURES:
        groups = defaultdict(list)
        for r in good:
            for key in ((0, r.lang, r.source), (1, r.lang), (2,)):
                if r[measure] is not None:
                    groups[key].append(r[measure])
        for r in rows:
            if r[measure] is None:
                assert judged[r.doc_id][f"{measure}_inside"]
                continue
            own = next(groups[k] for k in ((0, r.lang, r.source), (1, r.lang), (2,)) if len(groups[k]) >= quality.ENOUGH or k == (2,))
            ordered = sorted(own)
            q25, q75 = (ordered[math.ceil(q * len(ordered)) - 1] for q in (0.25, 0.75))
            reach = quality.REACH * max(q75 - q25, least, 2 * quality.ACCURACY * q75)
            low, high = q25 - reach if use_low else -math.inf, q75 + reach if use_high else math.inf
            slack = (2 * quality.REACH + 1) * quality.ACCURACY * q75 + 1e-12
            if min(abs(r[measure] - low), abs(r[measure] - high)) > slack:
                compared += 1
                outside += not low <= r[measure] <= high
                assert judged[r.doc_id][f"{measure}_inside"] == (low <= r[measure] <= high), (measure, r)
    assert compared > 3.5 * len(rows) and outside > 10


# --- Language --------------------------------------------------------------------

def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict_languages(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(documents, odd_rows):
    rows = language.predict_languages(documents(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    unknown = Counter(r.doc_id for r in rows if r.lang_pred == "und")
    assert unknown == Counter(d for d, t, *_ in odd_rows if not re.search(r"[^\W\d_]", t or ""))
    assert language.predict_languages(documents(odd_rows).where("false")).count() == 0
    nothing = language.predict_languages(documents([(1, "text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_cross_parsing_is_greedy_longest_match():
    sample = {"x": ["abab cab abc bca", "caab"], "y": ["the cat sat", "dog"]}
    parser = language.CrossParser(sample)
    texts = ["abcabcab", "the dog cat", "", "zzz abz", "cab " * 200]
    counts, _ = parser.phrases(texts)
    for k, name in enumerate(parser.languages):
        reference = [s for p in sample[name] for s in [*parser.symbols.of(p).tolist(), 1]]
        runs = {tuple(reference[i:j]) for i in range(len(reference)) for j in range(i + 1, len(reference) + 1)}
        for text, got in zip(texts, counts[:, k]):
            symbols, phrases = parser.symbols.of(text).tolist(), 0
            for first in range(0, len(symbols), language.ROW):
                row, at = symbols[first : first + language.ROW], 0
                while at < len(row):
                    end = at + 1
                    while end < len(row) and tuple(row[at : end + 1]) in runs:
                        end += 1
                    at, phrases = end, phrases + 1
            assert got == phrases
    # the prediction is the language of the fewest bits a symbol, the score how far the second lies behind
    for text, answer in zip(texts, parser.predict(texts)):
        if not re.search(r"[^\W\d_]", text):
            assert answer == ("und", 0.0)
            continue
        size = max(len(parser.symbols.of(text)), 1)
        bits = [parser.phrases([text])[0][0, k] * math.log2(sum(len(parser.symbols.of(p)) + 1 for p in sample[name]) + 1) / size
                for k, name in enumerate(parser.languages)]
        assert answer[0] == parser.languages[int(np.argmin(bits))]
        assert answer[1] == pytest.approx(min(max(1 - min(bits) / max(bits), 0), 1))


# --- HTML ------------------------------------------------------------------------

def article_of(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h[1-6]|ul|li|div)\b[^>]*>", inner)
    import html

    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    rows = html_text.main_text(pages).collect()
    assert {r.page_id for r in rows} == set(want)
    assert np.mean([r.text == want[r.page_id] for r in rows]) > 0.97
    assert all(r.n_chars == len(r.text) for r in rows)


def test_held_out_layouts(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    extractor = html_text.Extractor(pages[:150])
    texts = [[n.text for n, k in zip(nodes, html_text.labels(nodes)) if k and n.text] for nodes in map(parse, pages[150:])]
    chance, exact = random.Random(5), []
    for i in range(100):
        page = html_text.layout(texts[i % len(texts)], texts, chance)
        nodes = parse(page)
        exact.append(extractor.texts([page])[0] == "\n".join(n.text for n, k in zip(nodes, html_text.labels(nodes)) if k and n.text))
    assert np.mean(exact) > 0.85


def test_decoding_never_keeps_inside_removed():
    nodes = parse("<body><nav><p>inside</p></nav><div><p>a</p><p>b</p></div></body>")
    chance = np.random.default_rng(1)
    for _ in range(50):
        scores = chance.normal(size=len(nodes)) * 3
        kept = html_text.decode(nodes, scores)
        assert all(not kept[i] or n.parent < 0 or kept[n.parent] for i, n in enumerate(nodes))


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>x</title><p>one<p>two", ["one", "two"]),
    ("<head><meta charset=u><script>no</script>bare text<p>two", ["bare text", "two"]),
    ("<html><head><title>t</title></head><p>one</html>", ["one"]),
    ("<head><noscript><link rel=x></noscript><style>no</style></head><body><p>one", ["one"]),
    ("<body><div><button>Menu</div><p>one</p><p>two</p></body>", ["Menu", "one", "two"]),
    ("<div><select><option>no</div><p>one</p></select><p>two</p>", ["one", "two"]),
    ("<div><button>no</button><p>one</p></div><button>no</button>", ["one"]),
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", ["a x=2 b"]),
    ("<noscript><p>plain</p></noscript><object data=x>fallback</object><canvas>drawn</canvas><video>clip</video>", ["plain", "fallbackdrawnclip"]),
    ("<svg viewBox='0 0 1 1'><text>label</text></svg><iframe><p>no</p></iframe><template><p>no</p></template><p>one", ["label", "one"]),
])
def test_no_text_is_lost_to_markup(page, want):
    assert [n.text for n in parse(page) if n.text] == want


def test_pages_without_body_tags_are_extracted(spark):
    """The same article with and without head and body tags gives the same text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(120).collect()]
    extractor = html_text.Extractor(pages[:100])
    for page in pages[100:]:
        bare = re.sub(r"</?body[^>]*>|</head>|</html>", "", page)
        assert bare != page and extractor.texts([bare]) == extractor.texts([page])


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a"), (3, "u", "<" * 50 + "<a href='x>" * 30), (4, "u", "plain  text &amp; more"),
            (5, "u", "<div>" * 3000 + "deep"), (3, "u", "<" * 50), (6, "u", "<article><p>" + "word " * 100_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = html_text.main_text(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, *_ in rows)
    assert {r.page_id: r.text for r in got}[1] == "" and all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(pages.where("false")).count() == 0
    assert features(parse("")).shape[0] == 1


# --- WARC ------------------------------------------------------------------------

def brute_records(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    result = Counter()
    for body, ids in groups.items():
        latest = max((i for i in ids if i is not None), default=None)
        for page in ids:
            revisit = len(body) >= 1000 and page != latest
            result[page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", latest if revisit else None] += 1
    return result


@pytest.fixture(scope="module")
def odd_pages(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "ü", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (None, None, None),
            (2, None, long), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "z" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'b' AS body", "'d' AS digest")


def test_archives_round_trip(spark, odd_pages):
    rows, df = odd_pages
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in warc.archives_round_trip(df).select(*columns).collect()) == brute_records(rows)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = Counter(tuple(r) for r in warc.archives_round_trip(pages).select(*columns).collect())
    assert got == brute_records([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert warc.archives_round_trip(pages.where("false")).count() == 0


def test_payloads_and_pushed_filters(spark, odd_pages):
    rows, df = odd_pages
    folder = shared_folder(spark)
    warc.write_archives(df, folder)
    payloads = Counter((r.page_id, bytes(r.payload)) for r in warc.read_archives(spark, folder).where("record_type = 'response'").collect())
    want = {(p, b) for p, _, h in rows for b in [(h or "").encode()]}
    assert set(payloads) <= want and warc.read_archives(spark, folder).count() == len(rows)
    filtered = warc.read_archives(spark, folder).where("record_type = 'revisit' AND page_id IN (1, 2, 8)")
    assert {r.page_id for r in filtered.collect()} == {1, 8}
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in (re.search(r"Filter \(.*", plan) or [""])[0]  # the reader took the filter
    reader = warc.WarcReader(folder, ["page_id", "record_type"])
    records = [r for split in reader.partitions() for r in reader.records(split)]
    assert len(records) == len(rows) and all(r["payload"] is None for r in records)


# --- Encoding --------------------------------------------------------------------

ODD_TEXTS = ["", "  ", " a", "a\n b", "a\nb\n\nc", "x <|endoftext|> y<|startoftext|>", "<|endoftext|", "İstanbul ΑΣ ΟΔΟΣ ß ǅ", "é ẛ̣ Å ﬁ", "don't 'S ''t we'll",
             "12345 ٣٤ ½", "\x1c\x1d a\x85b c", "日本語 한국어 👍🏽", "a" * 300 + " " + "ab" * 3000, "(x) y-z 'tis l'été ÷5 × 3", "été\nù  à"]


def test_word_bpe_equals_the_library(documents):
    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t, None, None) for i, t in enumerate([*ODD_TEXTS, None, "x " * 200_000])]
    want = {}
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want[i] = (ids, tokenizer.decode(ids, skip_special_tokens=False))
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.encode_texts(documents(rows), path).collect()}
    assert got == want
    digests = {r.doc_id: r for r in bpe.encode_digests(documents(rows), path).collect()}
    for i, (ids, decoded) in want.items():
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_digests(documents(rows).where("false"), path).count() == 0


def test_short_and_long_merging_agree():
    model = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    chance = random.Random(3)
    words = ["".join(chance.choice("aeinrst") for _ in range(chance.randint(1, 60))).encode() for _ in range(500)]
    assert model.merge_short(words) == [model.merge_long(w) for w in words]


def test_token_files(spark, documents, odd_rows, small_documents):
    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (documents([*[(100 + i, t, None, None) for i, t in enumerate(ODD_TEXTS)], *[r for r in odd_rows if r[0] not in (None, 10, 11)]]), small_documents):
        want, start = {}, 0
        for row in sorted(df.collect(), key=lambda r: r.doc_id):
            ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
            want[row.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.tokens_round_trip(df, path).collect()}
        assert got == want
    nulls = token_files.tokens_round_trip(documents(odd_rows), path)
    rows = sorted(nulls.collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    assert [r.doc_id for r in rows] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i or 0))
    one_id = documents([(None if i % 2 else 7, f"text number {i}", None, None) for i in range(60)])
    folder = shared_folder(spark)
    token_files.write_token_files(one_id, path, folder)
    assert token_files.read_token_files(spark, folder).count() == 60 and spark.read.orc(folder).select("part").distinct().count() > 2
    assert token_files.tokens_round_trip(small_documents.where("false"), path).count() == 0


def test_token_files_are_pruned_by_id(spark, small_documents):
    folder = shared_folder(spark)
    token_files.write_token_files(small_documents, vocabulary("byte_bpe_50k.json"), folder)
    one = token_files.read_token_files(spark, folder).where("doc_id = 7")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in plan and one.count() == 1


def test_borders_are_safe():
    encoder = token_files.Encoder(vocabulary("byte_bpe_50k.json"))
    chance = random.Random(5)
    texts = ["".join(chance.choice("ab'  \n\t.,-1é÷× \xa0日S") for _ in range(chance.randint(0, 30))) for _ in range(3000)]
    ids, lengths = encoder.encode(pa.array(texts))
    got = np.split(ids, np.cumsum(lengths)[:-1])
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert all(g.tolist() == e.ids for g, e in zip(got, tokenizer.encode_batch(texts, add_special_tokens=False)))


# --- Mixing ----------------------------------------------------------------------

def brute_targets(sizes):
    """Sources by code point, null last, to targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_sources, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_sources}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_sources -= over
    return target


@pytest.mark.parametrize("skewed", [False, True])
def test_mix_meets_targets(documents, skewed):
    chance = random.Random(8)
    rows = []
    for i in range(900):
        source = chance.choice(["a", "B", "é", None, "zz"]) if not skewed else chance.choice(["a"] * 8 + ["b", None])
        rows.append((i, "w " * chance.choice([0, 1, 5, 30, 80, 200]), None, source))
    docs = documents(rows)
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 200 for s in want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_rates_are_exponential_in_size(documents):
    rows = [(i, "w " * (1 + i % 50), None, "abc"[i % 3]) for i in range(300)]
    by_source = defaultdict(set)
    for r in mixing.mix(documents(rows)).collect():
        if r.rate < 2 and r.size:
            by_source[r.source].add(round(np.log(r.rate) / r.size, 9))
    assert by_source and all(len(v) == 1 for v in by_source.values())


def test_mix_of_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    assert mixing.mix(docs).count() == len(odd_rows)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(documents([(1, None, None, None), (2, "", None, "a")])).count() == 2
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in mixed.collect()).values()) <= 4  # two rows, two copies
