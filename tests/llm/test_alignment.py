"""Alignment of two vocabularies against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ringlens.llm import alignment
from ringlens.llm.alignment import Tokens, closed_groups, compose, fragment
from ringlens.llm.bpe import byte_characters
from ringlens.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def brute(rows):
    """The contract's columns by whole-text encoding and offsets one by one."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_characters())}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).encode().replace("▁".encode(), b" ")

    results, pairs = [], Counter()
    for doc_id, text, *_ in rows:
        groups, n_a, n_b = [], 0, 0
        if text:
            a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            a_parts, b_parts = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids], [piece(i) for i in b_ids]
            if b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
                n_a, n_b = len(a_ids), len(b_ids)
                j, at_a, at_b, own = 0, 0, 0, ([], [])
                for i, part in zip(a_ids, a_parts):
                    own[0].append(i)
                    at_a += len(part)
                    while at_b < at_a and at_b + len(b_parts[j]) <= at_a:
                        own[1].append(b_ids[j])
                        at_b += len(b_parts[j])
                        j += 1
                    if at_a == at_b:
                        groups.append(own)
                        own = ([], [])
        for x, y in groups:
            pairs[x[-1], y[-1]] += 1
        results.append((doc_id, n_a, n_b, groups))
    highest = {}
    for (_, y), n in pairs.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for doc_id, n_a, n_b, groups in results:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(pairs[k] == highest[k[1]] for k in links), sum(pairs[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return Counter(out), {(r[0], r[1]) for r in results}


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("long,chunk", [(1 << 16, 1 << 15), (300, 100)])
def test_odd_rows(documents, odd_rows, monkeypatch, long, chunk):
    """Also with chunks of 100 bytes, where nearly all texts are composed of fragments."""
    monkeypatch.setattr(alignment, "LONG", long)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    chance = random.Random(2)
    odd = ["  two  spaces\n\n\tand tabs ", "meta ▁ sign", "<s> </s> <unk> <|endoftext|> it's we'll", "漢字かな交じり文" * 60, "é" * 700, "\x00\x01 nul",
           "ﬁ ligature … “quotes” ½", "a", " ", "\n", "x" * 900, "🙂🙃 emoji👩‍👩‍👧", " " * 333 + "x", "don't" * 90,
           "".join(chance.choice("ab ,.'\n é漢") for _ in range(2000))]
    rows = odd_rows + [(100 + i, t, "en", "a") for i, t in enumerate(odd)]
    got = Counter(tuple(r) for r in alignment.alignment_digests(documents(rows), A, B).select(COLUMNS).collect())
    assert got == brute(rows)[0]


def test_groups_of_a_table(small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.collect()]
    df = alignment.aligned(small_documents, A, B)
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
                  for r in df.collect())
    assert got == brute(rows)[0]
    assert alignment.aligned(small_documents.where("false"), A, B).count() == 0


def test_composition_is_associative():
    """Any cutting of random token sequences, in any order of composition, gives the groups of the whole."""
    chance = random.Random(5)
    digits = alignment._digits(100)

    def cut_points(n, k):
        return sorted(chance.randint(0, n) for _ in range(k))

    for _ in range(200):
        size = chance.randint(1, 60)
        ends = [sorted({size, *(chance.randint(1, size) for _ in range(chance.randint(0, size)))}) for _ in range(2)]
        whole = Tokens(*(np.array(x, dtype=np.int64) for e in ends for x in ([chance.randrange(100) for _ in e], e)))
        cuts_a, cuts_b = ([0, *cut_points(len(e), 4), len(e)] for e in ends)
        pieces = [fragment(Tokens(whole.a_ids[a0:a1], whole.a_ends[a0:a1], whole.b_ids[b0:b1], whole.b_ends[b0:b1]))
                  for a0, a1, b0, b1 in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
        blocks = [c for _, c in pieces]
        parts = [f for f, _ in pieces]
        while len(parts) > 1:
            i = chance.randrange(len(parts) - 1)
            merged, closed = compose(parts[i], parts[i + 1])
            parts[i : i + 2] = [merged]
            blocks.append(closed)
        assert not len(parts[0].suffix.a_ids) and parts[0].has_end
        blocks = sorted((b for b in [*blocks, parts[0].prefix] if len(b.a_ids)), key=lambda b: b.a_ends[0])
        assert b"".join(closed_groups(b, digits).body for b in blocks) == closed_groups(whole, digits).body
