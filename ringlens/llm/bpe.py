"""BPE encoding and decoding of whole texts with a word-level vocabulary file.

The file fixes the steps before the merges: special tokens are cut out of the raw text; the rest is brought to
NFC, lower-cased character by character, and cut into words by the file's pattern (white space is dropped); a word's
UTF-8 bytes stand as one printable character each, the last one marked as the word's end.

Merging works on a contiguous array of adjacent ranks per short word: the symbols between part boundaries and
the rank of every adjacent pair. The array is scanned for its minimum (the leftmost wins), the boundary there is
deleted, and the ranks next to it are refreshed, until no pair has a rank. All words of a length class that are new to
the worker take these steps side by side as rows of one matrix. Words of more than ``SHORT`` bytes, where scanning
again and again would cost the square of the length, keep their pairs in a heap with the same order of merges.

Null counts as an empty text, which has no ids; null ids stay null; extra columns are ignored; an empty table gives
no rows. Truncation and padding are unused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ringlens.llm.words import text_slices, worker_model

SHORT = 64
KEPT_WORDS = 120_000  # words whose ids a worker remembers
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one above 255."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(printable)]
    places = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(places[b]) for b in range(256)]


class WordBpe:
    """The vocabulary of one file, ready to encode."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        letters = byte_characters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        self.merges = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges[(vocab[left], vocab[right])] = (rank, vocab[left + right])
        keys = np.array([(a << 32) | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.arange(len(keys), dtype=np.int32)[order]
        self.merged = np.array([m for _, m in self.merges.values()], dtype=np.int64)  # by rank
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols."""
        wanted = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of similar length, one matrix row each."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        parts = self.inner[raw]
        rows = np.arange(len(words))
        parts[rows, lengths - 1] = self.final[raw[rows, lengths - 1]]
        ranks = np.full((len(words), width), NO_RANK, dtype=np.int32)
        ranks[:, :-1] = np.where(np.arange(1, width) < lengths[:, None], self.adjacent(parts[:, :-1], parts[:, 1:]), NO_RANK)
        done: list = [None] * len(words)
        columns = np.arange(width - 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            lowest = ranks[here, at]
            open_rows = lowest != NO_RANK
            if not open_rows.all():
                for i in np.flatnonzero(~open_rows):
                    done[rows[i]] = parts[i, : lengths[i]].tolist()
                rows, parts, ranks, lengths = rows[open_rows], parts[open_rows], ranks[open_rows], lengths[open_rows]
                at, lowest, here = at[open_rows], lowest[open_rows], np.arange(len(rows))
                if not len(rows):
                    break
            parts[here, at] = self.merged[lowest]
            behind = columns > at[:, None]  # delete the boundary: what lies behind moves up
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            lengths -= 1
            right = at + 1 < lengths
            ranks[here, at] = NO_RANK
            i, j = here[right], at[right]
            ranks[i, j] = self.adjacent(parts[i, j], parts[i, j + 1])
            i, j = here[at > 0], at[at > 0]
            ranks[i, j - 1] = self.adjacent(parts[i, j - 1], parts[i, j])
        return done

    def merge_long(self, word: bytes) -> list[int]:
        raw = np.frombuffer(word, np.uint8)
        parts = [*self.inner[raw[:-1]].tolist(), int(self.final[raw[-1]])]
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        heap = [(self.merges[pair][0], i, *pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.merges[left, right][1], None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                pair = a >= 0 and b >= 0 and (parts[a], parts[b])
                if pair in self.merges:
                    heapq.heappush(heap, (self.merges[pair][0], a, *pair))
        return [p for p in parts if p is not None]

    def learn(self, words: set[str]) -> None:
        """Encode the words not known yet."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known, fresh = {}, list(words)
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for word in fresh:
            body = word.encode()
            classes.setdefault(min((len(body) + 3) // 4, SHORT // 4 + 1), []).append((word, body))
        for size, members in classes.items():
            for first in range(0, len(members), 8192):
                some = members[first : first + 8192]
                bodies = [b for _, b in some]
                ids = self.merge_short(bodies) if size <= SHORT // 4 else map(self.merge_long, bodies)
                for (word, _), own in zip(some, ids):
                    self.known[word] = self.both(own)

    def both(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, dtype="<u4").tobytes(), " ".join([self.names[i] for i in ids]).encode()

    def words(self, text: str) -> list[str]:
        """Words and special tokens of a text; special tokens come as one-element tuples."""
        pieces = [text] if not self.special_pattern or "<|" not in text else self.special_pattern.split(text)
        found: list = []
        for piece in pieces:
            if piece in self.specials:
                found.append((piece,))
            elif piece:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                found.extend(self.pattern.findall(piece.lower()))
        return found

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of each text."""
        per_text = [self.words(t) for t in texts]
        self.learn({w for words in per_text for w in words if type(w) is str})
        known = self.known
        special = {(t,): self.both([i]) for t, i in self.specials.items()}
        for words in per_text:
            pairs = [known[w] if type(w) is str else special[w] for w in words]
            yield b"".join([p[0] for p in pairs]), b" ".join([p[1] for p in pairs])


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string): one row per document."""
    return _encoded(docs, path, "doc_id bigint, ids binary, decoded string",
                    lambda ids, decoded: (ids, decoded.decode()), [pa.binary(), pa.string()])


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode_texts`` gives, as digests."""
    return _encoded(docs, path, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                    lambda ids, decoded: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()),
                    [pa.int64(), pa.string(), pa.string()])


def _encoded(docs: DataFrame, path: str, ddl: str, result, types: list[pa.DataType]) -> DataFrame:
    names = [column.split()[0] for column in ddl.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model("word_bpe", path, lambda: WordBpe(path))
        for batch in text_slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            columns = list(zip(*(result(*pair) for pair in model.encode(texts))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(of, ddl)
