"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed greedily into the longest phrases that
occur in the language's text; the language that needs the fewest bits per character, phrases times
log2(length of its text) over the characters, wins (ties: the smaller name by code point).

Texts are read as symbols: letters in lower case, everything between letters as one space; letters that occur in no
labelled text share one symbol. For side-by-side parsing in numpy a text is laid out in rows of ``ROW`` symbols, and
phrases end with their row, which adds the same few phrases for every language.

Labelled text: of the documents with a language, ``DOCUMENTS`` per language by smallest hash, cut into pieces of
``PIECE`` characters. ``PIECES`` of them per language are kept, one of every document before a second of any, by
smallest hash, so a long document is no larger part of the fit than others. These bounds are the parameters of the fit;
predictions read every text whole.

``und`` with score 0 is the answer for null texts, texts without a letter, and when nothing could be learned. The score is one
minus the winner's bits over the second's, cut to [0, 1] (1 if only one language was learned). Null ids stay null and
are never learned from; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ringlens.llm.words import text_slices, worker_model

DOCUMENTS = 60
PIECE = 1500
PIECES = 24
ROW = 256
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, documents: int = DOCUMENTS, pieces: int = PIECES, piece: int = PIECE) -> dict[str, list[str]]:
    """Pieces of labelled text per language, chosen by hash: at most ``pieces`` for each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.where(~held_out(F.col("doc_id"))).select("doc_id", "lang").withColumn("rank", F.row_number().over(by_hash)) \
        .where(F.col("rank") <= documents).select("doc_id", "lang").distinct()
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most documents x languages rows
    cut = texts.select("doc_id", "lang", "text", F.explode(F.sequence(
        F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int"))).alias("part")).where("part >= 0") \
        .select("doc_id", "lang", "part", F.substring("text", F.col("part") * piece + 1, F.lit(piece)).alias("piece"))
    in_document = Window.partitionBy("lang", "doc_id").orderBy(F.xxhash64("doc_id", "part"), "part", "piece")
    by_piece = Window.partitionBy("lang").orderBy("turn", F.xxhash64("doc_id", "part"), "doc_id", "part", "piece")
    rows = cut.withColumn("turn", F.row_number().over(in_document)).where(F.col("turn") <= pieces) \
        .withColumn("rank", F.row_number().over(by_piece)).where(F.col("rank") <= pieces).collect()
    sample: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.rank)):
        sample.setdefault(row.lang, []).append(row.piece)
    return sample


class Symbols:
    """Symbols of characters: 0 padding, 1 space, 2 a letter never seen, then the letters learned from."""

    def __init__(self, texts: list[str]) -> None:
        letters = sorted({c for text in texts for c in text.lower() if LETTER.match(c)})
        self.size = 3 + len(letters)
        self.table = np.ones(0x110000, dtype=np.uint16)
        alphabet = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.table[[ord(m.group()) for m in LETTER.finditer(alphabet)]] = 2
        self.table[[ord(c) for c in letters]] = np.arange(3, self.size)

    def of(self, text: str) -> np.ndarray:
        symbols = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = symbols == 1
        space[1:] &= space[:-1].copy()
        if len(space):
            space[0] = symbols[0] == 1
        return symbols[~space]


def suffix_automaton(sequence: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and links of the smallest automaton that accepts every run of symbols of ``sequence``."""
    moves, links, longest, last = [{}], [-1], [0], 0
    for symbol in sequence:
        state = len(moves)
        moves.append({})
        links.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = links[at]
        if at >= 0:
            target = moves[at][symbol]
            if longest[at] + 1 == longest[target]:
                links[state] = target
            else:
                clone = len(moves)
                moves.append(dict(moves[target]))
                links.append(links[target])
                longest.append(longest[at] + 1)
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = clone
                    at = links[at]
                links[target] = links[state] = clone
        last = state
    return moves, links


class CrossParser:
    """Counts the phrases of texts against each language."""

    def __init__(self, sample: dict[str, list[str]]) -> None:
        self.languages = sorted(sample)
        self.symbols = Symbols([p for pieces in sample.values() for p in pieces])
        self.steps, self.bits = [], []
        for language in self.languages:
            sequence = [s for p in sample[language] for s in [*self.symbols.of(p).tolist(), 1]]
            self.steps.append(self._table(suffix_automaton(sequence)[0]))
            self.bits.append(math.log2(len(sequence) + 1))

    def _table(self, moves: list[dict[int, int]]) -> np.ndarray:
        """For each state and symbol: twice the next state, plus one where a phrase ends before the symbol.

        A symbol that starts no phrase is a phrase by itself; the padding symbol ends an open phrase.
        """
        table = np.full((len(moves), self.symbols.size), -1, dtype=np.int32)
        for state, row in enumerate(moves):
            if row:
                table[state, list(row)] = list(row.values())
        start = table[0].copy()
        restart = np.where(start < 0, 0, start)
        lone = start < 0
        result = np.where(table >= 0, table * 4, restart[None, :] * 4 + 1 + lone[None, :])
        result[0] = np.where(start >= 0, start * 4, 1)
        result[:, 0] = 1
        result[0, 0] = 0
        return np.ascontiguousarray(result, dtype=np.int32).reshape(-1)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per text and language, symbols per text)."""
        sequences = [self.symbols.of(t) for t in texts]
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        rows = -(-lengths // ROW)
        first = np.concatenate([[0], np.cumsum(rows)])
        grid = np.zeros((int(first[-1]), ROW + 1), dtype=np.uint16)
        flat = grid.reshape(-1)
        for i, sequence in enumerate(sequences):
            full = len(sequence) // ROW
            grid[first[i] : first[i] + full, :ROW] = sequence[: full * ROW].reshape(full, ROW)
            rest = len(sequence) - full * ROW
            if rest:
                at = (first[i] + full) * (ROW + 1)
                flat[at : at + rest] = sequence[full * ROW :]
        columns = np.ascontiguousarray(grid.T).astype(np.int64)
        result = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), rows)
        for k, table in enumerate(self.steps):
            state = np.zeros(grid.shape[0], dtype=np.int64)
            count = np.zeros(grid.shape[0], dtype=np.int64)
            for symbols in columns:
                move = table[state * self.symbols.size + symbols]
                count += move & 3
                state = (move >> 2).astype(np.int64)
            result[:, k] = np.bincount(owner, count, minlength=len(texts)).astype(np.int64)
        return result, lengths

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        answers = [(UNKNOWN, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        if not asked:
            return answers
        counts, lengths = self.phrases([texts[i] for i in asked])
        bits = counts * np.array(self.bits) / np.maximum(lengths, 1)[:, None]
        for i, row in zip(asked, bits):
            best = int(row.argmin())
            others = np.delete(row, best)
            score = 1.0 if not len(others) else (1 - row[best] / others.min() if others.min() > 0 else 0.0)
            answers[i] = (self.languages[best], float(min(max(score, 0.0), 1.0)))
        return answers


def predict_languages(docs: DataFrame, sample: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    parser = _shipped(docs, labelled_sample(docs) if sample is None else sample)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            answers = parser().predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")) \
        .mapInArrow(of, "doc_id bigint, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def drop_unknown_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with their columns, whatever these are called.

    Null and empty texts and texts without a letter go, repeated rows stay repeated, an empty table stays empty.
    """
    parser = _shipped(docs, labelled_sample(docs))
    place = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            answers = parser().predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array([a != UNKNOWN for a, _ in answers], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)


def _shipped(docs: DataFrame, sample: dict[str, list[str]]):
    """A function that gives the worker's parser."""
    name = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(sample)  # languages x PIECES x PIECE characters at most
    return lambda: worker_model("language", name, lambda: CrossParser(shipped.value))
