"""Ranked lexical search of all documents for every item of a query table.

Terms are runs of digits, letters of ASCII and all other characters above it, with A-Z lower-cased. A document's impact for
a term is w * ((1000000000 * tf) div (1000 * tf + 12 * m)) in whole numbers, its score for an item the sum of the impacts of the
item's terms, repeats included (the weights are in ``weights`` and ``lengths_ratio``).

Scores are dense block products. Items are taken in passes of at most ``PASS_ITEMS`` items and ``PASS_BYTES`` of text, one
after the other, so what is sent to the workers does not grow with the query table. A pass reads all documents once and
keeps of each the counts of the pass's terms. Its items form tiles of ``TILE_ITEMS``; a tile's distinct terms are its compact
vocabulary, cut into slices of ``TILE_TERMS`` columns. A slice of item counts (terms x items) is multiplied with the impacts of
``TILE_DOCS`` documents (documents x terms) in float64; a slice is closed before the sums that it can give reach 2^53, so
every product is exact in any order of summation, and slices are added in 64-bit integers.

Top k: a task keeps, for each item, the scores at least as high as its k-th best so far, ties included, and orders equal scores by
document id; the tasks' lists are merged in two steps, lots of tasks first.

Null texts have no term; null document ids come behind others of the same score; rows that repeat an id are documents of their own,
and so are rows of items, whose null ids stay null. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringlens.llm.store import cut_lineage
from ringlens.llm.words import Words, span_hashes, text_bytes, text_slices

TOP = 20
PASS_ITEMS = 4096
PASS_BYTES = 16 << 20
TILE_ITEMS = 64
TILE_TERMS = 4096
TILE_DOCS = 512
LOT_TASKS = 256
EXACT = 1 << 53
LARGEST_RATIO = 1_000_000  # (1000000000 * tf) div (1000 * tf + 12 * m) stays below it
LONG = 1 << 22  # bytes of a text counted at once

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


class Terms(Words):
    """Term positions of lower-cased texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self._find(_LOWER[data], offsets, _BETWEEN)


class Vocabulary:
    """Terms by two hashes, numbered in the order of the first."""

    def __init__(self, terms: list[bytes]) -> None:
        ends = np.cumsum([len(t) for t in terms])
        data = np.frombuffer(b"".join(terms), np.uint8)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        first, second = (span_hashes(data, starts, ends.astype(np.int64), salt) for salt in (0, 1))
        order = np.argsort(first)
        self.first, self.second = first[order], second[order]
        if (self.first[1:] == self.first[:-1]).any():
            raise ValueError("two terms share a 64-bit hash")
        self.number = {terms[i]: n for n, i in enumerate(order.tolist())}
        self.may_hold = np.zeros(1 << 20, dtype=bool)
        self.may_hold[self.first & np.uint64((1 << 20) - 1)] = True


def find_terms(words: Terms, first: np.ndarray, second: np.ndarray, may_hold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places among the words, their numbers) of the words that are terms of a vocabulary."""
    hashes = words.hashes()
    at = np.flatnonzero(may_hold[hashes & np.uint64((1 << 20) - 1)])
    numbers = np.minimum(np.searchsorted(first, hashes[at]), len(first) - 1)
    same = first[numbers] == hashes[at]
    at, numbers = at[same], numbers[same]
    same = second[numbers] == span_hashes(words.data, words.starts[at], words.ends[at], 1)
    return at[same], numbers[same]


def _stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first text) of a slice; one text longer than ``LONG`` comes in stretches that end between terms."""
    data, offsets = text_bytes(column)
    if len(offsets) != 2 or len(data) <= LONG:
        yield data, offsets, 0
        return
    start = 0
    while start < len(data):
        end = start + LONG
        while end < len(data) and not _BETWEEN[data[end]]:
            end += 1
        end = min(end, len(data))
        yield data[start:end], np.array([0, end - start]), 0
        start = end


def term_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (all terms of the document), terms (numbers), counts: one row per document that has a term."""
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary.first, vocabulary.second, vocabulary.may_hold))  # of one pass

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        size = max(len(known[0]), 1)
        for batch in text_slices(batches, "text"):
            n = np.zeros(batch.num_rows, dtype=np.int64)
            keys, counts = [], []
            for data, offsets, first in _stretches(batch.column("text")):
                words = Terms(data, offsets)
                n[first : first + len(offsets) - 1] += np.diff(words.first)
                if len(known[0]):
                    at, numbers = find_terms(words, *known)
                    own, times = np.unique((np.searchsorted(words.first, at, "right") - 1) * size + numbers, return_counts=True)
                    keys.append(own)
                    counts.append(times)
            keys, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, counts))
            keys, which = np.unique(keys, return_inverse=True)  # stretches of one text are added up
            counts = np.bincount(which, counts, minlength=len(keys)).astype(np.int64)
            places = np.searchsorted(keys, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            result = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(places), pa.array((keys % size).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(places), pa.array(counts))], names=["doc_id", "n", "terms", "counts"])
            yield result.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")) \
        .mapInArrow(of, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def weights(documents: int, holding: dict[int, int], size: int) -> np.ndarray:
    """The weight of every term number: floor(1000 * ln((2 N + 2) / (2 df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(size)], dtype=np.int64)


def lengths_ratio(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """m of each document."""
    return 100 - 25 + (25 * n * documents) // max(all_terms, 1)


class Slice(NamedTuple):
    """Columns of a tile: the column of each term number (-1: none), and the items' counts (terms x items)."""

    column: np.ndarray
    counts: np.ndarray


def tile_slices(items: list[Counter], weight: np.ndarray) -> list[Slice]:
    """The slices of a tile of items (term number -> repeats): no product reaches ``EXACT``."""
    left = sorted((t, i, n) for i, counts in enumerate(items) for t, n in counts.items())
    slices = []
    while left:
        column, counts = np.full(len(weight), -1, dtype=np.int32), []
        room, rest = [EXACT - 1] * len(items), []
        for t, i, n in left:
            fits = min(n, room[i] // max(int(weight[t]) * LARGEST_RATIO, 1))
            if column[t] < 0 and fits and len(counts) < TILE_TERMS:
                column[t] = len(counts)
                counts.append(np.zeros(len(items)))
            if column[t] >= 0 and fits:
                counts[column[t]][i] = fits
                room[i] -= fits * int(weight[t]) * LARGEST_RATIO
            else:
                fits = 0
            if fits < n:
                rest.append((t, i, n - fits))
        slices.append(Slice(column, np.array(counts)))
        left = rest
    return slices


class Best:
    """The best scores of each item of a tile."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.least = top, np.ones(items, dtype=np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4  # item, score, whether the id is null, id

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents x items."""
        doc, item = np.nonzero(scores >= self.least)
        kept = [np.concatenate(pair) for pair in zip(self.kept, (item, scores[doc, item], null[doc], ids[doc]))]
        order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
        kept = [k[order] for k in kept]
        begins = np.searchsorted(kept[0], np.arange(len(self.least)))
        place = np.arange(len(order)) - begins[kept[0]]
        last = place == self.top - 1
        self.least[kept[0][last]] = kept[1][last]
        self.kept = [k[place < self.top] for k in kept]


def _ranked_pass(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], totals: tuple[int, int] | None, top: int):
    """(item_id, rank, doc_id, score of the items; (documents, terms) of all documents)"""
    spark = docs.sparkSession
    vocabulary = Vocabulary(sorted({t for _, terms in items for t in terms}))
    counted = cut_lineage(term_counts(docs, vocabulary))
    if totals is None:
        row = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        totals = row[0], row[1]
    documents, all_terms = totals
    holding = {r.t: r.n for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    weight = weights(documents, holding, len(vocabulary.first))
    numbered = [Counter(vocabulary.number[t] for t in terms) for _, terms in items]
    tiles = [(first, numbered[first : first + TILE_ITEMS]) for first in range(0, len(numbered), TILE_ITEMS)]
    shipped = spark.sparkContext.broadcast(([(first, len(own), [tuple(x) for x in tile_slices(own, weight)]) for first, own in tiles],
                                             weight, [i for i, _ in items]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tiles, weight, item_ids = shipped.value
        best = [Best(size, top) for _, size, _ in tiles]
        for batch in batches:
            for first in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(first, TILE_DOCS)
                ids = part.column("doc_id")
                null, ids = ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy()
                terms, counts = part.column("terms"), part.column("counts").flatten().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
                terms = terms.flatten().to_numpy()
                m = lengths_ratio(part.column("n").to_numpy(), documents, all_terms)
                impact = weight[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m[doc]))
                for (_, size, slices), own in zip(tiles, best):
                    scores = np.zeros((part.num_rows, size), dtype=np.int64)
                    for column, item_counts in slices:
                        at = column[terms]
                        here = at >= 0
                        if here.any():
                            dense = np.zeros((part.num_rows, len(item_counts)))
                            dense[doc[here], at[here]] = impact[here]
                            scores += (dense @ item_counts).astype(np.int64)
                    own.add(scores, null, ids)
        lot = TaskContext.get().partitionId() // LOT_TASKS
        for (first, _, _), own in zip(tiles, best):
            item, score, null, ids = own.kept
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(item), lot)), pa.array(first + item), pa.array([item_ids[first + i] for i in item.tolist()], pa.int64()),
                 pa.array(ids, mask=null.astype(bool)), pa.array(score)], names=["lot", "item", "item_id", "doc_id", "score"])

    found = counted.mapInArrow(of, "lot bigint, item bigint, item_id bigint, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    lots = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "lot").orderBy(*order))).where(F.col("rank") <= top)
    merged = lots.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return merged.select("item_id", "rank", "doc_id", "score"), totals


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item."""
    results, waiting, size, totals = [], [], 0, None

    def settle() -> None:
        nonlocal waiting, size, totals
        found, totals = _ranked_pass(docs, waiting, totals, top)
        results.append(cut_lineage(found))
        waiting, size = [], 0

    for row in items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        terms = terms_of(row.text)
        if not terms:
            continue
        if waiting and (len(waiting) == PASS_ITEMS or size + len(row.text) > PASS_BYTES):
            settle()
        waiting.append((row.item_id, terms))
        size += len(row.text)
    if waiting:
        settle()
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.union, results)
