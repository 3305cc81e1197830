"""Near-duplicate groups by SimHash fingerprints.

A-Z become lower case, shingles are three consecutive words (a shorter text is one shingle, a text without
words has fingerprint zero), repeats count. A bit of the fingerprint is set if it is set in over half of the
shingles' XXH64 values (UTF-8, seed 42). Fingerprints link at three or fewer differing bits; a component's
id is the smallest document id in it.

Links are sought between distinct fingerprints, so exact copies cost nothing here. The 64 bits are split into
six blocks: three differing bits leave at least three blocks equal, so close pairs share one of the twenty
choices of three blocks (32 bits). Fingerprints are joined on those keys and verified by Hamming distance. A
bucket of more than ``BUCKET`` fingerprints (a cloud of near copies) is split further by the same rule applied to
the bits not yet fixed, which fixes half of them each time; within a small bucket a spanning forest is
kept, at most one link less than fingerprints, which connects exactly what all links connect.
Every distinct fingerprint is a node of its own, so documents that share an id, or have none, are linked by their
texts alone.

Null texts have fingerprint zero; null ids share their component's id but never give it one (null if no
document of the component has an id). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ringlens.llm.components import components
from ringlens.llm.exact_dedup import one_row_each
from ringlens.llm.store import cut_lineage
from ringlens.llm.words import text_slices

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
BUCKET = 64


def fingerprint(words: list[bytes]) -> int:
    """SimHash of a text's words as an unsigned 64-bit number."""
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(b"%b %b %b" % three, SEED) for three in zip(words, words[1:], words[2:])), np.uint64, len(words) - SHINGLE + 1)
    counts = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), 1 << 14):
        part = hashes[first : first + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the text), fp (the fingerprint's 64 bits as a signed long)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            values = [fingerprint((t or "").encode().lower().split()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sha"), pa.array(np.array(values, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "sha", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint"), text_sha(text).alias("sha"), text.alias("text")) \
        .mapInArrow(of, "doc_id bigint, sha string, fp bigint")


def text_sha(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _choices(mask: int) -> list[int]:
    """Every way of fixing all but three of the blocks that the bits outside ``mask`` form, as new masks."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = [sum(1 << int(b) for b in block) for block in np.array_split(free, min(BLOCKS, len(free)))]
    return [mask | sum(kept) for kept in itertools.combinations(blocks, max(0, len(blocks) - DISTANCE))]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, fp, mask) to (node, fp, mask, fixed) for each choice of blocks: ``fixed`` has the bits of fp that the mask keeps."""
    for batch in batches:
        nodes, prints, masks = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
        for mask in np.unique(masks):
            own = masks == mask
            for chosen in map(np.uint64, _choices(int(mask))):
                columns = nodes[own], prints[own], np.full(own.sum(), chosen), prints[own] & chosen
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["node", "fp", "mask", "fixed"])


def _stars(nodes: list[int], prints: list[int]) -> list[tuple[int, int]]:
    """Links from the smallest node to the others of each group that pairs at most DISTANCE bits apart connect."""
    v = np.array(prints, dtype=np.int64).view(np.uint64)
    close = np.bitwise_count(v[:, None] ^ v[None, :]) <= DISTANCE
    order = np.argsort(nodes)
    seen = np.zeros(len(v), dtype=bool)
    links = []
    for root in order.tolist():
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            fresh = np.flatnonzero(close[front].any(axis=0) & ~seen)
            seen[fresh] = True
            front = fresh.tolist()
            links.extend((nodes[root], nodes[i]) for i in front)
    return links


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of ``distinct`` (node, fp) that connect what all close pairs connect."""
    found: list[DataFrame] = []
    level = distinct.select("node", "fp", F.lit(0).cast("bigint").alias("mask"))
    free = 64  # bits that a bucket of this level may still differ in
    while True:
        keyed = level.mapInArrow(_expand, "node bigint, fp bigint, mask bigint, fixed bigint")
        if found:  # two masks of the level before may lead to the same one
            keyed = keyed.distinct()
        free = -(-free // BLOCKS) * DISTANCE if free > BLOCKS else min(free, DISTANCE)
        sizes = cut_lineage(keyed.groupBy("mask", "fixed").agg(F.count("*").alias("n")).where("n > 1"))
        keyed = cut_lineage(keyed.join(sizes, ["mask", "fixed"]))
        last = 2 ** free <= BUCKET
        found.append(_bucket_links(keyed if last else keyed.where(F.col("n") <= BUCKET)))
        level = keyed.where(F.col("n") > BUCKET).select("node", "fp", "mask")
        if last or level.isEmpty():
            return reduce(DataFrame.union, found)


def _bucket_links(keyed: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [link for members in batch.column(0).to_pylist()
                     for link in _stars([m["node"] for m in members], [m["fp"] for m in members])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    buckets = keyed.groupBy("mask", "fixed").agg(F.collect_list(F.struct("node", "fp")).alias("members"))
    return buckets.select("members").mapInArrow(of, "a bigint, b bigint")


def labelled_fingerprints(prints: DataFrame) -> DataFrame:
    """fp, label (the smallest fingerprint of its component), head: one row per distinct fingerprint.

    ``head`` is (no_id, doc_id, sha) of the fingerprint's document with the smallest id, and of its texts the smallest hash.
    """
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")).alias("head")
    nodes = cut_lineage(prints.groupBy("fp").agg(head))
    labels = components(near_links(nodes.select(F.col("fp").alias("node"), "fp")))  # nodes without links have no label
    return cut_lineage(nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label"), "head"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per document."""
    prints = cut_lineage(fingerprints(docs))
    nodes = labelled_fingerprints(prints.select("doc_id", F.lit("").alias("sha"), "fp"))
    ids = cut_lineage(nodes.groupBy("label").agg(F.min("head.doc_id").alias("component_id")))
    labelled = nodes.join(ids, "label").select("fp", "component_id")
    return prints.join(labelled, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest id (of its texts the smallest hash), with its columns, whatever these are called.

    Null counts as an empty text; a component without any id keeps one row too; an empty table stays empty.
    """
    heads = labelled_fingerprints(cut_lineage(fingerprints(docs))).groupBy("label").agg(F.min("head").alias("head"))
    stays = heads.select("head.doc_id", "head.sha")  # a text is in one component: no row twice
    return one_row_each(docs, stays, text_sha(F.col("text").cast("string")))
