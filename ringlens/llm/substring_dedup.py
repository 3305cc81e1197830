"""Removal of long passages that another document with a smaller id also has.

The graph: every run of ``WINDOW`` words is an edge of a De Bruijn graph. Edges are held in bulk: consecutive edges
of a document with the same minimizer (the smallest hash among the ``SEED``-word runs inside the edge) form one row,
a segment. Equal edges have equal minimizers, so equal passages meet on their minimizers, at about one row per
twenty words, and segments whose minimizer occurs in one document only are dropped first.

1. Segments of all documents: minimizer, hash of the segment's words, coordinates.
2. Segments with a minimizer of several documents are kept; equal ones are one variant with the coordinates of
   its source, the smallest document.
3. Nonbranching paths: two variants are compacted if in every document the second alone follows the first and
   only the first precedes the second. The junctions are found by joins over the variants; a path is an island of
   consecutive variants in its source's coordinates. A variant whose minimizer has other variants branches and stays a path by
   itself.
4. Source coordinates verify: an occurrence of a path counts only if a digest of its words, read at its own coordinates,
   equals the digest read at the source's. Every word of a verified path in a document after its source is covered.
5. Branching variants share edges that no whole segment shows: at their sources every edge is spelled out with a
   128-bit hash, and an edge with a smaller document is covered as well.

Windows are judged on the input. A third of all rows holding one passage costs one row per occurrence and segment; groups are
aggregated before the shuffle, and only tables keyed by document or minimizer are joined. Nothing is capped.

Null texts have no words. Rows of one id are told apart by a hash of their text and never remove from each other; rows with a
null id neither lose words nor remove any. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringlens.llm.store import cut_lineage
from ringlens.llm.words import RunHashes, Words, text_slices

WINDOW = 50
SEED = 12

_SEGMENT = "doc_id bigint, text_key bigint, first int, edges int, minimizer bigint, words_hash bigint"


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _running_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    low, span = values, 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return low


def segments(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Runs of consecutive edges with one minimizer: coordinates (first word, edges) and hashes."""
    names = [c.split()[0] for c in _SEGMENT.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = Words(batch.column("text"))
            count, owner = len(words.starts), words.text_of_words()
            if count < window:
                continue
            hashes = words.hashes()
            runs = RunHashes(hashes)
            at = np.arange(count - seed + 1)
            low = _running_minimum(runs.of(at, at + seed), window - seed + 1)
            edge = np.flatnonzero(np.arange(count - window + 1) + window <= words.first[1:][owner[: count - window + 1]])
            if not len(edge):
                continue
            cut = np.ones(len(edge), dtype=bool)
            cut[1:] = (low[edge[1:]] != low[edge[:-1]]) | (edge[1:] != edge[:-1] + 1) | (owner[edge[1:]] != owner[edge[:-1]])
            first = edge[cut]
            sizes = np.diff(np.append(np.flatnonzero(cut), len(edge)))
            texts = owner[first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(texts)), batch.column("text_key").take(pa.array(texts)),
                 pa.array((first - words.first[texts]).astype(np.int32)), pa.array(sizes.astype(np.int32)),
                 pa.array(low[first].view(np.int64)), pa.array(runs.of(first, first + sizes + window - 1).view(np.int64))], names=names)

    return _rows(docs).where("doc_id IS NOT NULL").mapInArrow(of, _SEGMENT)


def repeated_segments(found: DataFrame) -> DataFrame:
    """The segments whose minimizer occurs in several documents."""
    several = found.groupBy("minimizer").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # a stored table: both sides of the join are then plain exchanges, whose hot partitions Spark can split
    several = cut_lineage(several.select("minimizer"))
    return found.join(several, "minimizer").distinct()  # repeated rows of one text count once


def variants(repeated: DataFrame) -> DataFrame:
    """Equal segments as one row: source coordinates, whether the minimizer has other variants."""
    own = repeated.groupBy("minimizer", "words_hash").agg(
        F.min(F.struct("doc_id", "text_key", "first")).alias("source"), F.first("edges").alias("edges"), F.max("doc_id").alias("last_doc"))
    own = cut_lineage(own)
    branching = own.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer", F.lit(True).alias("branching"))
    return own.join(branching, "minimizer", "left").withColumn("branching", F.coalesce("branching", F.lit(False)))


def compacted_paths(repeated: DataFrame, own: DataFrame) -> DataFrame:
    """(minimizer, words_hash, path_doc, path_text, path_first, inset): each variant's path and place in it.

    A path is named by its first word's coordinates in the source; ``inset`` is the variant's distance from there.
    """
    in_text = Window.partitionBy("doc_id", "text_key").orderBy("first")
    follows = F.lead("first").over(in_text) == F.col("first") + F.col("edges")
    steps = repeated.withColumn("next", F.when(follows, F.lead("words_hash").over(in_text)))
    pairs = steps.groupBy("words_hash", "next").agg(F.count("*").alias("n"))  # a null next is an end, which branches
    onward = pairs.groupBy("words_hash").agg(F.count("*").alias("ways"), F.max("next").alias("next")).where("ways = 1 AND next IS NOT NULL")
    back = steps.withColumn("before", F.when(F.lag(F.col("first") + F.col("edges")).over(in_text) == F.col("first"),
                                             F.lag("words_hash").over(in_text))) \
        .groupBy("words_hash", "before").agg(F.count("*").alias("n")) \
        .groupBy("words_hash").agg(F.count("*").alias("ways"), F.max("before").alias("before")).where("ways = 1 AND before IS NOT NULL")
    plain = own.where("NOT branching").select("words_hash")
    # the second of a junction: it goes on from the variant before it
    joined = back.join(onward.select(F.col("words_hash").alias("before"), F.col("next").alias("words_hash")), ["before", "words_hash"]) \
        .join(plain, "words_hash", "left_semi").join(plain.select(F.col("words_hash").alias("before")), "before", "left_semi") \
        .select("words_hash", F.lit(True).alias("continues"))
    by_source = Window.partitionBy("source.doc_id", "source.text_key").orderBy("source.first")
    begins = F.when(F.col("continues").isNull(), F.col("source.first"))
    return own.join(joined, "words_hash", "left").withColumn("path_first", F.max(begins).over(by_source)).select(
        "minimizer", "words_hash", "branching", "edges", F.col("source.doc_id").alias("path_doc"), F.col("source.text_key").alias("path_text"),
        "path_first", (F.col("source.first") - F.col("path_first")).alias("inset"))


def repeated_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, first, words): verified spans of words to remove; spans may overlap."""
    repeated = cut_lineage(repeated_segments(cut_lineage(segments(docs, window, seed))))
    own = cut_lineage(variants(repeated))
    paths = cut_lineage(compacted_paths(repeated, own))
    # occurrences of whole paths: segments that lie one after the other with rising inset
    placed = repeated.select("doc_id", "text_key", "first", "minimizer", "words_hash").join(paths, ["minimizer", "words_hash"])
    spans = placed.groupBy("doc_id", "text_key", "path_doc", "path_text", "path_first", (F.col("first") - F.col("inset")).alias("begin")).agg(
        (F.sum("edges") + (window - 1)).cast("int").alias("words"), F.min("first").alias("first"), F.max("branching").alias("branching"))
    spans = spans.where("doc_id > path_doc OR (first = path_first AND doc_id = path_doc AND text_key = path_text) OR branching")
    # per document: what to read there
    wanted = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(
        "first", "words", "path_doc", "path_text", "path_first", "branching")).alias("spans"))
    readings = cut_lineage(_read(docs, wanted, window))
    digests = readings.where("kind = 'path'")
    # the occurrences of a path in all documents; its source is one of them
    source = cut_lineage(digests.where("doc_id = path_doc AND text_key = path_text AND first = path_first")
                         .select("path_doc", "path_text", "path_first", "words", "digest").distinct())
    verified = digests.where("doc_id > path_doc").join(source, ["path_doc", "path_text", "path_first", "words", "digest"]) \
        .select("doc_id", "text_key", "first", "words")
    edges = readings.where("kind = 'edge'")
    earliest = edges.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    earliest = cut_lineage(earliest.select("digest", "low"))
    covered = edges.join(earliest, "digest").where("doc_id > low").select("doc_id", "text_key", "first", "words")
    return cut_lineage(verified.union(covered))


def _read(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Digests of the wanted spans at their coordinates, and every edge of branching spans at their source."""
    ddl = ("doc_id bigint, text_key bigint, first int, words int, path_doc bigint, path_text bigint, path_first int, "
           "kind string, digest binary")
    names = [c.split()[0] for c in ddl.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
    texts = _rows(docs).join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = Words(batch.column("text"))
            hashes = words.hashes()
            runs = RunHashes(hashes), RunHashes(hashes, second=True)
            rows = []
            for i, (doc_id, text_key, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "spans")))):
                body = None
                for span in spans:
                    first, count, place = span["first"], span["words"], (span["path_doc"], span["path_text"], span["path_first"])
                    if doc_id > span["path_doc"] or not span["branching"]:
                        body = body or batch.column("text")[i].as_py().encode().split()
                        digest = hashlib.blake2b(b" ".join(body[first : first + count]), digest_size=16).digest()
                        rows.append((doc_id, text_key, first, count, *place, "path", digest))
                        continue
                    if (doc_id, text_key, first) == place:  # so that occurrences elsewhere find their source
                        body = body or batch.column("text")[i].as_py().encode().split()
                        digest = hashlib.blake2b(b" ".join(body[first : first + count]), digest_size=16).digest()
                        rows.append((doc_id, text_key, first, count, *place, "path", digest))
                    begin = words.first[i] + first + np.arange(count - window + 1)
                    pairs = np.stack([r.of(begin, begin + window) for r in runs], axis=1)
                    rows.extend((doc_id, text_key, first + k, window, *place, "edge", pair.tobytes()) for k, pair in enumerate(pairs))
            for start in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[start : start + 10_000]), types)], names=names)

    return texts.mapInArrow(of, ddl)


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space): one row per document."""
    return _without(docs, repeated_passages(docs, window, seed), "kept_text string", lambda kept: kept.decode())


def removal_digests(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept text): one row per document."""
    return _without(docs, repeated_passages(docs, window, seed), "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _without(docs: DataFrame, spans: DataFrame, column: str, result) -> DataFrame:
    merged = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "words")).alias("spans"))
    rows = _rows(docs).join(merged, ["doc_id", "text_key"], "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            counts, removed, kept = [], [], []
            for text, spans_of in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                stays = np.ones(len(words), dtype=bool)
                for span in spans_of or ():
                    stays[span["first"] : span["first"] + span["words"]] = False
                counts.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                kept.append(result(b" ".join([w for w, s in zip(words, stays) if s] if removed[-1] else words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", column.split()[0]])

    return rows.mapInArrow(of, f"doc_id bigint, n_words bigint, n_removed bigint, {column}")
