"""Exact deduplication over an extendible-hash index.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
the largest id stays.

1. A first scan hashes every text to a 63-bit key. A histogram of the distinct keys' bytes builds the
   directory: it starts with one bucket, and every bucket above ``bucket_bytes`` is split by one more
   leading key bit; where its local depth passes the directory's, the directory doubles. The directory holds
   2^depth bucket numbers, about four entries per ``bucket_bytes`` of text.
2. A second scan merges the equal texts of each Arrow batch into one representative, looks its bucket up in
   the directory and sends the representatives' texts to the bucket's owner task, sorted by key. The owner
   chains the distinct texts that share a key and compares bytes. Other rows travel without text, spread by
   id, so a text held by a third of all rows costs its owner one row per batch.
3. The index (a row per representative: key, place in the chain, row that stays, group size) and the
   members (a row per document: its representative) lie in shared files and are joined on the
   representative, of which no batch has more than its own rows.

Null ids form rows like any others and lose against every other id; of equal ids the row read first stays.
Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ringlens.llm.store import cut_lineage, free_names

KEY_BITS = 63
BUCKET_BYTES = 64 << 20

_ROWS = ("slot int, key bigint, rep bigint, member boolean, row_key bigint, doc_id bigint, size bigint, largest bigint, "
         "winner bigint, sha string, body binary")
_INDEX = ("rep bigint, member boolean, row_key bigint, doc_id bigint, sha string, key bigint, chain int, size bigint, "
          "largest bigint, winner bigint")


def text_key(body: bytes, key_bits: int = KEY_BITS) -> int:
    return xxhash.xxh3_64_intdigest(body) >> (64 - key_bits)


def _record_batches(rows: list[tuple], ddl: str, chunk: int) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in ddl.split(", ")]
    for first in range(0, len(rows), chunk):
        columns = zip(*rows[first : first + chunk])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def build_directory(docs: DataFrame, key_bits: int = KEY_BITS, bucket_bytes: int = BUCKET_BYTES) -> np.ndarray:
    """The bucket of every value of the leading key bits: an array of 2^depth bucket numbers."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(t or "").encode().lower() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([text_key(b, key_bits) for b in bodies], pa.int64()), pa.array([len(b) for b in bodies], pa.int64())],
                names=["key", "bytes"])

    distinct = cut_lineage(docs.select(F.col("text").cast("string")).mapInArrow(keys, "key bigint, bytes bigint")
                           .groupBy("key").agg(F.max("bytes").alias("bytes")))
    total = distinct.agg(F.sum("bytes")).first()[0] or 0
    initial = min(key_bits, (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    fine = min(key_bits, initial + max(1, int(4 * total / bucket_bytes) >> initial).bit_length())
    while True:  # a few bins per bucket; finer while a bin of several keys is overfull
        prefix = F.shiftright("key", key_bits - fine).alias("prefix")
        bins = np.zeros(1 << fine, dtype=np.int64)
        several = np.zeros(1 << fine, dtype=bool)
        for row in distinct.groupBy(prefix).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).toLocalIterator():
            bins[row.prefix], several[row.prefix] = row.bytes, row.n > 1
        if fine >= key_bits or not ((bins > bucket_bytes) & several).any():
            break
        fine += 1
    return split_directory(bins, initial, bucket_bytes)


def split_directory(bins: np.ndarray, initial: int, bucket_bytes: int) -> np.ndarray:
    """The directory over 2^fine bins of leading key bits, from 2^initial buckets.

    A bucket is a range of bins; it is split while it is overfull, and the directory doubles to the deepest bucket. Bucket
    sizes are differences of one running sum, so the work grows with the buckets made.
    """
    fine = len(bins).bit_length() - 1
    upto = np.concatenate([[0], np.cumsum(bins)])
    depth, level, done = initial, np.arange(1 << initial, dtype=np.int64), []  # prefixes of the buckets of the present depth
    while len(level):
        width = fine - depth
        sizes = upto[(level + 1) << width] - upto[level << width]
        full = (sizes > bucket_bytes) & (depth < fine)
        done.append((level[~full], depth))
        level = np.sort(np.concatenate([level[full] * 2, level[full] * 2 + 1]))
        depth += bool(len(level))
    starts = np.concatenate([prefixes << (depth - own) for prefixes, own in done])
    spans = np.concatenate([np.full(len(prefixes), 1 << (depth - own)) for prefixes, own in done])
    order = np.argsort(starts)
    return np.repeat(np.arange(len(starts), dtype=np.int32), spans[order])


def index_texts(docs: DataFrame, key_bits: int = KEY_BITS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(index, members)``: a row per representative and a row per document."""
    directory = build_directory(docs, key_bits, bucket_bytes)
    depth = len(directory).bit_length() - 1
    slots = int(directory.max()) + 1
    shipped = docs.sparkSession.sparkContext.broadcast(directory)  # about four entries of 4 bytes per bucket_bytes of text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        directory = shipped.value
        part = TaskContext.get().partitionId()
        row_key = part << 36
        for batch in batches:
            groups: dict[bytes, list] = {}  # text -> representative, size, largest id, its row, digest
            rows = []
            for text, doc_id in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()):
                body = (text or "").encode().lower()
                group = groups.get(body)
                if group is None:
                    group = groups[body] = [row_key, 0, doc_id, row_key, hashlib.sha256(body).hexdigest()]
                group[1] += 1
                if doc_id is not None and (group[2] is None or doc_id > group[2]):
                    group[2], group[3] = doc_id, row_key
                slot = (part * 31 + row_key) % slots
                rows.append((slot, None, group[0], True, row_key, doc_id, None, None, None, group[4], None))
                row_key += 1
            for body, (rep, size, largest, winner, _) in groups.items():
                key = text_key(body, key_bits)
                slot = int(directory[key >> (key_bits - depth)])
                rows.append((slot, key, rep, False, None, None, size, largest, winner, None, body))
            yield from _record_batches(rows, _ROWS, 1000)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and key: memory holds the chain of one key."""
        current, chain, out = None, [], []

        def settle() -> None:
            for place, (_, reps, size, largest, winner) in enumerate(chain):
                out.extend((rep, False, None, None, None, current[1], place, size, largest, winner) for rep in reps)

        for batch in batches:
            bodies = batch.column("body")
            names = ("slot", "key", "rep", "member", "row_key", "doc_id", "size", "largest", "winner", "sha")
            for i, (slot, key, rep, member, row_key, doc_id, size, largest, winner, sha) in enumerate(
                    zip(*(batch.column(n).to_pylist() for n in names))):
                if member:
                    out.append((rep, True, row_key, doc_id, sha, None, None, None, None, None))
                    continue
                if (slot, key) != current:
                    settle()
                    current, chain = (slot, key), []
                body = bodies[i].as_py()
                entry = next((e for e in chain if e[0] == body), None)
                if entry is None:
                    chain.append([body, [rep], size, largest, winner])
                    continue
                entry[1].append(rep)
                entry[2] += size
                if largest is not None and (entry[3] is None or (largest, -winner) > (entry[3], -entry[4])):
                    entry[3], entry[4] = largest, winner
            yield from _record_batches(out, _INDEX, 5000)
            out.clear()
        settle()
        yield from _record_batches(out, _INDEX, 5000)

    written = cut_lineage(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scan, _ROWS)
        .repartition(slots, "slot").sortWithinPartitions("slot", "key", "rep").mapInArrow(own, _INDEX))
    index = written.where("NOT member").select("rep", "key", "chain", "size", "largest", "winner")
    return index, written.where("member").select("rep", "row_key", "doc_id", "sha")


def exact_groups(docs: DataFrame, key_bits: int = KEY_BITS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document."""
    index, members = index_texts(docs, key_bits, bucket_bytes)
    return members.join(index, "rep").select(
        "doc_id", F.col("largest").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row_key") == F.col("winner")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever these are called: one row per text.

    Null counts as an empty text, null ids lose against others, of repeated rows one stays; an empty table stays empty.
    """
    stays = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    return one_row_each(docs, stays, fingerprint=F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_row_each(docs: DataFrame, stays: DataFrame, fingerprint: Column) -> DataFrame:
    """One row of ``docs`` for each row (doc_id, sha) of ``stays``; among repeated rows any one stays.

    The join and the removal of repeated rows have one key, so the texts are shuffled once.
    """
    row, wanted = free_names(docs, "_row", "_wanted")

    def key(doc_id: Column, sha: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), sha)

    keys = stays.select(key(F.col("doc_id"), F.col("sha")).alias(wanted))
    keyed = docs.withColumn(row, key(F.col("doc_id"), fingerprint))
    return keyed.join(keys, F.col(row) == F.col(wanted)).dropDuplicates([row]).drop(row, wanted)
