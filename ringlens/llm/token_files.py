"""Token ids in ORC files.

Documents are dealt into ranges of ascending id and sorted; every range becomes one file of stripes, in which the
ids of a document are a list of integers under ORC's run-length encoding. Row indexes (every ``INDEX_ROWS`` rows) and
Bloom filters on the document id let a reader that filters on ids skip stripes and row groups by metadata alone, and the
stripes of a file can be read by different tasks. Each row also carries its range and its offset there; the start
of a document is that offset plus the totals of the ranges before, one number per file.

Texts are encoded with the tokenizers library. They are cut at borders where the vocabulary's pattern cuts in any
surroundings, and a stretch between two borders is encoded once per worker and remembered under a 128-bit hash.

Null texts count as empty (only the end id). Null ids come first; rows of one id stand in the order of a hash of their text. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ringlens.llm.store import shared_folder
from ringlens.llm.words import span_hashes, text_bytes, text_slices, worker_model

END_ID = 0
INDEX_ROWS = 1000
KEPT_STRETCHES = 1_500_000  # about 40 bytes each

_DDL = "part int, offset bigint, doc_id bigint, n_tokens bigint, ids array<int>"

# Kinds of bytes for the borders
_LETTER, _MARK, _SPACE, _FEED, _SOLID = 1, 2, 3, 4, 5
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = _SOLID
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = _MARK
_KIND[list(range(ord("A"), ord("Z") + 1)) + list(range(ord("a"), ord("z") + 1))] = _LETTER
_KIND[0x20], _KIND[0x0A], _KIND[0xC3] = _SPACE, _FEED, _SOLID


def borders(data: np.ndarray) -> np.ndarray:
    """Positions before which the vocabulary's pattern cuts whatever stands around: between an ASCII letter and a
    mark other than the apostrophe, before a single space, and on both sides of a single line feed.

    A space or feed counts only between two characters known to be neither white space nor part of it: visible ASCII
    and the accented letters under the lead byte C3.
    """
    kind = _KIND[data]
    kind[1:][data[:-1] == 0xC3] = _SOLID
    left, right = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = ((left == _LETTER) & (right == _MARK)) | ((left == _MARK) & (right == _LETTER))
    if len(data) > 2:
        visible = (kind == _LETTER) | (kind == _MARK) | (kind == _SOLID)
        between = visible[:-2] & visible[2:]
        middle = kind[1:-1]
        cut[1:-2] |= between & ((middle == _SPACE) | (middle == _FEED))
        cut[2:-1] |= between & (middle == _FEED)
    return cut


class Memory:
    """Ids of stretches, looked up by two 64-bit hashes: a large sorted part and a small one for what is new."""

    def __init__(self) -> None:
        self.ids = np.zeros(0, np.uint32)
        self.parts = [self._part(*np.zeros((4, 0), np.uint64)) for _ in range(2)]

    @staticmethod
    def _part(first, second, starts, counts):
        order = np.argsort(first)
        return first[order], second[order], starts.astype(np.int64)[order], counts.astype(np.int64)[order]

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``ids``, count) of each stretch; count -1 where it is not known."""
        starts, counts = np.zeros(len(first), np.int64), np.full(len(first), -1, np.int64)
        for keys, checks, places, sizes in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, first), len(keys) - 1)
                same = (keys[at] == first) & (checks[at] == second)
                starts[same], counts[same] = places[at[same]], sizes[at[same]]
        return starts, counts

    def add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids])
        large, small = self.parts
        small = self._part(*(np.concatenate(pair) for pair in zip(small, (first, second, starts, counts))))
        if len(small[0]) > max(1 << 16, len(large[0]) // 4):
            large, small = self._part(*(np.concatenate(pair) for pair in zip(large, small))), Memory().parts[1]
        self.parts = [large, small]

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)


class Encoder:
    """The tokenizer of one file with a memory of stretches."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = Memory()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)"""
        data, offsets = text_bytes(column)
        cut = borders(data)
        whole = data.tobytes()
        for special in map(str.encode, self.specials):
            at = whole.find(special)
            while at >= 0:  # special tokens are found before the pattern cuts: such a text stays in one piece
                text = int(np.searchsorted(offsets, at, "right")) - 1
                cut[offsets[text] + 1 : offsets[text + 1]] = False
                at = whole.find(special, int(offsets[text + 1]))
        cut[offsets] = True
        places = np.flatnonzero(cut)
        starts, ends = places[:-1], places[1:]
        first, second = (span_hashes(data, starts, ends, salt) for salt in (0, 1))
        unique, example, which = np.unique(first, return_index=True, return_inverse=True)
        if (second != second[example][which]).any():  # two stretches share a 64-bit hash
            plain = self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)
            ids = [np.array(e.ids, dtype=np.uint32) for e in plain]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(i) for i in ids], dtype=np.int64)
        if len(self.memory) + len(unique) > KEPT_STRETCHES:
            self.memory = Memory()
        own, counts = self.memory.find(unique, second[example])
        fresh = np.flatnonzero(counts < 0)
        if len(fresh):
            texts = [whole[a:b].decode() for a, b in zip(starts[example[fresh]].tolist(), ends[example[fresh]].tolist())]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            own[fresh] = len(self.memory.ids) + np.cumsum(sizes) - sizes
            counts[fresh] = sizes
            ids = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
            self.memory.add(unique[fresh], second[example[fresh]], ids, sizes)
        sizes = counts[which]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(own[which] - (upto - sizes), sizes) + np.arange(total)
        per_text = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)] if len(starts) else np.zeros(len(offsets), np.int64)
        return self.memory.ids[at], np.diff(per_text)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> None:
    """Encode whole texts, add the end id, and write ORC files in ascending order of doc_id."""
    spark = docs.sparkSession
    names = [c.split()[0] for c in _DDL.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_model("token_files", vocabulary, lambda: Encoder(vocabulary))
        part, offset = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, "text"):
            ids, lengths = encoder.encode(batch.column("text"))
            counts = lengths + 1
            ends = np.cumsum(counts)
            ids = np.insert(ids.astype(np.int32), np.cumsum(lengths), end_id)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part, np.int32)), pa.array(offset + ends - counts), batch.column("doc_id"),
                 pa.array(counts), lists], names=names)
            offset += int(ends[-1])

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id, or without any, are spread by their texts
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")) \
        .repartitionByRange(ranges, F.col("doc_id"), mark).sortWithinPartitions("doc_id", mark)
    writer = ordered.mapInArrow(of, _DDL).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01") \
        .option("orc.row.index.stride", str(INDEX_ROWS)).option("orc.create.index", "true")
    writer.orc(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: one row per document. A filter on doc_id is pushed down to the files."""
    rows = spark.read.schema(_DDL).orc(folder)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(starts), "part").select(  # one row per file
        "doc_id", (F.col("part_start") + F.col("offset")).alias("start"), "n_tokens", "ids")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of tables as ``read_token_files`` gives them."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(of, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    write_token_files(docs, vocabulary, folder)
    return token_digests(read_token_files(docs.sparkSession, folder))
