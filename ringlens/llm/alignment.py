"""Alignment of the tokens of two vocabularies over the same bytes.

A text, with one space before it, is encoded by a byte-level BPE file (A) and by a sentence-piece model (B). Byte offsets at
which tokens of both end cut the two token sequences into groups; a link is a pair of an A and a B token that end together,
one for each group.

Fragments: the alignment of a byte range is (open prefix, closed groups, open suffix). The prefix holds the tokens up to
the first common end, since the group that ends there may have begun before the range; the suffix holds those after the last
one; a range without a common end is all prefix. Two neighbours compose by aligning the left suffix (or all of the left)
with the right prefix, which closes the groups between; the operation is associative and a document's alignment is
the product of its fragments. A document of at most ``LONG`` bytes is one fragment. A longer one is cut every ``CHUNK`` bytes,
for each vocabulary at its next border that is safe in any surroundings; the chunks are dealt out, aligned
by themselves, and composed by a tree of ``FAN`` fragments per node, a shuffle for each level of the tree. Closed groups are
written where they close and do not travel up the tree.

Counts: two tokens that end together are such that one is a suffix of the other, so the pairs that can be linked at all
follow from the vocabularies (``Sides.pairs``, some hundred thousand, whatever the corpus); the links of all documents are
counted by pair, and that table is small enough to be sent to every worker.

Null and empty texts, and texts whose joined tokens of A or B differ from space and text (in this model those with U+2581), have
no tokens: zeros and an empty string. Null ids stay null, repeated rows are documents of their own, extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ringlens.llm.bpe import byte_characters
from ringlens.llm.store import cut_lineage
from ringlens.llm.token_files import Memory, borders
from ringlens.llm.words import span_hashes, text_bytes, text_slices, worker_model

LONG = 1 << 16  # bytes of the longest text that is one fragment
CHUNK = 1 << 15
FAN = 8
KEPT_STRETCHES = 700_000
KEPT_IDS = 8_000_000
SLICE = 1 << 20

_META = "▁".encode()  # stands for a space in B's pieces
_DOCS = "tally boolean, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<int>, links array<bigint>"
_OPEN = "a_ids array<int>, a_ends array<bigint>, b_ids array<int>, b_ends array<bigint>"
_PARTS = (f"row bigint, part bigint, closed boolean, n_a bigint, n_b bigint, wrong boolean, at bigint, n_groups bigint, groups binary, "
          f"pairs array<int>, links array<bigint>, has_end boolean, prefix struct<{_OPEN.replace(' ', ':').replace(',:', ',')}>, "
          f"suffix struct<{_OPEN.replace(' ', ':').replace(',:', ',')}>")


class Tokens(NamedTuple):
    """Tokens of both sides over one stretch of bytes: ids and the offsets where they end."""

    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(pair) for pair in zip(self, other)))

    def row(self) -> dict:
        return {name: column.tolist() for name, column in zip(self._fields, self)}

    @staticmethod
    def of(row: dict) -> Tokens:
        return Tokens(*(np.array(row[name], dtype=np.int64) for name in Tokens._fields))


NOTHING = Tokens(*[np.zeros(0, np.int64)] * 4)


def common_ends(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B whether one of the other side ends with it; a stretch's offsets are close together."""
    if not len(t.a_ends) or not len(t.b_ends):
        return np.zeros(len(t.a_ends), bool), np.zeros(len(t.b_ends), bool)
    base = min(t.a_ends[0], t.b_ends[0])
    flags = np.zeros((2, int(max(t.a_ends[-1], t.b_ends[-1]) - base) + 1), dtype=bool)
    flags[0, t.a_ends - base] = flags[1, t.b_ends - base] = True
    return flags[1, t.a_ends - base], flags[0, t.b_ends - base]


class Groups(NamedTuple):
    """Closed groups: their text (a ; behind each), where the text of each merged token ends in it, and the links."""

    body: bytes
    token_ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _digits(count: int) -> np.ndarray:
    """Row i holds the decimal digits of i, zero bytes before them, and one free place behind them."""
    width = len(str(max(count - 1, 0)))
    table = np.zeros((count, width + 1), dtype=np.uint8)
    values = np.arange(count)
    for place in range(width):
        shown = values >= 10**place if place else values >= 0
        table[shown, width - 1 - place] = (values[shown] // 10**place) % 10 + ord("0")
    return table


def closed_groups(t: Tokens, digits: np.ndarray) -> Groups:
    """The groups of tokens whose last A and last B token end together."""
    common_a, common_b = common_ends(t)
    last_a, last_b = np.flatnonzero(common_a), np.flatnonzero(common_b)
    group_a, group_b = (np.cumsum(c) - c for c in (common_a, common_b))
    first_b = np.concatenate([[0], last_b + 1])
    # the merged order: A's tokens of a group, then B's
    place_a = np.arange(len(t.a_ids)) + first_b[group_a]
    place_b = np.arange(len(t.b_ids)) + (last_a + 1)[group_b] if len(last_a) else np.zeros(0, np.int64)
    total = len(t.a_ids) + len(t.b_ids)
    ids, marks = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[place_a], ids[place_b] = t.a_ids, t.b_ids
    marks[place_a[common_a]], marks[place_b[common_b]] = ord("|"), ord(";")
    cells = digits[ids]
    cells[:, -1] = marks
    filled = cells != 0
    return Groups(cells[filled].tobytes(), np.cumsum(filled.sum(axis=1)), t.a_ids[last_a], t.b_ids[last_b])


class Fragment(NamedTuple):
    """Alignment of a byte range without its closed groups: where ``has_end`` is false all tokens are in the prefix."""

    has_end: bool
    prefix: Tokens
    suffix: Tokens


def fragment(t: Tokens) -> tuple[Fragment, Tokens]:
    """The fragment of a range's tokens, and the tokens of its closed groups."""
    common_a, common_b = common_ends(t)
    if not common_a.any():
        return Fragment(False, t, NOTHING), NOTHING
    at_a, at_b = np.flatnonzero(common_a), np.flatnonzero(common_b)

    def part(a: slice, b: slice) -> Tokens:
        return Tokens(t.a_ids[a], t.a_ends[a], t.b_ids[b], t.b_ends[b])

    (first_a, end_a), (first_b, end_b) = ((at[0] + 1, at[-1] + 1) for at in (at_a, at_b))
    return (Fragment(True, part(slice(first_a), slice(first_b)), part(slice(end_a, None), slice(end_b, None))),
            part(slice(first_a, end_a), slice(first_b, end_b)))


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Tokens]:
    """The fragment of two neighbouring ranges, and the tokens of the groups that close between them."""
    middle, closed = fragment((left.suffix if left.has_end else left.prefix) + right.prefix)
    if not middle.has_end:
        return (Fragment(True, left.prefix, middle.prefix) if left.has_end else middle), NOTHING
    if left.has_end:
        closed, prefix = middle.prefix + closed, left.prefix
    else:
        prefix = middle.prefix
    return Fragment(True, prefix, right.suffix if right.has_end else middle.suffix), closed


class Encoder:
    """Ids of texts by one tokenizer; a stretch between two safe cuts is encoded once per worker."""

    def __init__(self, encode, cuts, token_bytes: list[bytes]) -> None:
        self.encode_strings, self.cuts, self.token_bytes = encode, cuts, token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], dtype=np.int64)
        self.memory, self.wrong = Memory(), np.zeros(0, np.uint64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text, texts whose tokens do not join to their bytes)"""
        cut = self.cuts(data)
        cut[offsets] = True
        places = np.flatnonzero(cut)
        starts, ends = places[:-1], places[1:]
        first, second = (span_hashes(data, starts, ends, salt) for salt in (0, 1))
        unique, example, which = np.unique(first, return_index=True, return_inverse=True)
        if (second != second[example][which]).any():
            raise RuntimeError("two stretches of a slice share a 64-bit hash")
        if len(self.memory) + len(unique) > KEPT_STRETCHES or len(self.memory.ids) > KEPT_IDS:
            self.memory, self.wrong = Memory(), np.zeros(0, np.uint64)
        own, counts = self.memory.find(unique, second[example])
        fresh = np.flatnonzero(counts < 0)
        if len(fresh):
            whole = data.tobytes()
            bodies = [whole[a:b] for a, b in zip(starts[example[fresh]].tolist(), ends[example[fresh]].tolist())]
            encoded = self.encode_strings([b.decode() for b in bodies])
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            own[fresh] = len(self.memory.ids) + np.cumsum(sizes) - sizes
            counts[fresh] = sizes
            ids = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
            joined = [b"".join([self.token_bytes[i] for i in e]) for e in encoded]
            differ = [j != b for j, b in zip(joined, bodies)]
            self.wrong = np.concatenate([self.wrong, unique[fresh][differ]])
            self.memory.add(unique[fresh], second[example[fresh]], ids, sizes)
        sizes = counts[which]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(own[which] - (upto - sizes), sizes) + np.arange(total)
        text_of = np.searchsorted(starts, offsets)
        per_text = np.concatenate([[0], upto])[text_of]
        wrong = np.zeros(len(offsets) - 1, bool)
        if len(self.wrong):
            bad = np.flatnonzero(np.isin(first, self.wrong))
            wrong[np.searchsorted(offsets, starts[bad], "right") - 1] = True
        return self.memory.ids[at].astype(np.int64), np.diff(per_text), wrong


def piece_cuts(data: np.ndarray) -> np.ndarray:
    """Before a space behind another byte: no piece of the model goes on behind a space that follows something else."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    space = data == 0x20
    cut[1:-1] = space[1:] & ~space[:-1]
    return cut


class Sides:
    """Both vocabularies, and the pairs of ids that can end together."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as file:
            names = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        a_bytes = [b""] * a.get_vocab_size()
        for name, i in names.items():
            a_bytes[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else b""
        b = SentencePieceProcessor(model_file=b_path)
        b_bytes = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i)
                   else b.id_to_piece(i).encode().replace(_META, b" ") for i in range(b.get_piece_size())]
        if any(b" " in x.lstrip(b" ") for x in b_bytes):
            raise ValueError("a piece holds a space behind another character: words cannot be encoded by themselves")
        self.a = Encoder(lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)], borders, a_bytes)
        space = [b.piece_to_id("▁")]  # the model adds a space before every text but the empty one
        self.b = Encoder(lambda texts: [e or space for e in b.encode([t[1:] for t in texts], num_threads=1)], piece_cuts, b_bytes)
        self.pairs = self._pairs(a_bytes, b_bytes)
        self.digits = _digits(max(len(a_bytes), len(b_bytes)))

    @staticmethod
    def _pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
        """Sorted a << 32 | b of all ids of which one's bytes end with the other's: at most one per suffix and spelling."""
        found = set()
        by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
        for known, side in zip(by_bytes, (a_bytes, b_bytes)):
            for i, body in enumerate(side):
                if body:
                    known.setdefault(body, []).append(i)
        for k, side in enumerate((a_bytes, b_bytes)):
            other = by_bytes[1 - k]
            for i, body in enumerate(side):
                for first in range(len(body)):
                    for j in other.get(body[first:], ()):
                        found.add((i << 32 | j) if k == 0 else (j << 32 | i))
        return np.array(sorted(found), dtype=np.int64)

    def pair_numbers(self, link_a: np.ndarray, link_b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, link_a << np.int64(32) | link_b)

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens with ends counted over all texts, ids of A per text, ids of B per text, texts that do not join)"""
        a_ids, n_a, a_wrong = self.a.encode(data, offsets)
        b_ids, n_b, b_wrong = self.b.encode(data, offsets)
        return (Tokens(a_ids, np.cumsum(self.a.lengths[a_ids]), b_ids, np.cumsum(self.b.lengths[b_ids])), n_a, n_b, a_wrong | b_wrong)


def _sides(a_path: str, b_path: str) -> Sides:
    return worker_model("alignment", f"{a_path}\n{b_path}", lambda: Sides(a_path, b_path))


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with a space before each; null, empty and U+2581 give no bytes."""
    data, offsets = text_bytes(column)
    whole = data.tobytes()
    plain = np.ones(len(offsets) - 1, dtype=bool)
    at = whole.find(_META)
    while at >= 0:
        text = int(np.searchsorted(offsets, at, "right")) - 1
        plain[text] = False
        at = whole.find(_META, int(offsets[text + 1]))
    lengths = np.where(plain, np.diff(offsets), 0)
    some = lengths > 0
    ends = np.concatenate([[0], np.cumsum(lengths + some)])
    spaced = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    filled = np.ones(len(spaced), dtype=bool)
    filled[ends[:-1][some]] = False
    spaced[filled] = data[np.repeat(plain, np.diff(offsets))]
    return spaced, ends


def _joined_pairs(pairs: np.ndarray, owner: np.ndarray, owners: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, links, first place of each owner) with the links of one owner and pair counted."""
    keys, links = np.unique(owner * size + pairs, return_counts=True)
    return keys % size, links, np.searchsorted(keys, np.arange(owners + 1) * size)


def _lists(values: np.ndarray, places: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(values, kind))


def _short(docs: DataFrame, a_path: str, b_path: str, digest: bool) -> DataFrame:
    """A row per document, and a tally of its pairs for each task."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, b_path)
        tally = np.zeros(len(sides.pairs), dtype=np.int64)
        names = [c.split()[0] for c in _DOCS.split(", ")]
        for batch in text_slices(batches, "text", SLICE):
            data, offsets = _spaced(batch.column("text"))
            t, n_a, n_b, wrong = sides.tokens(data, offsets)
            if wrong.any():  # such texts count as empty
                keep_a, keep_b = np.repeat(~wrong, n_a), np.repeat(~wrong, n_b)
                n_a, n_b = np.where(wrong, 0, n_a), np.where(wrong, 0, n_b)
                a_ids, b_ids = t.a_ids[keep_a], t.b_ids[keep_b]
                t = Tokens(a_ids, np.cumsum(sides.a.lengths[a_ids]), b_ids, np.cumsum(sides.b.lengths[b_ids]))
            groups = closed_groups(t, sides.digits)
            ends = np.concatenate([[0], groups.token_ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
            bodies = [groups.body[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1], ends[1:])]
            a_of_link = np.flatnonzero(common_ends(t)[0])
            owner = np.searchsorted(np.cumsum(n_a), a_of_link, "right")
            pairs, links, places = _joined_pairs(sides.pair_numbers(groups.link_a, groups.link_b), owner, len(n_a), len(tally))
            np.add.at(tally, pairs, links)
            shown = [hashlib.sha256(b).hexdigest() if b else "" for b in bodies] if digest else [b.decode() for b in bodies]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n_a), bool)), batch.column("doc_id"), pa.array(n_a), pa.array(n_b),
                 pa.array(np.bincount(owner, minlength=len(n_a))), pa.array(shown, pa.string()),
                 _lists(pairs, places, pa.int32()), _lists(links, places, pa.int64())], names=names)
        used = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays(
            [pa.array([True]), *[pa.array([None], pa.int64())] * 4, pa.array([None], pa.string()),
             _lists(used, np.array([0, len(used)]), pa.int32()), _lists(tally[used], np.array([0, len(used)]), pa.int64())], names=names)

    return docs.mapInArrow(of, _DOCS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of long texts: every ``chunk`` bytes, for each side from its next safe border to the one after."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        for i in range(batch.num_rows):
            data, _ = _spaced(batch.column("text").slice(i, 1))
            nominal = np.arange(CHUNK, len(data), CHUNK)
            cuts = []
            for borders_of in (borders, piece_cuts):
                places = np.append(np.flatnonzero(borders_of(data)), len(data))
                cuts.append(np.concatenate([[0], places[np.searchsorted(places, nominal)], [len(data)]]))
            for part in range(len(nominal) + 1):
                (a0, a1), (b0, b1) = ((int(c[part]), int(c[part + 1])) for c in cuts)
                lists = [[row + i], [batch.column("doc_id")[i].as_py()], [part], [a0], [data[a0:a1].tobytes()], [b0], [data[b0:b1].tobytes()]]
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(lists, kinds)],
                                                 names=["row", "doc_id", "part", "a_from", "a_body", "b_from", "b_body"])
        row += batch.num_rows


def _part_rows(rows: list[dict]) -> pa.RecordBatch:
    def kind(text: str) -> pa.DataType:
        if text.startswith("array"):
            return pa.list_(pa.int32() if "<int>" in text else pa.int64())
        return {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[text]

    names = [c.split(" ", 1) for c in _PARTS.split(", ")]
    tokens = pa.struct([(c.split()[0], kind(c.split()[1])) for c in _OPEN.split(", ")])
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], tokens if k.startswith("struct") else kind(k)) for n, k in names], names=[n for n, _ in names])


def _open_row(row: int, part: int, f: Fragment) -> dict:
    return {"row": row, "part": part, "closed": False, "has_end": f.has_end, "prefix": f.prefix.row(), "suffix": f.suffix.row()}


def _closed_row(row: int, t: Tokens, sides: Sides) -> list[dict]:
    if not len(t.a_ids):
        return []
    groups = closed_groups(t, sides.digits)
    pairs, links, _ = _joined_pairs(sides.pair_numbers(groups.link_a, groups.link_b), np.zeros(len(groups.link_a), np.int64), 1, len(sides.pairs))
    return [{"row": row, "closed": True, "at": int(t.a_ends[0]), "n_groups": len(groups.link_a), "groups": groups.body,
             "pairs": pairs.tolist(), "links": links.tolist()}]


def _long(docs: DataFrame, a_path: str, b_path: str, digest: bool) -> DataFrame:
    """A row per document of more than ``LONG`` bytes, from its chunks."""
    chunks = docs.mapInArrow(_cut, "row bigint, doc_id bigint, part bigint, a_from bigint, a_body binary, b_from bigint, b_body binary")
    chunks = cut_lineage(chunks)  # the numbers of rows hold from here on

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, b_path)
        for batch in batches:
            for r in batch.to_pylist():
                whole = []
                for side, start, body in ((sides.a, r["a_from"], r["a_body"]), (sides.b, r["b_from"], r["b_body"])):
                    ids, _, wrong = side.encode(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
                    whole.append((ids, start + np.cumsum(side.lengths[ids]), bool(wrong.any())))
                (a_ids, a_ends, a_wrong), (b_ids, b_ends, b_wrong) = whole
                own, closed = fragment(Tokens(a_ids, a_ends, b_ids, b_ends))
                yield _part_rows([{**_open_row(r["row"], r["part"], own), "n_a": len(a_ids), "n_b": len(b_ids), "wrong": a_wrong or b_wrong},
                                  *_closed_row(r["row"], closed, sides)])

    def reduce_part(key: tuple, table: pa.Table) -> pa.Table:
        sides = _sides(a_path, b_path)
        rows = sorted(table.select(["part", "has_end", "prefix", "suffix"]).to_pylist(), key=lambda r: r["part"])
        parts = [Fragment(r["has_end"], Tokens.of(r["prefix"]), Tokens.of(r["suffix"])) for r in rows]
        row, whole, out = key[0].as_py(), parts[0], []
        for part in parts[1:]:
            whole, closed = compose(whole, part)
            out += _closed_row(row, closed, sides)
        return pa.Table.from_batches([_part_rows([_open_row(row, rows[0]["part"] // FAN, whole), *out])])

    level = cut_lineage(chunks.repartition("row", "part").mapInArrow(align, _PARTS))
    totals = level.where("NOT closed").groupBy("row").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.max("wrong").alias("wrong"))
    closed = level.where("closed")
    deepest = chunks.agg(F.max("part")).first()[0] or 0
    while deepest > 0:
        level = cut_lineage(level.where("NOT closed").groupBy("row", F.expr(f"part DIV {FAN}")).applyInArrow(reduce_part, _PARTS))
        closed, deepest = closed.union(level.where("closed")), deepest // FAN

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, b_path)
        for batch in batches:
            for r in batch.to_pylist():  # the first group begins with the text; the last ends with it
                yield _part_rows([{"row": r["row"], "closed": True, "at": -1, "n_groups": 0}, *_closed_row(r["row"], Tokens.of(r["prefix"]), sides)])

    blocks = cut_lineage(closed.union(level.where("NOT closed").mapInArrow(ends, _PARTS)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by document and place: the text of the groups passes through, its digest is kept."""
        def settled() -> pa.RecordBatch:
            groups = b"".join(parts)[:-1].decode() if not digest else hash_.hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([count]), pa.array([groups]), pa.array([list(pairs)], pa.list_(pa.int32())),
                                               pa.array([list(pairs.values())], pa.list_(pa.int64()))], names=["row", "n_groups", "groups", "pairs", "links"])

        current = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["row"] != current:
                    if current is not None:
                        yield settled()
                    current, count, pairs, parts, hash_, behind = r["row"], 0, {}, [], hashlib.sha256(), b""
                count += r["n_groups"]
                for pair, n in zip(r["pairs"] or (), r["links"] or ()):
                    pairs[pair] = pairs.get(pair, 0) + n
                if r["groups"]:
                    if digest:
                        hash_.update(behind + r["groups"][:-1])
                        behind = b";"
                    else:
                        parts.append(r["groups"])
        if current is not None:
            yield settled()

    digests = blocks.select("row", "at", "n_groups", "groups", "pairs", "links").repartition("row").sortWithinPartitions("row", "at") \
        .mapInArrow(whole, "row bigint, n_groups bigint, groups string, pairs array<int>, links array<bigint>")
    ids = chunks.where("part = 0").select("row", "doc_id")
    right = ~F.col("wrong")
    return cut_lineage(digests.join(totals, "row").join(ids, "row").select(
        F.lit(False).alias("tally"), "doc_id", *[F.when(right, F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b", "n_groups")],
        F.when(right, F.col("groups")).otherwise("").alias("groups"), F.when(right, F.col("pairs")).otherwise(F.array().cast("array<int>")).alias("pairs"),
        F.when(right, F.col("links")).otherwise(F.array().cast("array<bigint>")).alias("links")))


def aligned(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: one row per document.

    ``groups`` is the text a1,a2|b1;a3|b2,b3 of the ids of A and B, or its SHA-256 with ``digest``. n_best are the links whose
    pair has more links in the corpus than any other pair of its B id (or as many), count_sum adds their pairs' links.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    is_long = F.coalesce(F.octet_length("text") > LONG, F.lit(False))
    short = cut_lineage(_short(texts.where(~is_long), a_path, b_path, digest))
    long = _long(texts.where(is_long), a_path, b_path, digest)
    tallies = short.where("tally").select("pairs", "links").union(long.select("pairs", "links"))
    counted = tallies.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).groupBy(F.col("p.pairs").alias("pair")) \
        .agg(F.sum("p.links").alias("links")).toArrow()  # one row per pair that the vocabularies allow
    pairs = Sides(a_path, b_path).pairs
    totals = np.zeros(len(pairs), dtype=np.int64)
    totals[counted.column("pair").to_numpy()] = counted.column("links").to_numpy()
    highest = np.zeros(int((pairs & 0xFFFFFFFF).max()) + 1, dtype=np.int64)
    np.maximum.at(highest, pairs & 0xFFFFFFFF, totals)
    shipped = docs.sparkSession.sparkContext.broadcast((totals, totals == highest[pairs & 0xFFFFFFFF]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, best = shipped.value
        kept = ["doc_id", "n_a", "n_b", "n_groups", "groups"]
        for batch in batches:
            lists, links = batch.column("pairs"), batch.column("links").values.to_numpy()
            pairs, places = lists.values.to_numpy(), lists.offsets.to_numpy()
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (links, links * best[pairs], links * totals[pairs])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(s[places[1:]] - s[places[:-1]]) for s in sums)],
                                             names=[*kept, "n_links", "n_best", "count_sum"])

    columns = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, n_links bigint, n_best bigint, count_sum bigint"
    return short.where("NOT tally").union(long).mapInArrow(of, columns)


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """What ``aligned`` gives, with the SHA-256 of the groups."""
    return aligned(docs, a_path, b_path, digest=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
