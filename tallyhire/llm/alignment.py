"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A sees a space and the text, tokenizer B the text, to which it adds that space.  The character offsets of A and
the spans of B's proto are coarse cuts: where a token's span ends before the next begins, the byte there is where the token
ends.  Where they can't tell - several tokens share a character, or B falls back to bytes, whose spans are empty - the
decoded bytes of the token say how far it goes.  Every token's bytes are compared with the bytes between its cuts.

A text is cut into units before every single space or line end between two other characters, and between a letter and a
mark.  A splits there by its own pattern and B has no piece that reaches over such a cut, so a unit is encoded alike wherever
it stands, and every distinct unit is encoded and aligned once per worker.  Whether that holds, and for which characters,
is read from the tokenizers' own files; if it doesn't, the whole text is the unit.

Counts of linked id pairs are combined in the task, then by Spark.  A document meets them in two ways: the ``HEAD`` most
frequent pairs travel to the tasks as arrays, so no frequent pair is ever a join key; the other pairs of a document are
joined by shuffle.  Both are exact.  The highest count of every id of B is at most one row per id of its vocabulary.

Cases: a text that is null, empty, or not spelt by the tokens of both (B reads U+2581 as a space) has no tokens: zeros, and
'' for the digest; special tokens' strings inside texts are plain text; repeated rows count again and come again; a null
doc_id is kept; only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhire.llm.common import slices
from tallyhire.operators.settle import settled

SPACE_PIECE = "▁"
#: Characters of units that a worker remembers; it starts anew beyond them, which costs time and changes no result.
CACHE_CHARS = 5_000_000
#: Longer units are aligned but not remembered.
LONGEST_CACHED = 64
#: Most frequent pairs that travel to the tasks: 16 bytes each.
HEAD = 65_536
MARKS = ",.;:!?"
#: Stands before a unit that doesn't begin with a space when units are encoded together.
FILLER = " a"
NO_TOKENS = (0, 0, 0, 0, "", b"", b"")


class Unit(NamedTuple):
    """What the documents that hold a unit need of it; ``codes`` are its links' id pairs as packed integers."""

    n_a: int
    n_b: int
    n_groups: int
    codes: bytes
    written: bytes


class Aligned(NamedTuple):
    """Tokens of both sides over one text: ids, byte ends, and the cuts between links with their tokens' places."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    cuts: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def token_ends(coarse: np.ndarray, told: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse cut where the spans tell it, else the last end and the token's decoded bytes.

    As every stretch between two told cuts must be spelt by its tokens, an end that is not told is also the sum of the
    decoded sizes up to it; a told cut that differs from that sum shows that the tokens don't spell the text.
    """
    return np.where(told, coarse, np.cumsum(sizes))


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """The ends of both sides cut the text into stretches; each lies in one token of either side and is one link."""
    cuts = np.union1d(ends_a, ends_b)
    return Aligned(a, b, ends_a, ends_b, cuts, np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts))


class Aligner:
    """Both tokenizers of one worker and the units that it has aligned."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        added = {int(k): v.content for k, v in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = token.encode() if k in added else bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(SPACE_PIECE, " ").encode()
                        for k, p in enumerate(pieces)]
        self.b_size = len(pieces)
        self.a_sizes = np.array([len(t) for t in self.a_bytes])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        self.kind = "<u4" if len(self.a_bytes) * self.b_size < 1 << 32 else "<i8"
        # an id as it stands within a group of A, at its end, within a group of B, and at its end
        count = max(len(self.a_bytes), self.b_size)
        self.spelling = [f"{k}{mark}".encode() for mark in ",|,;" for k in range(count)]
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        rules, trained = model.normalizer_spec, model.trainer_spec
        own = json.loads(self.a.to_str())
        before = own["pre_tokenizer"] or {}
        self.by_words = (
            own["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True
            and before.get("add_prefix_space") is False and all(t["special"] for t in own["added_tokens"])
            and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
            and not trained.treat_whitespace_as_suffix
            and not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces)
        )
        spaces = " " if any("\n" in p for p in pieces) else r" \n"
        crossed = {p[k + 1] for p in pieces for k in range(len(p) - 1) if p[k].isascii() and p[k].isalpha()}
        marks = "".join(m for m in MARKS if m not in crossed)
        # the first look ahead only spares the others at most characters
        between = rf"(?=[{spaces}{marks}])(?:(?<=\S)(?=[{spaces}]\S)" + (rf"|(?<=[A-Za-z])(?=[{marks}]))" if marks else ")")
        self.between = re.compile(between)
        self.known: dict[str, Unit | None] = {}
        self.known_chars = 0

    def units(self, text: str) -> list[str]:
        """The pieces of a space and the text."""
        return self.between.split(" " + text) if self.by_words else [" " + text]

    def text(self, text: str) -> Aligned | None:
        """Both sides' tokens over a space and the text; None if they don't spell it."""
        spaced = " " + text
        data = spaced.encode()
        encoded = self.a.encode(spaced, add_special_tokens=False)
        a, pieces = encoded.ids, self.b.encode(text, return_type="proto").pieces
        b = [p.id for p in pieces]
        if b"".join([self.a_bytes[k] for k in a]) != data or b"".join([self.b_bytes[k] for k in b]) != data:
            return None
        a, b = np.array(a), np.array(b)
        # A: characters to bytes; a token whose span runs into the next one's ends inside a character
        spans = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        place = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        ends_a = token_ends(place[spans[:, 1]], spans[:, 1] <= np.append(spans[1:, 0], len(spaced)), self.a_sizes[a])
        # B: bytes after the added space; a token without a span is that space or part of a character
        begin, stop = np.array([p.begin for p in pieces]), np.array([p.end for p in pieces])
        ends_b = token_ends(stop + 1, stop > begin, self.b_sizes[b])
        for ids, ends, sizes in ((a, ends_a, self.a_sizes), (b, ends_b, self.b_sizes)):
            if not np.array_equal(np.diff(ends, prepend=0), sizes[ids]):
                return None
        return linked(a, b, ends_a, ends_b)

    def written(self, got: Aligned) -> tuple[list[bytes], np.ndarray]:
        """The tokens as the digest has them, in order, and for each the group it lies in."""
        shared = got.cuts[(got.ends_a[got.at_a] == got.cuts) & (got.ends_b[got.at_b] == got.cuts)]
        group_a, group_b = np.searchsorted(shared, got.ends_a), np.searchsorted(shared, got.ends_b)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        third = len(self.spelling) // 4
        names = np.concatenate([got.a + third * last_a, got.b + third * (2 + last_b)])
        group = np.concatenate([group_a, group_b])
        order = np.argsort(2 * group + (np.arange(len(group)) >= len(group_a)), kind="stable")
        return [self.spelling[k] for k in names[order].tolist()], group[order]

    def align(self, units: list[str]) -> dict[str, Unit | None]:
        """Encode and align units that are not known yet, as one text; None for those that the tokens don't spell."""
        row = [piece for u in units for piece in ((u,) if u[0] == " " else (FILLER, u))]
        got = self.text("".join(row)[1:])
        if got is None:
            if len(units) == 1:
                return {units[0]: None}
            half = len(units) // 2
            return self.align(units[:half]) | self.align(units[half:])
        stops = np.cumsum([len(u.encode()) for u in row])
        tokens, group = self.written(got)
        shared = got.cuts[(got.ends_a[got.at_a] == got.cuts) & (got.ends_b[got.at_b] == got.cuts)]
        place = {name: [0, *np.searchsorted(ends, stops, "right").tolist()] for name, ends in (
            ("a", got.ends_a), ("b", got.ends_b), ("links", got.cuts), ("groups", shared))}
        place["tokens"] = [0, *np.searchsorted(group, np.array(place["groups"][1:])).tolist()]
        width = np.dtype(self.kind).itemsize
        codes = (got.a[got.at_a].astype(np.int64) * self.b_size + got.b[got.at_b]).astype(self.kind).tobytes()
        out: dict[str, Unit | None] = {}
        for unit, a0, a1, b0, b1, l0, l1, g0, g1, t0, t1 in zip(row, *(
                side for p in place.values() for side in (p, p[1:]))):
            out[unit] = Unit(a1 - a0, b1 - b0, g1 - g0, codes[width * l0:width * l1], b"".join(tokens[t0:t1]))
        return out

    def documents(self, texts: list[str | None]) -> Iterator[list[Unit] | None]:
        """The aligned units of every text, None for a text without tokens."""
        cut = [self.units(t) if t else [] for t in texts]
        if self.known_chars > CACHE_CHARS:
            self.known, self.known_chars = {}, 0
        fresh = list(dict.fromkeys(u for units in cut for u in set(units).difference(self.known)))
        # a unit with more white space at an edge, as texts may begin and end, would be read together with the next
        alone = [u for u in fresh if not self.by_words or u[1:2].isspace() or u[-1].isspace()]
        # one that holds the letter by which B writes a space is never spelt, and could be joined to the next
        found: dict[str, Unit | None] = {u: None for u in fresh if SPACE_PIECE in u}
        for unit in alone:
            found |= self.align([unit])
        together = [u for u in fresh if u not in found]
        if together:
            found |= self.align(together)
        self.known |= found
        for units in cut:
            got = list(map(self.known.get, units))
            yield got if got and None not in got else None
        for unit in found:
            if len(unit) > LONGEST_CACHED:
                del self.known[unit]
            else:
                self.known_chars += len(unit)


_aligner: tuple[tuple[str, str], Aligner] | None = None


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner; a worker that is used again keeps it."""
    global _aligner
    if _aligner is None or _aligner[0] != (a_path, b_path):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _aligner = ((a_path, b_path), Aligner(a_path, b_path))
    return _aligner[1]


def groups(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per group: (doc_id, ordinal, start, stop, a_ids, b_ids), byte places in the text after a space."""
    schema = pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                        ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = own.text(text) if text else None
                if got is None:
                    continue
                shared = np.intersect1d(got.ends_a, got.ends_b)
                stops_a, stops_b = (np.searchsorted(e, shared, "right").tolist() for e in (got.ends_a, got.ends_b))
                ends = shared.tolist()
                for k, (start, a0, b0) in enumerate(zip([0, *ends], [0, *stops_a], [0, *stops_b])):
                    if k < len(ends):
                        rows.append((doc, k, start, ends[k], got.a[a0:stops_a[k]], got.b[b0:stops_b[k]]))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ddl = "doc_id long, ordinal long, start long, stop long, a_ids array<int>, b_ids array<int>"
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)


def code_type(a_path: str, b_path: str) -> tuple[str, int]:
    """The smallest integer type that holds every pair of ids, and the size of B's vocabulary."""
    own = aligner(a_path, b_path)
    return own.kind, own.b_size


LINK_DDL = ("place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "codes binary, times binary")


def links(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: token, group and link counts, the digest of its groups, and its distinct id pairs with their counts."""
    kind, _ = code_type(a_path, b_path)

    def row(units: list[Unit] | None) -> tuple:
        if units is None:
            return NO_TOKENS
        n_a, n_b, n_groups, links, written = zip(*units)
        codes, times = np.unique(np.frombuffer(b"".join(links), kind), return_counts=True)
        digest = hashlib.sha256(b"".join(written)[:-1]).hexdigest()
        return (sum(n_a), sum(n_b), sum(n_groups), int(times.sum()), digest, codes.tobytes(), times.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in LINK_DDL.split(", ")]
        for batch in slices(batches):
            rows = [row(units) for units in own.documents(batch.column(2).to_pylist())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    placed = documents.select(
        F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return placed.mapInArrow(run, LINK_DDL)


def _unpack(batch: pa.RecordBatch, codes: int, times: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes and counts of a batch's rows, and how many each row has."""
    packed = [np.frombuffer(c, kind) for c in batch.column(codes).to_pylist()]
    counts = [np.frombuffer(c, "<u4") for c in batch.column(times).to_pylist()]
    sizes = np.fromiter(map(len, packed), np.int64, len(packed))
    return np.concatenate(packed).astype(np.int64), np.concatenate(counts).astype(np.int64), sizes


def pair_counts(rows: DataFrame, kind: str, b_size: int) -> DataFrame:
    """(code, n, best): links of every id pair over all rows, and whether no pair of the same B id has more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, _ = _unpack(batch, 0, 1, kind)
            distinct, where = np.unique(codes, return_inverse=True)
            n = np.zeros(len(distinct), np.int64)
            np.add.at(n, where, times)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], names=["code", "n"])

    partial = rows.where("n_links > 0").select("codes", "times").mapInArrow(run, "code long, n long")
    counts = settled(partial.groupBy("code").agg(F.sum("n").alias("n")))
    # at most one row per id of B
    most = counts.groupBy((F.col("code") % b_size).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.col("code") % b_size == F.col("b")).select(
        "code", "n", (F.col("n") == F.col("most")).alias("best"))


def _met_by_head(head: pa.Table, kind: str, names: list[str]) -> Callable:
    order = np.argsort(head["code"].to_numpy())
    known = head["code"].to_numpy()[order].astype(np.int64)
    n = head["n"].to_numpy()[order].astype(np.int64)
    best = head["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = batch.num_columns - 2
            codes, times, sizes = _unpack(batch, kept, kept + 1, kind)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            hit = known[at] == codes
            stops = np.cumsum(sizes)
            sums = [np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(v)])[stops]]))
                    for v in (hit * times * best[at], hit * times * n[at])]
            rest = np.concatenate([[0], np.concatenate([[0], np.cumsum(~hit)])[stops]]).astype(np.int32)
            tails = [pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~hit])) for v in (codes, times)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *map(pa.array, sums), *tails], names=names)

    return run


def digests(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    kind, b_size = code_type(a_path, b_path)
    rows = settled(links(documents, a_path, b_path))
    counts = settled(pair_counts(rows, kind, b_size))
    head = counts.orderBy(F.desc("n"), "code").limit(HEAD)
    shipped = head.toArrow()
    if shipped.num_rows == 0:
        zero = F.lit(0).cast("long")
        return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256")
    plain = ["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    names = [*plain, "n_best", "count_sum", "tail", "tail_times"]
    ddl = LINK_DDL[:LINK_DDL.index(", codes")] + ", n_best long, count_sum long, tail array<long>, tail_times array<long>"
    met = settled(rows.select(*plain, "codes", "times").mapInArrow(_met_by_head(shipped, kind, names), ddl))
    each = met.select("place", F.inline(F.arrays_zip(F.col("tail").alias("code"), F.col("tail_times").alias("times"))))
    tail = each.join(counts, "code").groupBy("place").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("tail_best"), F.sum(F.col("times") * F.col("n")).alias("tail_sum"))
    zero = F.lit(0).cast("long")
    return met.join(tail, "place", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("tail_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("tail_sum", zero)).alias("count_sum"), "groups_sha256")
