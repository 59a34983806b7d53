"""Packing token streams into fixed windows by minimum bin slack.

A document is its token ids and one closing id.  Whole windows are cut off it at once; what remains is shorter than a
window and waits in a pool.  Every further window is seeded with the longest waiting piece and then filled by a
subset-sum dynamic program over the multiset of waiting lengths: a bit set holds the sums that can be reached, one step
per distinct length and power-of-two share of its count, and the steps are walked back to the counts of the sum closest
to the capacity.  A piece is cut only to close a gap that no multiset fills, so windows have no padding.

The pool belongs to one partition of the input and is emptied down to ``LOW`` pieces whenever it holds ``HIGH``; nothing
is shuffled, no source or key can make a task larger than its share of the input, and memory is bounded by ``HIGH``
pieces.  What is left at the end of a partition is cut into sequences whose sizes are powers of two, which need no
padding either.  A sequence is numbered by its partition and its place in it, so a task that is run again after the loss
of an executor numbers alike.

Cases: a null or empty text is one closing id; a repeated row is packed again; a null doc_id is kept; columns other than
doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyhire.llm.common import slices

WINDOW = 2048
CLOSING_ID = 1
ID_BYTES = 4
HIGH, LOW = 6144, 2048
#: Bits of a sequence number below the partition, as in Spark's own increasing ids.
PARTITION_BITS = 33
#: Cached parts of words per worker, some 270 bytes each, while a task runs and between tasks, when a worker waits beside
#: whatever stage runs by then.  Beyond it the later ones are dropped: frequent parts are met first, and stay.
CACHE_PARTS, IDLE_PARTS = 400_000, 100_000
JOINED_PARTS = 4096

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
PIECES_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, by a tokenizer that splits words by a fixed pattern.

    A text of ASCII and Latin-1 letters, whose normal form and lower case do not depend on context, is split into the
    parts that the tokenizer itself would encode one by one, and every distinct part is encoded once.  Other texts are
    split at ASCII white space, across which the tokenizer never joins; their words of other characters, and those that
    could hold a special token, go to the tokenizer whole.
    """

    PLAIN = re.compile(r"[\x20-\x7e\t-\rÀ-ÖØ-öø-ÿ]*")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
    WORDS = re.compile(r"[^ \t-\r]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, fresh: list[str]) -> None:
        """Encode many plain parts by one call; every part ends in exactly one id that closes a word."""
        ids = np.asarray(self.tokenizer.encode(" ".join(fresh), add_special_tokens=False).ids, "<u4")
        stops = (np.flatnonzero(self.closes[ids]) + 1) * ID_BYTES
        if len(stops) != len(fresh):
            raise ValueError(f"{len(fresh)} words came back as {len(stops)}")
        data, start = ids.tobytes(), 0
        for part, stop in zip(fresh, stops.tolist()):
            self.parts[part] = data[start:stop]
            start = stop

    def _split(self, text: str) -> list[str]:
        if "<|" not in text and self.PLAIN.fullmatch(text):
            return self.PARTS.findall(text.lower())
        out = []
        for word in self.WORDS.findall(text):
            if "<|" not in word and self.PLAIN.fullmatch(word):
                out += self.PARTS.findall(word.lower())
            else:
                if word not in self.parts:
                    self.parts[word] = self._encoded(word)
                out.append(word)
        return out

    def keep(self, most: int) -> None:
        """Forget all parts but the ``most`` that were met first; they are learned anew if they come again."""
        if len(self.parts) > most:
            self.parts = dict(islice(self.parts.items(), most))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > CACHE_PARTS:
            self.keep(CACHE_PARTS // 2)
        split = [self._split(text) for text in texts]
        found = [list(map(self.parts.get, own)) for own in split]
        fresh = list({p for own, ids in zip(split, found) if None in ids for p, i in zip(own, ids) if i is None})
        for at in range(0, len(fresh), JOINED_PARTS):
            self._learn(fresh[at:at + JOINED_PARTS])
        return [b"".join(ids if None not in ids else map(self.parts.__getitem__, own))
                for own, ids in zip(split, found)]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def best_fill(lengths: Sequence[int], count: Callable[[int], int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``count`` of each, whose sum is closest to ``room`` from below.

    ``lengths`` are distinct and ascending; they are added from the longest that fits down.  ``reach`` has bit *s* set
    if some multiset of the lengths so far sums to *s*; once ``room`` itself is reached no further length can do better.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, share = min(count(length), room // length), 1
        while left:
            share = min(share, left)
            steps.append((length, share, reach))
            reach |= (reach << (length * share)) & mask
            left, share = left - share, share * 2
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, defaultdict(int)
    for length, share, before in reversed(steps):
        if not before >> total & 1:
            total -= length * share
            picked[length] += share
    return dict(picked)


class Pool:
    """Pieces that wait for a window, by length; closes windows and yields the rows of their pieces."""

    def __init__(self, window: int, first_id: int) -> None:
        self.window, self.next_id = window, first_id
        self.waiting: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []  # the keys of waiting, ascending
        self.size = 0

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        length = len(ids) // ID_BYTES
        if length not in self.waiting:
            self.waiting[length] = []
            insort(self.lengths, length)
        self.waiting[length].append((doc_id, start, ids, doc_tokens))
        self.size += 1

    def _take(self, length: int) -> tuple:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.size -= 1
        return piece

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // ID_BYTES
            yield doc_id, start, length, zlib.crc32(ids), doc_tokens, self.next_id, at
            at += length
        self.next_id += 1

    def _split(self, piece: tuple, length: int) -> tuple:
        """The first ``length`` ids of a piece; the rest waits again."""
        doc_id, start, ids, doc_tokens = piece
        self.add(doc_id, start + length, ids[length * ID_BYTES:], doc_tokens)
        return doc_id, start, ids[: length * ID_BYTES], doc_tokens

    def _window(self) -> list[tuple]:
        seed = self.lengths[-1]
        pieces, room = [self._take(seed)], self.window - seed
        if room:
            picked = best_fill(self.lengths, lambda n: len(self.waiting[n]), room)
            for length, count in picked.items():
                pieces += [self._take(length) for _ in range(count)]
                room -= length * count
        if room:  # every piece left is longer than the gap
            pieces.append(self._split(self._take(self.lengths[0]), room))
        return pieces

    def drain(self, down_to: int) -> Iterator[tuple]:
        """Close windows until at most ``down_to`` pieces wait; 0 empties the pool."""
        tokens = sum(n * len(p) for n, p in self.waiting.items())
        while self.size > down_to and tokens >= self.window:
            yield from self.sequence(self._window())
            tokens -= self.window
        if not down_to:
            while tokens:
                size, pieces, room = 1 << (tokens.bit_length() - 1), [], 1 << (tokens.bit_length() - 1)
                while room:
                    length = self.lengths[-1]
                    piece = self._take(length)
                    piece = self._split(piece, room) if length > room else piece
                    pieces.append(piece)
                    room -= len(piece[2]) // ID_BYTES
                yield from self.sequence(pieces)
                tokens -= size


def packer(path: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    closing, wide = CLOSING_ID.to_bytes(ID_BYTES, "little"), window * ID_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        pool = Pool(window, TaskContext.get().partitionId() << PARTITION_BITS)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES.types)], schema=PIECES)
            rows.clear()
            return out

        for part in slices(batches):
            for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                ids += closing
                doc_tokens = len(ids) // ID_BYTES
                whole = len(ids) - len(ids) % wide
                for at in range(0, whole, wide):
                    rows += pool.sequence([(doc_id, at // ID_BYTES, ids[at:at + wide], doc_tokens)])
                if whole < len(ids):
                    pool.add(doc_id, whole // ID_BYTES, ids[whole:], doc_tokens)
            if pool.size >= HIGH:
                rows += pool.drain(LOW)
            if len(rows) >= 8192:
                yield batch()
        encode.keep(IDLE_PARTS)
        rows += pool.drain(0)
        if rows:
            yield batch()

    return pack


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        packer(tokenizer_path, window), PIECES_DDL)
