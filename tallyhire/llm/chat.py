"""Chat formatting with a loss mask aligned by token offsets.

A conversation is rendered whole as ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn, encoded once with offsets, and
the sorted spans of its assistant texts are intersected with the sorted token spans by binary search.  The three control
strings are special tokens, so a span's edges always are token edges.  A ``<`` and ``|`` of a role or text, with any
backslashes between them, gets one more backslash: no control string can occur in a text, and taking one backslash away
again restores it.

Rows are sorted inside a partition and streamed; a very long conversation is encoded in pieces cut after a turn, which
gives the same tokens because no token reaches over a special one.  Memory is bounded by one piece and one turn.

Cases: a null or empty text or role is empty; rows of one turn are ordered by role, then text, and repeated rows are turns
of their own; rows with a null conv_id are one conversation; only conv_id, turn, role and text are read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhire.llm.common import slices

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
#: Characters that are encoded at once; a piece ends with the turn that reaches it.
PIECE_CHARS = 1 << 20

DIGEST_DDL = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
              "n_tokens long, loss_tokens long")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


class ChatEncoder:
    """A byte-level tokenizer that knows the control strings."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([START, SEPARATOR, END])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and (start, stop) character spans of the tokens."""
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(encoded.ids, np.int64), np.array(encoded.offsets, np.int64).reshape(-1, 2)

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text of (role, text) turns, and the sorted spans of the texts that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for the tokens inside a span, found by binary search: both lists are sorted and spans do not overlap."""
    mask = np.zeros(len(offsets), bool)
    first = np.searchsorted(offsets[:, 0], spans[:, 0], side="left")
    after = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    for a, b in zip(first.tolist(), after.tolist()):
        mask[a:b] = True
    return mask


def encode(encoder: ChatEncoder, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The formatted text, its ids and the loss mask of the ids."""
    text, spans = render(turns)
    ids, offsets = encoder(text)
    return text, ids, loss_mask(offsets, spans)


def read_back(encoder: ChatEncoder, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns that the ids say, and every run of text under the mask; both unescaped."""
    said = encoder.decode(ids)
    turns = []
    for turn in said.split(START)[1:]:
        role, _, text = turn.removesuffix(END).partition(SEPARATOR)
        turns.append((unescape(role), unescape(text)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    learned = [unescape(encoder.decode(ids[a:b])) for a, b in edges.reshape(-1, 2)]
    return turns, learned


_encoders: dict[str, ChatEncoder] = {}


def _encoder(path: str) -> ChatEncoder:
    if path not in _encoders:
        _encoders[path] = ChatEncoder(path)
    return _encoders[path]


class _Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.all, self.learned = conv_id, 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0

    def add(self, encoder: ChatEncoder, turns: list[tuple[str, str]]) -> None:
        text, ids, mask = encode(encoder, turns)
        said, learned = read_back(encoder, ids, mask)
        for role, own in said:
            self.all.update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
        for own in learned:
            self.learned.update(own.encode("utf-8", "surrogatepass"))
        self.turns += len(said)
        self.loss_chars += sum(map(len, learned))
        self.chars += len(text)
        self.tokens += len(ids)
        self.loss_tokens += int(mask.sum())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars,
                self.tokens, self.loss_tokens)


def digests(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation, read back from its formatted and encoded form."""
    names = [f.split()[0] for f in DIGEST_DDL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now, turns, chars, rows = _encoder(tokenizer_path), None, [], 0, []

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c[0], int | None) else pa.array(c, pa.int64())
                                              for c in zip(*rows)], names=names)
            rows.clear()
            return out

        for batch in slices(batches):
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if now is None or conv_id != now.conv_id:
                    if now:
                        if turns:
                            now.add(encoder, turns)
                        rows.append(now.row())
                    now, turns, chars = _Digest(conv_id), [], 0
                turns.append((role, text))
                chars += len(text)
                if chars >= PIECE_CHARS:
                    now.add(encoder, turns)
                    turns, chars = [], 0
            if len(rows) >= 4096:
                yield done()
        if now:
            if turns:
                now.add(encoder, turns)
            rows.append(now.row())
            yield done()

    return (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"), "turn")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
        .mapInArrow(run, DIGEST_DDL)
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts are made of control strings."""
    text = f"{END}{START}assistant ok"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED_ROLE).alias("role"), F.lit(text).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
