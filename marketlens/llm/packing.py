"""Vector bin packing of token pieces under limits on tokens, segments and loss-bearing tokens.

Each task packs its own rows: texts become ids, what reaches a limit alone becomes a sequence of its
own, and remainders wait in a buffer of bounded size. Sequences are filled one after the other with
the waiting piece whose demand has the largest dot product with the room that is left, both taken as
shares of the limits and weighted by what is waiting in all. When no whole piece fits, one is cut to
fill the room. The last, partly filled sequence of a task is cut into lengths that are powers of two,
which need no padding.

Empty cases: a null text is empty and still has its closing id; an empty table gives an empty result;
a null id is carried along; equal rows are packed separately, each with its own pieces.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import LOWER, texts


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. A piece and what a cut leaves of it have `least` tokens at least."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096
    least: int = 16


class Tokens:
    """Ids of whole texts as little-endian bytes, by a byte-level tokenizer that never looks across white space.

    Distinct words are encoded once and remembered, up to `limit` words at a time. Words that the
    tokenizer's normaliser leaves as they are are encoded a thousand at a time, as one text, and cut
    apart by the byte lengths of their tokens.
    """

    def __init__(self, path: str, end: int, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        self.bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, k in tokenizer.get_vocab().items():
            self.bytes[k] = len(token.removesuffix("</w>"))
        self.end, self.limit, self.known = np.uint32(end).tobytes(), limit, {}

    def words(self, text: bytes) -> list[bytes]:
        # Special tokens are matched before letters are lowered.
        return text.split() if b"<|" in text else text.translate(LOWER).split()

    def plain(self, word: bytes) -> bool:
        if b"<|" in word:
            return False
        if word.isascii():
            return True
        text = word.decode()
        return text == text.lower() and unicodedata.is_normalized("NFC", text)

    def learn(self, new: list[bytes]) -> None:
        known = self.known
        plain = [word for word in new if self.plain(word)]
        other = [word for word in new if not self.plain(word)] if len(plain) < len(new) else []
        for start in range(0, len(plain), 1000):
            part = plain[start : start + 1000]
            ids = np.array(self.encode([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.bytes[ids])
            until = np.cumsum([len(word) for word in part])
            at = np.searchsorted(ends, until)
            if len(ends) and at[-1] == len(ids) - 1 and (ends[np.minimum(at, len(ids) - 1)] == until).all():
                raw, edges = ids.tobytes(), (4 * (at + 1)).tolist()
                known.update(zip(part, map(raw.__getitem__, map(slice, [0, *edges], edges))))
            else:
                other += part
        for start in range(0, len(other), 20_000):
            part = other[start : start + 20_000]
            for word, coded in zip(part, self.encode([word.decode() for word in part], add_special_tokens=False)):
                known[word] = np.array(coded.ids, np.uint32).tobytes()

    def of(self, batch: list[bytes]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        split = [self.words(text) for text in batch]
        self.learn([word for word in set().union(*split) if word not in self.known])
        return [b"".join(map(self.known.__getitem__, words)) + self.end for words in split]


_TOKENS: dict[tuple[str, int], Tokens] = {}


def tokens_of(path: str, end: int) -> Tokens:
    """One per Python worker: later tasks use the words that earlier ones have met."""
    if (path, end) not in _TOKENS:
        _TOKENS[path, end] = Tokens(path, end)
    return _TOKENS[path, end]


class Packer:
    """Fills sequences from a buffer of waiting pieces: (document, start, tokens, first token that bears loss)."""

    def __init__(self, limits: Limits, first_sequence: int, waiting: int = 1024):
        self.limits, self.next, self.most = limits, first_sequence, 2 * waiting
        self.room = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.waiting: list[tuple] = []
        self.out: list[tuple] = []

    def loss(self, start: int, length: int, bears: int) -> int:
        return max(0, start + length - max(start, bears))

    def fitting(self, start: int, room: int, loss_room: int, bears: int) -> int:
        """The most tokens from start that keep to both limits."""
        return min(room, max(0, bears - start) + loss_room)

    def add(self, document: tuple, n: int, bears: int) -> None:
        start = 0
        while n - start:
            most = self.fitting(start, self.limits.tokens, self.limits.loss, bears)
            if n - start < most:
                self.waiting.append((document, start, n - start, bears))
                break
            self.close([(document, start, most)])
            start += most
        if len(self.waiting) >= self.most:
            self.fill(self.most // 2)

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for document, start, length in pieces:
            self.out.append((document, start, length, self.next, offset))
            offset += length
        self.next += 1

    def fill(self, until: int) -> None:
        """Pack until at most so many pieces wait; the last sequence may stay part empty only if none wait."""
        items = self.waiting
        demand = np.array([[n, 1, self.loss(start, n, bears)] for _, start, n, bears in items], float).reshape(-1, 3)
        alive = np.ones(len(items), bool)
        left = len(items)
        while left > until:
            share = demand[alive].sum(axis=0) / self.room
            weight = share / max(share.sum(), 1e-12) / self.room**2
            used, pieces = np.zeros(3), []
            while left:
                room = self.room - used
                fits = alive & (demand <= room).all(axis=1)
                value = demand @ (weight * room)
                if fits.any():
                    best = int(np.where(fits, value, -1).argmax())
                    document, start, n, _ = items[best]
                    alive[best], left = False, left - 1
                    pieces.append((document, start, n))
                    used += demand[best]
                    continue
                # Cut the piece that asks for most of what is left.
                best = int(np.where(alive, value, -1).argmax())
                document, start, n, bears = items[best]
                part = min(self.fitting(start, int(room[0]), int(room[2]), bears), n - self.limits.least)
                if room[1] >= 1 and part >= self.limits.least:
                    pieces.append((document, start, part))
                    used += [part, 1, self.loss(start, part, bears)]
                    items[best] = (document, start + part, n - part, bears)
                    demand[best] = [n - part, 1, self.loss(start + part, n - part, bears)]
                    if room[0] > part and room[1] > 1:
                        continue
                break
            if left or used[0] == self.limits.tokens:
                self.close(pieces)
            else:
                self.halve(pieces)
        self.waiting = [item for item, here in zip(items, alive) if here]

    def halve(self, pieces: list[tuple]) -> None:
        """Sequences whose lengths are the powers of two in the length of the last one."""
        total = sum(length for _, _, length in pieces)
        size = 1 << max(total, 1).bit_length() - 1
        now, held = [], 0
        for document, start, length in pieces:
            while length:
                while not size & total:
                    size >>= 1
                part = min(length, size - held)
                now.append((document, start, part))
                start, length, held = start + part, length - part, held + part
                if held == size:
                    self.close(now)
                    now, held, size = [], 0, size >> 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    end: int,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    no_loss_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    no_loss_col counts a document's leading tokens that bear no loss, such as a prompt; none by default.
    """
    fill = F.coalesce(F.col(no_loss_col).cast("bigint"), F.lit(0)) if no_loss_col else F.lit(0).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), fill.alias("bears"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens_of(tokenizer, end)
        packer = Packer(limits, TaskContext.get().partitionId() << 36)

        def made() -> pa.RecordBatch:
            done, packer.out = packer.out, []
            rows = [
                (doc, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, sequence, offset)
                for (doc, ids), start, n, sequence, offset in done
            ]
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                coded = coder.of(texts(batch.column(1)))
                for doc, ids, bears in zip(batch.column(0).to_pylist(), coded, batch.column(2).to_pylist()):
                    packer.add((doc, ids), len(ids) // 4, max(0, bears))
                yield made()
        packer.fill(0)
        yield made()

    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
