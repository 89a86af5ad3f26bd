"""Removal of every byte covered by a string of N bytes that also starts elsewhere, by a hash-compared suffix sort.

A window is N consecutive bytes of one text. Windows with equal bytes have equal smallest hashes of
their GRAM-byte strings, so texts are cut into units: runs of windows with the same smallest hash.
Only units whose hash occurs in another unit can repeat. Units with the same bytes repeat wholly.
The different units of one hash are sorted by the suffixes that start at the hashed string:
a merge sort whose comparisons find the common extension of two suffixes by binary search over prefix
polynomial hashes, in a logarithmic number of steps. Neighbours in that order share the longest
right extensions; the left ones are found in the same way. A pair whose extensions span N bytes
marks the windows inside, after its bytes have been compared.

A hash with more than LARGE different units (a passage found in very many texts), or that occurs twice
in one unit (text with a short period), is never gathered in one task: the windows of its units are
counted by Spark under two hashes.

Empty cases: null and short texts lose nothing; an empty table gives an empty result; a null id is
carried along; equal rows are each other's copies, and both lose all windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import U64, mixed, stage, texts

N, GRAM = 400, 200
LARGE = 2048
#: Bytes of texts hashed at a time; a longer text is hashed alone.
_CHUNK = 1 << 20
_B = 0x9E3779B97F4A7C15
_NO_ID = -(2**63)


class Prefix:
    """Polynomial hashes, modulo 2**64, of all substrings of some bytes."""

    _powers = _inverse = np.ones(1, U64)

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if len(Prefix._powers) <= n:
            size = max(n, _CHUNK) + 1
            ones = lambda base: np.cumprod(np.concatenate([[U64(1)], np.full(size, U64(base))]), dtype=U64)
            Prefix._powers, Prefix._inverse = ones(_B), ones(pow(_B, -1, 2**64))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * self._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self._inverse[start]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    rows = -(-len(x) // width)
    padded = np.full(rows * width, ~U64(0))
    padded[: len(x)] = x
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - width + 1], ahead[width - 1 : len(x)])


def units(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window, number of windows, smallest hash and whether it is met twice, of each unit of some texts."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(x) for x in parts])
    ends = np.cumsum(size)
    starts = ends - size
    prefix = Prefix(raw)
    at = np.arange(len(raw) - GRAM + 1)
    hashes = mixed(prefix.of(at, at + GRAM))
    wide = N - GRAM + 1
    least = _sliding_min(hashes, wide)
    inside = np.zeros(len(raw) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - N + 1, -1)
    inside = np.cumsum(inside)[: len(least)] > 0
    first = np.ones(len(least), bool)
    first[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    first[starts[starts < len(least)]] = True
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(least)))
    keep = inside[begin]
    begin, count = begin[keep], count[keep]
    text = np.searchsorted(ends, begin, "right")
    # The first place of the hash in the first window and the last one in the last window.
    tied = np.zeros(len(begin), bool)
    views = np.lib.stride_tricks.sliding_window_view(hashes, wide)
    for k in range(0, len(begin), 2000):
        b, last = begin[k : k + 2000], begin[k : k + 2000] + count[k : k + 2000] - 1
        low = b + (views[b] == least[b][:, None]).argmax(axis=1)
        high = last + wide - 1 - (views[last][:, ::-1] == least[b][:, None]).argmax(axis=1)
        tied[k : k + 2000] = low < high
    return text, begin - starts[text], count, least[begin], tied


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (its size and digest) and one for each unit."""
    names = ["doc_id", "text_hash", "n_bytes", "digest", "start", "windows", "gram", "content", "tied"]
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            found = texts(batch.column(2))
            none = lambda kind: pa.nulls(batch.num_rows, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    none(pa.int32()),
                    none(pa.int32()),
                    none(pa.int64()),
                    none(pa.int64()),
                    none(pa.bool_()),
                ],
                names=names,
            )
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            long = [k for k, x in enumerate(found) if len(x) >= N]
            while long:
                some, size = [], 0
                while long and (not some or size + len(found[long[-1]]) <= _CHUNK):
                    some.append(long.pop())
                    size += len(found[some[-1]])
                text, start, count, gram, tied = units([found[k] for k in some])
                rows = np.array(some)[text]
                content = np.array(
                    [xxhash.xxh3_64_intdigest(found[k][s:e]) for k, s, e in zip(rows.tolist(), start.tolist(), (start + count + N - 1).tolist())], U64
                )
                blank = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[rows]),
                        pa.array(hashes[rows]),
                        blank,
                        pa.nulls(len(rows), pa.string()),
                        pa.array(start.astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(gram.astype(np.int64)),
                        pa.array(content.astype(np.int64)),
                        pa.array(tied),
                    ],
                    names=names,
                )


class Suffixes:
    """Suffixes that start at hashed strings in unit texts of several hashes, in sorted order."""

    def __init__(self, groups: np.ndarray, parts: list[bytes], grams: np.ndarray):
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(x) for x in parts])
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.prefix = Prefix(self.raw)
        at = np.arange(len(self.raw) - GRAM + 1)
        owner = np.searchsorted(self.end, at, "right")
        here = (mixed(self.prefix.of(at, at + GRAM)).astype(np.int64) == grams[owner]) & (at + GRAM <= self.end[owner])
        self.at, self.unit = at[here], owner[here]
        self.group = groups[self.unit]
        self.low, self.high = self.begin[self.unit], self.end[self.unit]
        order = np.lexsort((self.at, self.group))
        self.order = self.sorted(order)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes to the right of items i and j, at most N, by binary search."""
        x, y = self.at[i], self.at[j]
        most = np.minimum(np.minimum(self.high[i] - x, self.high[j] - y), N)
        return self.search(most, lambda n: self.prefix.of(x, x + n) == self.prefix.of(y, y + n))

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes to the left."""
        x, y = self.at[i], self.at[j]
        most = np.minimum(np.minimum(x - self.low[i], y - self.low[j]), N)
        return self.search(most, lambda n: self.prefix.of(x - n, x) == self.prefix.of(y - n, y))

    @staticmethod
    def search(most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros_like(most), most
        while (low < high).any():
            half = (low + high + 1) // 2
            same = equal(half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether item i sorts before item j: by hash, bytes to the right, then bytes to the left, read backwards."""
        right, left = self.extension(i, j), self.behind(i, j)
        last = len(self.raw) - 1
        x, y = self.at[i] + right, self.at[j] + right
        ends = lambda k, at: np.where(at < np.minimum(self.high[k], self.at[k] + N), self.raw[np.minimum(at, last)].astype(np.int64), -1)
        a, b = ends(i, x), ends(j, y)
        u, v = self.at[i] - left - 1, self.at[j] - left - 1
        starts = lambda k, at: np.where(at >= np.maximum(self.low[k], self.at[k] - N), self.raw[np.maximum(at, 0)].astype(np.int64), -1)
        c, d = starts(i, u), starts(j, v)
        return np.where(
            self.group[i] != self.group[j], self.group[i] < self.group[j], np.where(a != b, a < b, np.where(c != d, c < d, i < j))
        )

    def sorted(self, order: np.ndarray) -> np.ndarray:
        """Merge sort from the bottom: each item's place in the other run is found by binary search, all items at once."""
        n, width = len(order), 1
        while width < n:
            place = np.arange(n)
            run = place // width
            other = np.where(run % 2 == 0, run + 1, run - 1)
            first = np.minimum(other * width, n)
            low, high = first.copy(), np.minimum(first + width, n)
            while (low < high).any():
                half = (low + high) // 2
                open_ = low < high
                smaller = self.before(order[np.where(open_, half, 0)], order)
                low, high = np.where(open_ & smaller, half + 1, low), np.where(open_ & ~smaller, half, high)
            target = (run // 2) * 2 * width + (place - run * width) + (low - first)
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, 2 * width
        return order

    def repeated(self) -> np.ndarray:
        """Pieces of the units that windows repeated elsewhere cover: rows of unit, start, end."""
        n, out = len(self.order), []
        if n < 2:
            return np.empty((0, 3), np.int64)
        step = self.extension(self.order[:-1], self.order[1:])
        step[self.group[self.order[:-1]] != self.group[self.order[1:]]] = 0
        for back in (False, True):
            here = np.arange(n)
            there = here.copy()
            right, longest = np.full(n, N), np.full(n, -1)
            while True:
                there = there - 1 if back else there + 1
                keep = (there >= 0) & (there < n)
                here, there, right, longest = here[keep], there[keep], right[keep], longest[keep]
                if not len(here):
                    break
                right = np.minimum(right, step[there if back else there - 1])
                i, j = self.order[here], self.order[there]
                room = self.at[i] - self.low[i]
                # Right extensions only get shorter: stop when even all that is on the left would not make a window.
                keep = right + room >= N
                here, there, right, longest, i, j, room = (x[keep] for x in (here, there, right, longest, i, j, room))
                if not len(here):
                    break
                left = self.behind(i, j)
                hit = (left + right >= N) & (left > longest)
                for a, b, x, y in zip(i[hit].tolist(), j[hit].tolist(), left[hit].tolist(), right[hit].tolist()):
                    p, q, unit = int(self.at[a]), int(self.at[b]), int(self.unit[a])
                    if not np.array_equal(self.raw[p - x : p + y], self.raw[q - x : q + y]):
                        raise ValueError("two different strings have one hash; choose another base")
                    out.append((unit, p - x - int(self.begin[unit]), p + y - int(self.begin[unit])))
                longest = np.maximum(longest, left)
                # With all that is on its left an item has met its best partner.
                open_ = left < room
                here, there, right, longest = here[open_], there[open_], right[open_], longest[open_]
        return np.array(out, np.int64).reshape(-1, 3)


def _sort_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by gram: blocks of whole grams are sorted together."""
    held: list[tuple] = []
    size = 0

    def done(rows: list[tuple]) -> pa.RecordBatch:
        ids, hashes, starts, grams, parts = zip(*rows)
        grams = np.array(grams, np.int64)
        groups = np.unique(grams, return_inverse=True)[1]
        found = Suffixes(groups, list(parts), grams).repeated()
        unit = found[:, 0].tolist()
        base = np.array(starts, np.int64)[found[:, 0]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in unit], pa.int64()),
                pa.array([hashes[k] for k in unit], pa.int64()),
                pa.array(base + found[:, 1]),
                pa.array(base + found[:, 2]),
            ],
            names=["doc_id", "text_hash", "s", "e"],
        )

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if size > 4 * _CHUNK and row[3] != held[-1][3]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield done(held)


def _unit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, key, text, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
            raw = (text or "").encode()
            rows += [(doc, key, u["start"], u["gram"], raw[u["start"] : u["start"] + u["windows"] + N - 1], u["large"]) for u in found]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text_hash", "start", "gram", "raw", "large"]
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of a unit, with two hashes."""
    for batch in batches:
        for doc, key, start, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            at = np.arange(len(raw) - N + 1)
            one = mixed(Prefix(np.frombuffer(raw, np.uint8)).of(at, at + N)).astype(np.int64)
            two = np.array([xxhash.xxh3_64_intdigest(raw[k : k + N]) for k in at.tolist()], U64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * len(at), pa.int64()), pa.array([key] * len(at), pa.int64()), pa.array(start + at), pa.array(one), pa.array(two)],
                names=["doc_id", "text_hash", "s", "one", "two"],
            )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, spans, digests, kept = [], [], [], []
        for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            raw = (text or "").encode()
            rest, at, count, runs = [], 0, 0, 0
            for x in sorted(found, key=lambda x: (x["s"], -x["e"])):
                if x["e"] <= at and runs:
                    continue
                if x["s"] > at or not runs:
                    rest.append(raw[at : x["s"]])
                    runs += 1
                    at = x["s"]
                count += x["e"] - at
                at = x["e"]
            rest.append(raw[at:])
            left = b"".join(rest)
            gone.append(count)
            spans.append(runs)
            kept.append(left)
            digests.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "text_hash", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row; with_bytes adds kept, null where nothing goes.

    A cut may split a character, so what is kept is bytes.
    """
    key = ["doc_id", "text_hash"]
    docs = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    cut = stage(
        docs.mapInArrow(
            _cut,
            "doc_id bigint, text_hash bigint, n_bytes bigint, digest string, start int, windows int, gram bigint, content bigint, tied boolean",
        ),
        "units",
    )
    found = cut.filter("gram is not null").select(*key, "start", "windows", "gram", "content", "tied")
    shared = stage(
        found.groupBy("gram").agg(F.min("content").alias("x"), F.max("content").alias("y"), F.count("*").alias("n"), F.max("tied").alias("within"))
        .filter("n > 1 or within")
        .select("gram", "within", (F.col("within") | (F.col("x") < F.col("y"))).alias("several")),
        "shared",
    )
    near = stage(found.join(shared, "gram"), "near")
    # One unit stands for those with its bytes; those that are many repeat wholly.
    distinct = stage(
        near.filter("several").groupBy("gram", "content").agg(F.count("*").alias("n"), F.max("within").alias("within"), F.min(F.struct(*key, "start", "windows")).alias("unit")),
        "distinct",
    )
    many = distinct.groupBy("gram").agg(F.count("*").alias("n"), F.max("within").alias("within")).filter((F.col("n") > LARGE) | F.col("within")).select("gram", F.lit(True).alias("large"))
    chosen = distinct.join(many, "gram", "left").select(
        "unit.*", "gram", "content", "n", F.coalesce("large", F.lit(False)).alias("large")
    )
    chosen = stage(chosen, "chosen")
    texts_needed = near.select(*key).distinct()
    held = stage(docs.join(texts_needed, key, "left_semi").dropDuplicates(key), "texts")
    per_text = chosen.groupBy(*key).agg(F.collect_list(F.struct("start", "windows", "gram", "large")).alias("units"))
    parts = stage(
        held.join(per_text, key).mapInArrow(_unit_texts, "doc_id bigint, text_hash bigint, start int, gram bigint, raw binary, large boolean"),
        "parts",
    )
    span = "doc_id bigint, text_hash bigint, s bigint, e bigint"
    small = parts.filter("not large").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_units, span)
    windows = parts.filter("large").mapInArrow(_windows, "doc_id bigint, text_hash bigint, s bigint, one bigint, two bigint")
    if parts.filter("large").limit(1).count():
        windows = stage(windows, "windows")
        twice = stage(windows.groupBy("one", "two").count().filter("count > 1").select("one", "two"), "twice")
        large = windows.join(twice, ["one", "two"], "left_semi").select(*key, "s", (F.col("s") + N).alias("e"))
    else:
        large = small.limit(0)
    # Units with the same bytes: all units of a hash that has one content, and those counted more than once.
    again = distinct.filter("n > 1").select("gram", "content")
    whole = near.filter("not several").unionByName(near.filter("several").join(again, ["gram", "content"], "left_semi"))
    spans = whole.select(*key, F.col("start").cast("bigint").alias("s"), (F.col("start") + F.col("windows") + N - 1).cast("bigint").alias("e"))
    spans = spans.unionByName(small).unionByName(large).distinct()
    cover = spans.groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    done = held.join(cover, key).mapInArrow(
        _removed, "doc_id bigint, text_hash bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    if not with_bytes:
        done = done.drop("kept")
    return (
        cut.filter("gram is null")
        .select(*key, "n_bytes", "digest")
        .join(done, key, "left")
        .select(
            F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"),
            "n_bytes",
            F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
            F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
            F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
            *(["kept"] if with_bytes else []),
        )
    )
