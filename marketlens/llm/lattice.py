"""Document likelihood under a subword unigram model, summed over all segmentations.

The pieces are those of a public vocabulary; a word is a blank and its bytes. Pieces start with
weights that fall with their rank in the vocabulary, and are re-estimated from the training texts:
every distinct word adds the expected use of each piece over all its
segmentations. A word's probability is the sum over all its segmentations, by a forward recursion in
log space; a text's is the product over its words and one end symbol, summed over the classes of training rows
(languages, say), each with its own word weights. A training word has one more
arc that spans it, weighted by its count less `DISCOUNT`; what the discounts free is the weight of the
pieces, which are estimated from the distinct words, as they have to stand for words not met yet. Bytes without a piece of their
own have a byte piece, so every text has a probability above zero.

Word counts grow with the corpus and stay distributed. Only words above a count that at most
`FREQUENT` words reach are sent to all tasks; all others meet their counts in a join.

Empty cases: a null text is empty and scored as one end symbol; an empty table gives an empty
result; without training rows every count is 0; null ids count as training rows and are carried
along; equal rows are scored separately.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import U64, mixed, stage, texts, words_of

FREQUENT = 1 << 18
CLASSES = 7
ROUNDS = 2
DISCOUNT = 0.75
_BASE = U64(0x9E3779B97F4A7C15)
_SLOTS = 20
#: Bytes of words times piece lengths handled at a time.
_CELLS = 600_000


def pieces_of(model_file: str) -> list[bytes]:
    """Ordinary pieces as bytes, by rank, with a blank for the word mark."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    found = []
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k).replace("▁", " ")
        if " " not in piece[1:]:
            found.append(piece.encode())
    return found


class Lattice:
    """Segmentations of words into pieces; `weights` has a probability for each piece, byte and the end of a word, in that order."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        with np.errstate(divide="ignore"):
            self.log = np.append(np.log(weights), -np.inf)
        self.none = len(self.log) - 1
        self.powers = np.cumprod(np.concatenate([[U64(1)], np.full(self.longest, _BASE)]), dtype=U64)
        self.keys = np.zeros(1 << _SLOTS, U64)
        self.ids = np.full(1 << _SLOTS, self.none, np.int32)
        self.probes = 1
        self.byte = self.n + np.arange(256)
        keys = np.array([self.key(piece) for piece in pieces], U64)
        slots = (mixed(keys) >> U64(64 - _SLOTS)).tolist()
        for k, (piece, key, slot) in enumerate(zip(pieces, keys, slots)):
            step = 1
            while self.ids[slot] != self.none:
                slot, step = (slot + 1) % (1 << _SLOTS), step + 1
            self.keys[slot], self.ids[slot] = key, k
            self.probes = max(self.probes, step)
            if len(piece) == 1:
                self.byte[piece[0]] = k

    @staticmethod
    def key(piece: bytes) -> int:
        key = 0
        for x in piece:
            key = (key * int(_BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def arcs(self, words: np.ndarray) -> np.ndarray:
        """ids[w, i, l]: the piece that covers l + 1 bytes of word w from byte i, or none. words: equal lengths."""
        count, size = words.shape
        sums = np.zeros((count, size + 1), U64)
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * _BASE + words[:, i].astype(U64) + U64(1)
        reach = min(self.longest, size)
        found = np.full((count, size, reach), self.none, np.int32)
        found[:, :, 0] = self.byte[words]
        for length in range(2, reach + 1):
            keys = sums[:, length:] - sums[:, :-length] * self.powers[length]
            slot = (mixed(keys) >> U64(64 - _SLOTS)).astype(np.int64)
            hit = np.full(keys.shape, self.none, np.int32)
            for step in range(self.probes):
                at = (slot + step) & ((1 << _SLOTS) - 1)
                here = self.keys[at] == keys
                hit[here] = self.ids[at[here]]
            found[:, : size - length + 1, length - 1] = hit
        return found

    @staticmethod
    def summed(terms: np.ndarray) -> np.ndarray:
        most = terms.max(axis=1)
        return most + np.log(np.exp(terms - most[:, None]).sum(axis=1))

    def forward(self, scores: np.ndarray) -> np.ndarray:
        count, size, reach = scores.shape
        total = np.full((count, size + 1), -np.inf)
        total[:, 0] = 0
        for end in range(1, size + 1):
            lengths = np.arange(min(reach, end))
            starts = end - 1 - lengths
            total[:, end] = self.summed(total[:, starts] + scores[:, starts, lengths])
        return total

    def backward(self, scores: np.ndarray) -> np.ndarray:
        count, size, reach = scores.shape
        total = np.full((count, size + 1), -np.inf)
        total[:, size] = 0
        for start in range(size - 1, -1, -1):
            lengths = np.arange(min(reach, size - start))
            total[:, start] = self.summed(total[:, start + 1 + lengths] + scores[:, start, lengths])
        return total

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of words of one length, and their bytes with the blank in front."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            size = sizes[order[start]]
            end = int(np.searchsorted(sizes[order], size, "right"))
            per = max(1, int(_CELLS // ((size + 1) * self.longest)))
            for at in range(start, end, per):
                some = order[at : min(at + per, end)]
                raw = b"".join(b" " + words[k] for k in some)
                yield some, np.frombuffer(raw, np.uint8).reshape(len(some), size + 1)
            start = end

    def scores(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word, summed over its segmentations."""
        out = np.empty(len(words))
        for some, raw in self.groups(words):
            out[some] = self.forward(self.log[self.arcs(raw)])[:, -1] + self.log[-2]
        return out / math.log(10)

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece and byte, over all segmentations of all words."""
        total = np.zeros(self.none + 1)
        for some, raw in self.groups(words):
            ids = self.arcs(raw)
            scores = self.log[ids]
            ahead, behind = self.forward(scores), self.backward(scores)
            size = raw.shape[1]
            for length in range(ids.shape[2]):
                span = size - length
                share = np.exp(ahead[:, :span] + scores[:, :span, length] + behind[:, length + 1 :] - ahead[:, -1:])
                total += np.bincount(ids[:, :span, length].ravel(), (share * counts[some][:, None]).ravel(), len(total))
        return total[: self.none]


def _counter(places: dict):
    other = max(places.values(), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                found: dict[int | None, Counter] = {}
                for text, held, kind in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    found.setdefault(None if held else places.get(kind, other), Counter()).update(words_of(text))
                for place, counts in found.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(counts.keys(), pa.binary()), pa.array([place] * len(counts), pa.int32()), pa.array(counts.values(), pa.int64())],
                        names=["word", "place", "uses"],
                    )

    return run


def learned(words: DataFrame, pieces: list[bytes]) -> np.ndarray:
    """Weights of pieces, bytes and the end of a word after re-estimating them from all training words."""
    weights = np.concatenate([1 / np.arange(2, len(pieces) + 2), np.full(256, 0.1 / len(pieces)), [1.0]])
    weights /= weights.sum()
    train = words.filter("c > 0").select("word")
    distinct = train.count()
    for _ in range(ROUNDS):
        shared = words.sparkSession.sparkContext.broadcast((pieces, weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            total = np.zeros(lattice.none)
            for batch in batches:
                total += lattice.expected(batch.column(0).to_pylist(), np.ones(batch.num_rows))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        found = train.mapInArrow(run, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        total = np.full(len(weights), 0.1)
        for row in found:
            total[row.piece] += row.uses
        total[-1] += distinct
        weights = total / total.sum()
    return weights


def score_documents(
    docs: DataFrame, vocabulary: str, held_out, class_col: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    held_out: a boolean column of docs; the other rows are learned from. vocabulary: a sentencepiece model file.
    class_col divides the training rows into classes with word weights of their own, the CLASSES most frequent and
    the rest; a text is scored as the mixture of all of them, whatever its own class.
    """
    spark = docs.sparkSession
    kind = F.col(class_col).cast("string") if class_col else F.lit("")
    docs = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"), kind.alias("kind")
    )
    kinds = docs.filter(~F.col("held_out")).groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(CLASSES).collect()
    ends = docs.filter(~F.col("held_out")).count()
    places = {row.kind: k for k, row in enumerate(kinds)}
    ends_in = [row["count"] for row in kinds] or [0]
    if sum(ends_in) < ends:
        places[("the rest",)] = len(ends_in)  # no text is equal to this key
        ends_in.append(ends - sum(ends_in))
    n_classes = len(ends_in)
    in_class = [F.sum(F.when(F.col("place") == k, F.col("uses")).otherwise(0)).alias(f"c{k}") for k in range(n_classes)]
    words = stage(
        docs.select("text", "held_out", "kind")
        .mapInArrow(_counter(places), "word binary, place int, uses bigint")
        .groupBy("word")
        .agg(F.sum("uses").alias("uses"), F.sum(F.when(F.col("place").isNotNull(), F.col("uses")).otherwise(0)).alias("c"), *in_class),
        "words",
    )
    sums = words.agg(
        F.sum("c").alias("c"),
        F.count_if(F.col("c") > 0).alias("v"),
        *[F.sum(f"c{k}").alias(f"c{k}") for k in range(n_classes)],
        *[F.count_if(F.col(f"c{k}") > 0).alias(f"v{k}") for k in range(n_classes)],
    ).first()
    train_tokens, distinct = (sums.c or 0) + ends, sums.v + (ends > 0)
    pieces = pieces_of(vocabulary)
    shared = spark.sparkContext.broadcast((pieces, learned(words, pieces)))

    # One more word and one more end than were met in each class, so that neither has weight zero.
    events = np.array([(sums[f"c{k}"] or 0) + ends_in[k] + 2 for k in range(n_classes)], float)
    spare = (DISCOUNT * np.array([sums[f"v{k}"] for k in range(n_classes)]) + 1) / events
    logs = [f"log_p{k}" for k in range(n_classes)]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            pieced = lattice.scores(batch.column(0).to_pylist())
            columns = [batch.column(0), batch.column(1), batch.column(2)]
            for k in range(n_classes):
                by_pieces = np.log10(spare[k]) + pieced
                with np.errstate(divide="ignore"):
                    whole = np.log10(np.maximum(batch.column(3 + k).to_numpy() - DISCOUNT, 0) / events[k])
                best = np.maximum(by_pieces, whole)
                columns.append(pa.array(best + np.log10(10 ** (by_pieces - best) + 10 ** (whole - best))))
            yield pa.RecordBatch.from_arrays(columns, names=["word", "uses", "c", *logs])

    rated = stage(words.mapInArrow(rate, "word binary, uses bigint, c bigint, " + ", ".join(f"{x} double" for x in logs)), "rated")
    # The most frequent words, as many as fit the bound: those above a number of uses that few enough reach.
    fewest, held = 0, 0
    for row in rated.groupBy("uses").count().filter("uses > 1").orderBy(F.desc("uses")).limit(FREQUENT).toLocalIterator():
        if held + row["count"] > FREQUENT:
            break
        fewest, held = row.uses, held + row["count"]
    top = rated.filter(F.col("uses") >= fewest).collect() if held else []
    common = spark.sparkContext.broadcast(
        (
            {bytes(row.word): k for k, row in enumerate(top)},
            np.array([[math.log10(row.c + 1), row.c > 0, *(row[x] for x in logs)] for row in top] + [[0] * (2 + n_classes)], float),
        )
    )

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, values = common.value
        get, rest = place.get, len(place)
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                rows, rare_keys, rare_words, rare_counts = [], [], [], []
                for text in texts(batch.column(1)):
                    split = words_of(text)
                    found = np.array([get(word, rest) for word in split], np.int64)
                    rows.append((key, len(split) + 1, *(values[found].sum(axis=0) if split else values[rest])))
                    if rest in found:
                        rare = Counter(split[k] for k in np.flatnonzero(found == rest).tolist())
                        rare_keys += [key] * len(rare)
                        rare_words += rare.keys()
                        rare_counts += rare.values()
                    key += 1
                columns = [pa.array(x) for x in zip(*rows)]
                n, m = len(rows), len(rare_keys)
                longer = lambda x: pa.concat_arrays([x, pa.nulls(m, x.type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*columns[0].to_pylist(), *rare_keys], pa.int64()),
                        longer(batch.column(0)),
                        longer(batch.column(2)),
                        *[longer(x) for x in columns[1:]],
                        pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(rare_words, pa.binary())]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rare_counts, pa.int64())]),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "base", "known", *logs, "word", "uses"],
                )

    parts = stage(
        docs.select("doc_id", "text", "held_out").mapInArrow(
            partly,
            "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, base double, known double, "
            + "".join(f"{x} double, " for x in logs)
            + "word binary, uses bigint",
        ),
        "parts",
    )
    rare = (
        parts.filter("word is not null")
        .select("row", "word", "uses")
        .join(rated.select("word", "c", *logs), "word")
        .groupBy("row")
        .agg(
            F.sum(F.col("uses") * F.log10(F.col("c") + 1)).alias("rare_base"),
            F.sum(F.when(F.col("c") > 0, F.col("uses")).otherwise(0)).alias("rare_known"),
            *[F.sum(F.col("uses") * F.col(x)).alias(f"rare_{x}") for x in logs],
        )
    )
    end_base, unit = math.log10(ends + 1), math.log10(train_tokens + 1 * (distinct + 1))
    zero = lambda name: F.coalesce(name, F.lit(0))
    # A class's weight is its share of the training rows.
    by_class = [
        F.col(x) + zero(f"rare_{x}") + math.log10((ends_in[k] + 1) / events[k]) + math.log10((ends_in[k] + 1) / (ends + n_classes))
        for k, x in enumerate(logs)
    ]
    totals = [F.col(f"total{k}") for k in range(n_classes)]
    return (
        parts.filter("word is null")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known").cast("bigint") + zero("rare_known") + int(ends > 0)).alias("n_known"),
            F.lit(train_tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + zero("rare_base") + end_base - F.col("n_tokens") * unit).alias("base_score"),
            *[total.alias(f"total{k}") for k, total in enumerate(by_class)],
        )
        .withColumn("best", F.greatest(*totals) if n_classes > 1 else totals[0])
        .withColumn("score", F.col("best") + F.log10(sum((F.pow(F.lit(10.0), t - F.col("best")) for t in totals), F.lit(0.0))))
        .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )
