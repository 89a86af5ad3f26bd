"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a run of 6 words (short) or 12 words (long), and every word is in one of each. Its length
under the ordinary dictionary less that under the toxic one says how much better toxic text explains
it. A text's windows of either length are counted above several differences, and a logistic fit on
labelled texts that no dictionary has seen calibrates those thresholds.

A dictionary has a part trained on windows of whole texts, of toxic ones or of ordinary ones, without
any choice of words, and the same ordinary text beside it, so that what both know is coded alike. For
short windows that text is met first, which leaves words that only toxic texts have; for long windows
the trained part is, which brings out phrases of ordinary words. A filler ends dictionaries and
windows, so that windows are coded as matches where a dictionary has them. Labels are learned from at
most `per_class` rows of each, of which the shared text is up to `SHARED_BYTES`.

Empty cases: null and empty texts have no window and get the score of that; an empty table gives an
empty result; with labels of one kind only, every score is the smoothed share of label 1; null ids
are carried along; equal rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import texts, words_of
from marketlens.llm.labelled import labelled_sample, logistic

FILLER = bytes(range(128, 192))
TRAINED_BYTES, SHARED_BYTES = 65536, 2_000_000
#: Words in a window, words in a window to train on, bytes of a trained segment, counted differences, search.
SHORT = (6, 8, 24, np.arange(1, 10), zstandard.STRATEGY_LAZY2)
LONG = (12, 24, 64, np.arange(6, 24, 2), zstandard.STRATEGY_GREEDY)


def _windows(words: list[bytes], size: int) -> list[bytes]:
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(0, len(words), size)]


def _trained(parts: list[bytes], size: int, segment: int) -> bytes:
    samples = [x for text in parts for x in _windows(words_of(text), size) if len(x) >= 8]
    try:
        return zstandard.train_dictionary(TRAINED_BYTES, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes are the dictionary
        return b"".join(dict.fromkeys(samples))


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, bytes, bytes]:
    """Dictionaries of toxic and of ordinary texts for short windows, then for long ones."""
    half = len(ordinary) // 2
    shared = b"\n".join(b" ".join(words_of(x)) for x in ordinary[half:])[-SHARED_BYTES:]
    short, long = ([_trained(parts, *how[1:3]) for parts in (toxic, ordinary[:half])] for how in (SHORT, LONG))
    # A search meets what is last first: shared text hides common words in short windows, and no phrases in long ones.
    return *(x + shared + FILLER for x in short), *(shared + x + FILLER for x in long)


class Difference:
    """Bytes that the toxic dictionary saves on windows, short and long."""

    def __init__(self, *raw: bytes):
        def compressor(raw: bytes, strategy: int) -> zstandard.ZstdCompressor:
            how = zstandard.ZstdCompressionParameters(
                window_log=23, hash_log=20, chain_log=20, search_log=4, min_match=4, target_length=8,
                strategy=strategy, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=known, compression_params=how)

        self.pairs = [(how, *(compressor(x, how[-1]) for x in two)) for how, two in ((SHORT, raw[:2]), (LONG, raw[2:]))]

    @staticmethod
    def of(windows: list[bytes], toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
        """One difference per window; 0 where there is no window."""
        if not windows:
            return np.zeros(1, np.int64)
        parts = [x + FILLER for x in windows]
        less, more = (np.fromiter(map(len, one.multi_compress_to_buffer(parts, threads=1)), np.int64, len(parts)) for one in (toxic, ordinary))
        return more - less

    def features(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        found = []
        for (size, _, _, steps, _), toxic, ordinary in self.pairs:
            saved = self.of(_windows(words, size), toxic, ordinary)
            counts = (saved[:, None] >= steps).sum(axis=0)
            found += [np.log1p(counts), counts > 0, [min(max(saved.max(), 0), 2 * steps[-1]) / 4, np.clip(saved.mean(), -3, 3)]]
        return np.concatenate([*found, [np.log1p(len(words)) / 4]])


_MADE: dict[tuple[bytes, ...], Difference] = {}


def difference_of(*raw: bytes) -> Difference:
    """One per Python worker: later tasks use the tables of earlier ones."""
    if raw not in _MADE:
        _MADE.clear()
        _MADE[raw] = Difference(*raw)
    return _MADE[raw]


def fit(rows: list[tuple]) -> tuple:
    """The four dictionaries, then the weights, from (doc_id, label, text). Every second text calibrates."""
    rows = [(label, (text or "").encode()) for _, label, text in rows]
    learn, rest = rows[::2], rows[1::2] or rows
    raw = dictionaries([x for y, x in learn if y], [x for y, x in learn if not y])
    y = np.array([label for label, _ in rest], float)
    size = sum(2 * len(steps) + 2 for *_, steps, _ in (SHORT, LONG)) + 1
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        return *raw, np.append(np.zeros(size), np.log(share / (1 - share)))
    made = Difference(*raw)
    return *raw, logistic(np.array([made.features(x) for _, x in rest]), y, ridge=1e-3)


def toxicity(docs: DataFrame, labels: DataFrame, held_out, per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row; held_out is a condition on doc_id of rows no label is learned from."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, "toxic", ~held_out, per_class)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *raw, weights = model.value
        made = difference_of(*raw)
        for batch in batches:
            x = np.array([made.features(text) for text in texts(batch.column(1))]).reshape(-1, len(weights) - 1)
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = docs.withColumn("held_out", held_out).mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
