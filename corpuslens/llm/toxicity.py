"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic
text.  A text is cut into overlapping windows, each window is compressed with
either, and the bytes that the toxic dictionary saves are the window's
evidence.  How the savings of a text's windows are spread becomes one score by
a calibration that is fitted on labelled texts.

What repeats most in toxic text is ordinary language, and a trainer keeps what
repeats most.  So the toxic samples are thinned first: only words that stand in
significantly more toxic than ordinary texts stay.  The ordinary dictionary is
part of both compressors, so that ordinary words cost the same in either."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.shared import stage, text_or_empty, worker_memo

#: Labelled texts of each label that the classifier is fitted on (those whose
#: id has the smallest hash), and pieces of 64 bytes a text, on average, that a
#: dictionary is trained on.
SAMPLE, PIECES = 4000, 50
#: Bytes to a window and from one to the next.
WINDOW, STRIDE = 48, 32
#: Bytes of the dictionaries, and zstandard's level.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 2048
LEVEL = 3
#: Standard errors by which a word must be more frequent in toxic texts, and
#: toxic texts that must have it.
SIGNIFICANT, LEAST_TEXTS = 8.0, 3
#: Savings in bytes that are counted.
STEPS = (1, 2, 3, 4, 5, 6, 8)
FEATURES = 4 + 2 * len(STEPS)

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def windows(text: str) -> Iterator[bytes]:
    """Overlapping windows of the whole text in lower case; an empty text is
    one empty window."""
    raw = text.lower().encode()
    for at in range(0, max(len(raw) - WINDOW, 0) + STRIDE, STRIDE):
        yield raw[at:at + WINDOW]


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_LETTERS).split())


class Compressors:
    """Bytes saved by the toxic dictionary, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        def with_content(content: bytes):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False,
                                            write_checksum=False, write_dict_id=False).compress

        self.plain, self.both = with_content(ordinary), with_content(ordinary + toxic)

    def features(self, text: str) -> np.ndarray:
        """How a text's savings are spread: the largest and second largest,
        the mean, shares and counts of windows over each step, and length."""
        plain, both = self.plain, self.both
        saved = np.array([len(plain(w)) - len(both(w)) for w in windows(text)], float)
        over = [(saved >= k).sum() for k in STEPS]
        return np.array([saved.max(), np.partition(saved, -min(2, len(saved)))[-min(2, len(saved))], saved.mean(),
                         np.log1p(len(saved)), *(n / len(saved) for n in over), *np.log1p(over)])


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self) -> Compressors:
        return worker_memo(("toxicity", hash((self.ordinary, self.toxic))), lambda: Compressors(self.ordinary, self.toxic))

    def score(self, features: np.ndarray) -> np.ndarray:
        """The calibrated probability; the threshold of 0.5 is on it."""
        z = (features - np.array(self.centre)) / np.array(self.spread)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights[:-1]) + self.weights[-1], -500, 500)))


def _train(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; where they are too few
    to train on, samples themselves, drawn evenly."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        step = -(-(sum(map(len, samples)) + len(samples)) // size)
        return b" ".join(samples[::max(step, 1)])[:size] or b" " * 8


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
    """Ridge-penalised logistic regression by Newton's method."""
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / spread, np.ones(len(x))]
    w, held = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        w = w - np.linalg.solve((z * (p * (1 - p) * weight)[:, None]).T @ z + np.diag(held), z.T @ ((p - y) * weight) + held * w)
    return tuple(centre), tuple(spread), tuple(w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE, pieces_each: int = PIECES) -> Model:
    """Fits on up to ``sample`` documents of either label, of which all words
    and windows count; a dictionary is trained on ``sample`` x ``pieces_each``
    pieces of them at most (those of the smallest hashes), which is what the
    driver holds.  ``labels`` holds ids and labels; labels other than 0 and 1
    and ids without a document are left out, an id that is labelled both is
    toxic, and of an id that repeats in ``docs`` the smallest text counts.  With only one label, or none, the model gives every text the
    label's share (0 without labels).

    The sample is drawn from ids alone, and no text is shuffled to get it."""
    marked = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
    known = stage(marked.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi").groupBy("_id").agg(
        F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # at most 2 * sample ids, so they may be broadcast
    ids = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(sample)
        ids = some if ids is None else ids.unionAll(some)
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    chosen = stage(texts.join(F.broadcast(ids.select("_id", "toxic")), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text")))
    taken = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(taken) < 2:
        only = 1 if 1 in taken else 0
        return Model(b" " * 8, b" " * 8, (0.0,) * FEATURES, (1.0,) * FEATURES, (0.0,) * FEATURES + (500.0 if only else -500.0,))

    def each_word(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                if words := sorted(words_of(text)):
                    yield pd.DataFrame({"word": words, "toxic": toxic})

    tally = chosen.select("toxic", "text").mapInPandas(each_word, "word binary, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")).where(F.col("t") >= LEAST_TEXTS)
    n1, n0 = float(taken[1]), float(taken[0])
    pooled = (F.col("t") + F.col("o")) / (n1 + n0)
    z = (F.col("t") / n1 - F.col("o") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    telling = {bytes(r["word"]) for r in tally.where(z >= SIGNIFICANT).select("word").collect()}

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                raw = text.lower().encode()
                if toxic:
                    raw = b" ".join(w for w in raw.translate(_LETTERS).split() if w in telling)
                cut = [b" " + raw[i:i + 64] + b" " if toxic else raw[i:i + 64] for i in range(0, len(raw), 64)]
                if cut:
                    yield pd.DataFrame({"toxic": toxic, "piece": cut})

    pieces = chosen.select("toxic", "text").mapInPandas(samples, "toxic int, piece binary")
    trained = {}
    for label, size in ((0, ORDINARY_BYTES), (1, TOXIC_BYTES)):
        some = pieces.where(F.col("toxic") == label).select("piece", F.xxhash64("piece").alias("h")).orderBy("h", "piece").limit(sample * pieces_each)
        trained[label] = _train([bytes(r["piece"]) for r in some.collect()], size)
    model = Model(trained[0], trained[1], (0.0,) * FEATURES, (1.0,) * FEATURES, (0.0,) * (FEATURES + 1))
    seen = chosen.select("toxic", _features(F.col("text"), model).alias("x")).orderBy("toxic", "x").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float)
    # the sample holds as many of each label as it may; weights restore the shares
    total = counts[0] + counts[1]
    weight = np.where(y == 1, counts[1] / total / taken[1], counts[0] / total / taken[0]) * len(y)
    centre, spread, weights = _calibrate(x, y, weight)
    return Model(trained[0], trained[1], centre, spread, weights)


def _features(text: Column, model: Model) -> Column:
    @F.pandas_udf("array<double>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = model.compressors()
        for batch in texts:
            yield pd.Series([held.features(t) for t in batch], dtype=object)

    return features(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic, from all windows of
    the whole text.  Null counts as empty; an empty text has the score of one
    empty window.  A column that is already called ``score_col`` gives way to
    the new one; repeated rows have equal scores."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = model.compressors()
        for batch in texts:
            yield pd.Series([float(model.score(held.features(t))) for t in batch], dtype=float)

    return docs.withColumn(score_col, of(text_or_empty(text_col)))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that are never learnt from; null ids are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
