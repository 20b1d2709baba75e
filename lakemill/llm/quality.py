"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import flat, slices, split
from lakemill.llm.keys import named
from lakemill.llm.storage import cut

#: Classes of bytes that are counted; bytes above 127 belong to letters.
CLASSES = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "stop": b".,;:?'\"()-", "shout": b"!", "bar": b"|/\\_<>[]{}", "sign": b"#$%&*+=@^~`", "high": range(128, 256)}
CLASS_OF = np.zeros(256, dtype=np.int64)
for _i, _bytes in enumerate(CLASSES.values()):
    CLASS_OF[list(_bytes)] = _i + 1
#: What statistics() returns of each text, in this order.
STATISTICS = ("log_bytes", *CLASSES, "other", "log_words", "word_length", "distinct_words", "repeated_words", "log_lines", "distinct_lines", "line_words", "top_word")
#: Where scores are counted for calibration.
BINS, LOW, HIGH = 4096, -1.0, 2.0


def statistics(text: pa.Array) -> np.ndarray:
    """Statistics of each whole text; zeros for null and empty ones."""
    text = pc.fill_null(text, "")
    n = len(text)
    raw, sizes = flat(text)
    width = len(CLASSES) + 1
    classes = np.bincount(np.repeat(np.arange(n) * width, sizes) + CLASS_OF[raw], minlength=n * width).reshape(n, width)
    share = classes / np.maximum(1, sizes)[:, None]
    ids, vocabulary, words = split(text, r"\s+", lower=False)
    doc = np.repeat(np.arange(n), words)
    letters = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0)
    owner, kind_uses = np.unique(doc * max(1, len(vocabulary)) + ids, return_counts=True)
    owner = owner // max(1, len(vocabulary))
    top = np.zeros(n)
    np.maximum.at(top, owner, kind_uses)
    again = np.bincount(doc[1:], (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
    lines, line_kinds, line_counts = split(pc.replace_substring(text, " ", " "), r"\n+", lower=False)
    line_owner = np.unique(np.repeat(np.arange(n), line_counts) * max(1, len(line_kinds)) + lines) // max(1, len(line_kinds))
    per_word = np.maximum(1, words)
    return np.column_stack(
        [np.log1p(sizes), share[:, 1:], share[:, 0], np.log1p(words), np.bincount(doc, letters, minlength=n) / per_word, np.bincount(owner, minlength=n) / per_word, again / per_word]
        + [np.log1p(line_counts), np.bincount(line_owner, minlength=n) / np.maximum(1, line_counts), np.log1p(words / np.maximum(1, line_counts)), top / per_word]
    )


@dataclasses.dataclass
class Model:
    """Scaling of statistics, random frequencies and phases, ridge weights, and the calibrated score of each bin."""

    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    inverse: np.ndarray
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, whose inner products approach a Gaussian kernel, and a constant."""
        z = np.cos((x - self.mean) / self.spread @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated[bin_of(self.features(x) @ self.weights)]


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The rising fit to the share of ones in each bin, by pooling adjacent violators.

    Each pool counts one more row of either kind, so that no score is certain;
    bins without rows get what lies between their neighbours.
    """
    pools: list[list[float]] = []
    used = np.flatnonzero(total)
    for b in used.tolist():
        pools.append([ones[b], total[b], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.full(len(total), 0.5)
    fit = np.repeat([(p[0] + 1) / (p[1] + 2) for p in pools], [int(p[2]) for p in pools])
    return np.interp(np.arange(len(total)), used, np.maximum.accumulate(fit))


def held_out(id_col: str) -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(named(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x, held_out): the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, part.column("held_out")], ["id", "x", "held_out"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out")).mapInArrow(run, f"id {kind}, x array<double>, held_out boolean")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def add_up(parts: DataFrame, fan: int = 32) -> np.ndarray | None:
    """The sum of all arrays, of floats or doubles, in the column ``v``, ``fan`` of them in a task at a time; none if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["v"])

    parts = cut(parts, "sums")
    while (rows := parts.count()) > 1:
        parts = cut(parts.repartition(-(-rows // fan)).mapInArrow(run, parts.schema), "sums")
    return np.array(parts.first().v) if rows else None


def leave_one_out(z: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """What a ridge fitted without each row in turn, with all of its weight ``w``, would give that row; ``inverse`` is of the penalised normal matrix."""
    leverage = np.minimum(0.999, w * np.einsum("ni,ij,nj->n", z, inverse, z, optimize=True))
    return (z @ weights - leverage * y) / (1 - leverage)


def learn(train: DataFrame, features: int = 200, scale: float = 3.0, ridge: float = 1e-3, seed: int = 11) -> Model | None:
    """Fit on all rows of ``train`` (``x``, ``y`` from 0 to 1 and the weight ``w``); none if there are none.

    Each partition sums its part of the normal equations into one array, and
    arrays are added up in a tree, so that neither a task nor the driver gets
    more than a few of them. Calibration uses each row's leave-one-out score, which ridge has
    in closed form, counted in bins by partition in the same way.
    """
    size = len(STATISTICS)
    moments = [f(F.get("x", i)).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = train.agg(F.count("*").alias("n"), *moments).first()
    if not found.n:
        return None
    random = np.random.default_rng(seed)
    mean, spread = (np.array([found[f"{k}{i}"] for i in range(size)]) for k in "ms")
    spread = np.where(spread > 1e-9, spread, 1.0)
    model = Model(mean, spread, random.standard_normal((size, features)) / scale, random.uniform(0, 2 * np.pi, features), np.zeros(0), np.zeros(0), np.zeros(0))
    upper = np.triu_indices(features + 1)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, rows = np.zeros((features + 1, features + 2)), 0
        for batch in batches:
            if batch.num_rows:
                z = model.features(matrix(batch))
                both += (z * batch.column("w").to_numpy()[:, None]).T @ np.column_stack([z, batch.column("y").to_numpy()])
                rows += len(z)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([both[:, :-1][upper], both[:, -1]])])], ["v"])

    total = add_up(train.mapInArrow(equations, "v array<double>"))
    normal = np.zeros((features + 1, features + 1))
    normal[upper] = total[: len(upper[0])]
    normal = normal + np.triu(normal, 1).T
    penalty = ridge * found.n * np.eye(features + 1) / features
    penalty[-1, -1] = 0
    model.inverse = np.linalg.pinv(normal + penalty, hermitian=True)
    model.weights = model.inverse @ total[len(upper[0]) :]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros(2 * BINS)
        for batch in batches:
            if batch.num_rows:
                z, y, w = model.features(matrix(batch)), batch.column("y").to_numpy(), batch.column("w").to_numpy()
                b = bin_of(leave_one_out(z, y, w, model.weights, model.inverse))
                both += np.bincount(np.concatenate([b, b + BINS]), np.concatenate([w, w * y]), minlength=2 * BINS)
        if both.any():
            yield pa.RecordBatch.from_arrays([pa.array([both])], ["v"])

    model.calibrated = isotonic(*add_up(train.mapInArrow(counts, "v array<double>")).reshape(2, -1))
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """How likely each whole text is of label 1.

    Returns ``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from
    ``threshold`` on), a row for each row. The model learns from all labelled
    documents that are not held out, by their texts' statistics alone; labels
    that are null or belong to no document don't count, and a document with
    several labels counts once for each. Null and empty texts are scored by
    statistics of zero. Null ids are neither held out nor learned from. Repeated
    rows and other columns don't matter; without labels every score is 0.5; an
    empty table gives no rows.

    Very long texts are read whole, in one pass, and bring one row of statistics like others; texts of equal
    statistics are scored alike, and of equal raw scores calibration makes one pool.

    Texts are read once, for statistics, which are written down; labels are joined
    with those.
    """
    profiles = cut(profile(docs, id_col, text_col), "statistics")
    known = labels.where(named(label_col).isNotNull() & named(id_col).isNotNull()).select(named(id_col).alias("known_id"), (named(label_col) > 0).cast("double").alias("y"))
    # one row for each id, so that an id with many rows on both sides isn't paired with itself
    known = known.groupBy("known_id").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))
    train = cut(profiles.where("not held_out").join(known, F.col("id") == F.col("known_id")).select("x", "y", "w"), "train")
    model = learn(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(matrix(batch)) if model is not None else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return profiles.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
