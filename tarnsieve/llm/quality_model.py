"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Each whole text becomes some thirty statistics (lengths, shares of character classes, words and lines that repeat,
   how even the characters and words are spread).
2. Labelled rows are gathered by id, and executors sum each statistic and its square over them; scaled statistics become
   `features` random Fourier features, whose products approximate a Gaussian kernel of the given width.
3. Executors sum the normal equations of their rows (features by features, and features by label), partial sums are added
   in a tree of tasks, and the driver solves one system of the model's size: all labelled rows are learned from,
   however many there are.
4. A fifth of the labelled rows, by a hash of the id, is kept from the regression; executors count their predictions by
   label in bins, and pool-adjacent-violators over the bins makes the calibration, read linearly between
   its steps, with a hundredth of the score from the prediction itself, so that it stays strictly rising.

Only statistics of the text are used: labels, language, source and id are no inputs of a score.

Nulls and ties: a null text is an empty one and gets the score of empty texts; null labels are no labels, several
labels of an id count as their maximum, labels without a document are ignored; of documents that repeat a labelled id the least
text is learned from, and all are scored.  Without labels of both classes every score is the share of label 1 (0.0
without labels).  Very long texts are read whole, a million characters at a time, but for their words and lines, whose
distinct hashes are held.  Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, written
from .substrings import _Powers, _rolled
from .toxicity import is_held_out

_BINS, _LOW, _HIGH = 4096, -0.5, 1.5
_powers = _Powers(0x9E3779B97F4A7C15)

# kinds of bytes: white, upper, lower, digit, marks, symbols, quotes and brackets, other ASCII, beyond ASCII
_KIND = np.full(256, 7, np.uint8)
for _k, _bytes in enumerate((b" \t\n\x0b\x0c\r", range(65, 91), range(97, 123), range(48, 58), b".,;:!?", b"#*$%&|<>", b"'\"()[]{}-")):
    _KIND[list(_bytes)] = _k
_KIND[128:] = 8
_KINDS = 9


def _evenness(counts: np.ndarray) -> float:
    """Entropy of counts in bits."""
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def _repeated(hashes: np.ndarray) -> tuple[float, float]:
    """(share of items that repeat an earlier one, share of the most frequent)."""
    if not len(hashes):
        return 0.0, 0.0
    counts = np.unique(hashes, return_counts=True)[1]
    return 1 - len(counts) / len(hashes), float(counts.max()) / len(hashes)


def _hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the runs of bytes that are inside."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, max(1, len(data)), 1 << 20)))
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        if b > a:
            low, high = starts[a], ends[b - 1]
            hashes[a:b] = _rolled(data[low:high].astype(np.uint64) + np.uint64(1), starts[a:b] - low, ends[a:b] - low, _powers)
    return starts, ends, hashes


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, len(data))
    kinds = _KIND[data] if len(data) else np.empty(0, np.uint8)
    shares = np.bincount(kinds, minlength=_KINDS) / n
    starts, ends, words = _hashes(data, kinds != 0)
    _, line_ends, lines = _hashes(data, data != 10)
    lengths = ends - starts
    m = max(1, len(words))
    first, last = (kinds[starts], kinds[ends - 1]) if len(words) else (np.empty(0, np.uint8),) * 2
    three = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7) if len(words) > 2 else words[:0]
    counts = np.bincount(data, minlength=256)
    marked = kinds[line_ends - 1] == 4 if len(lines) else np.empty(0, bool)
    same = float((data[1:] == data[:-1]).mean()) if len(data) > 1 else 0.0
    changes = float((kinds[1:] != kinds[:-1]).mean()) if len(data) > 1 else 0.0
    word_counts = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(1)
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(len(words) / max(1, len(lines))),
        *shares,
        lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0, np.log1p(lengths.max(initial=0)),
        (first == 1).sum() / m, ((first == 1) & (last == 1)).sum() / m, (last == 4).sum() / m, (last == 5).sum() / m, (lengths == 1).sum() / m, (lengths > 15).sum() / m,
        *_repeated(words), *_repeated(lines), *_repeated(three), _evenness(word_counts) / np.log2(m + 1),
        _evenness(counts), counts[ord("!")] / n, counts[ord("|")] / n, counts[ord(".")] / n, marked.mean() if len(marked) else 0.0, same, changes,
    ])


N_STATISTICS = len(statistics("a"))


@dataclass
class Model:
    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    directions: np.ndarray | None = None
    shifts: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.shifts) * np.sqrt(2 / self.directions.shape[1])
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), self.share)
        raw = self.raw(x)
        told = (np.clip(raw, _LOW, _HIGH) - _LOW) / (_HIGH - _LOW)
        return 0.99 * np.interp(raw, *self.steps) + 0.01 * told


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising shares nearest to positive / total, by weight; for each of the bins."""
    shares, weights, sizes = [], [], []
    for p, t in zip(positive.tolist(), total.tolist()):
        shares.append(p / t)
        weights.append(t)
        sizes.append(1)
        while len(shares) > 1 and shares[-2] >= shares[-1]:
            w = weights[-2] + weights[-1]
            shares[-2:] = [(shares[-2] * weights[-2] + shares[-1] * weights[-1]) / w]
            weights[-2:], sizes[-2:] = [w], [sizes[-2] + sizes[-1]]
    return np.repeat(shares, sizes)


def _summed(rows: DataFrame, function, fan: int = 64) -> np.ndarray:
    """The sum of function(batches), one array of a fixed size for each task, added in a tree of tasks."""

    def partial(batches):
        yield pa.RecordBatch.from_arrays([pa.array([function(batches).tobytes()], pa.binary())], names=["sums"])

    def add(batches):
        total = None
        for batch in batches:
            for blob in batch.column("sums"):
                part = np.frombuffer(blob.as_buffer(), np.float64)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.mapInArrow(partial, "sums binary").repartition(fan).mapInArrow(add, "sums binary")
    # at most `fan` rows of the model's size reach one task, and one the driver
    return np.frombuffer(parts.coalesce(1).mapInArrow(add, "sums binary").first()[0], np.float64)


def _matrix(batch) -> np.ndarray:
    column = batch.column("x")
    flat = column.flatten() if isinstance(column, pa.ListArray) else column
    return flat.to_numpy().reshape(-1, N_STATISTICS)


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", features: int = 384, width: float = 1.0, ridge: float = 1e-4, seed: int = 13, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from all labelled documents that are not held out.  width: of the kernel, in units of the square root of
    the number of statistics."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = id_and_text(documents, id_col, text_col)

    def measure(batches):
        for batch in batches:
            found = [statistics(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    # texts are measured where they are and only statistics shuffled; rows of one id give its least vector
    wanted = written(known, "quality-labels")
    measured = texts.join(wanted.select("doc_id"), "doc_id", "left_semi") if wanted.count() > 1_000_000 else texts.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")
    vectors = measured.mapInArrow(measure, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0
    rows = written(vectors.join(wanted, "doc_id").select("x", F.col("label").cast("double").alias("label"), fold.alias("calibrates")), "quality-vectors")
    counts = {(r["label"], r["calibrates"]): r["count"] for r in rows.groupBy("label", "calibrates").count().collect()}
    n = {label: sum(c for (l, _), c in counts.items() if l == label) for label in (0.0, 1.0)}
    if not n[0.0] or not n[1.0]:
        return Model(n[1.0] / max(1, n[0.0] + n[1.0]))

    def moments(batches):
        total = np.zeros(1 + 2 * N_STATISTICS)
        for batch in batches:
            x = _matrix(batch)
            total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        return total

    sums = _summed(rows, moments)
    mean = sums[1 : 1 + N_STATISTICS] / sums[0]
    spread = np.sqrt(np.maximum(sums[1 + N_STATISTICS :] / sums[0] - mean * mean, 0))
    draw = np.random.default_rng(seed)
    directions = draw.standard_normal((N_STATISTICS, features)) / (width * np.sqrt(N_STATISTICS))
    model = Model(n[1.0] / sum(n.values()), mean, np.where(spread > 1e-9, spread, 1.0), directions, draw.uniform(0, 2 * np.pi, features))
    size = features + 1
    # either class counts as much as the other
    weight = {label: sum(n.values()) / (2 * n[label]) for label in n}

    def equations(batches):
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z, y = model.features(_matrix(batch)), batch.column("label").to_numpy()
            w = np.where(y == 1, weight[1.0], weight[0.0])[:, None]
            left += z.T @ (z * w)
            right += (z * w).T @ y
        return np.concatenate([left.reshape(-1), right])

    fits = rows.where(~F.col("calibrates")) if any(c for (_, cal), c in counts.items() if not cal) else rows
    sums = _summed(fits, equations)
    left, right = sums[: size * size].reshape(size, size), sums[size * size :]
    penalty = np.full(size, ridge * left[-1, -1])
    penalty[-1] = 0  # the constant is free
    model.weights = np.linalg.solve(left + np.diag(penalty + 1e-9), right)

    def bins(batches):
        total = np.zeros((2, _BINS))
        for batch in batches:
            raw, y = model.raw(_matrix(batch)), batch.column("label").to_numpy()
            at = np.clip((raw - _LOW) / (_HIGH - _LOW) * _BINS, 0, _BINS - 1).astype(int)
            for label in (0, 1):
                total[label] += np.bincount(at[y == label], minlength=_BINS)
        return total.reshape(-1)

    judged = rows.where("calibrates") if any(c for (_, cal), c in counts.items() if cal) else rows
    negative, positive = _summed(judged, bins).reshape(2, _BINS)
    used = np.flatnonzero(negative + positive)
    centres = _LOW + (used + 0.5) * (_HIGH - _LOW) / _BINS
    model.steps = (centres, isotonic(positive[used], (positive + negative)[used]))
    return model


def score(documents: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (of label 1) and predicted."""

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(x), pa.float64())], names=["doc_id", "score"])

    scored = id_and_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
