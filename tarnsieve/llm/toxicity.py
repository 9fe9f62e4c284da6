"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Fitting takes labelled documents, one text for each id, at most about `max_rows` of them (a hash of the id
decides; the bound is what keeps the fit's tables of a fixed size).  Executors count in how many texts of
either class each hashed n-gram occurs; the `max_features` that tell the classes apart best (chi-squared) are
the model's, a setting of its size that doesn't depend on the data's.  An n-gram that a text holds twice or more is a feature of its
own beside the n-gram, as chance brings most of them once.  Their log-count ratios r scale the binary
features of a logistic regression, fitted on the driver from the kept features' ids alone.  Scoring looks every n-gram of a whole text up in one table.

Nulls and ties: a null text is an empty one and gets the classifier's bias as score; labels that are
null are no labels, and several labels of an id count as their maximum; labels without a document
are ignored; of documents that repeat a labelled id the least text is learned from, and all are scored.  Very long
texts are read whole, a million characters at a time.  Without labels of both classes
every score is the share of label 1 (0.0 without labels).  Columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, written

#: Hash of n-grams to 2^BITS features.
BITS = 20
ORDERS = (3, 4, 5, 6)


@dataclass
class Model:
    """Weights (already scaled by r) of hashed n-grams."""

    bias: float
    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    constant: bool = False

    def table(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.features] = self.weights
        return table

    def __call__(self, text: str | None, table: np.ndarray) -> float:
        if self.constant:
            return self.bias
        found = [g[table[g] != 0] for g in _grams(text)]
        once = np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)
        total = self.bias + float(table[once].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def _grams(text: str | None, step: int = 1 << 20):
    """Hashed n-grams of a whole text in arrays of bounded length, and features for those that occur twice or more."""
    if not text:
        return
    # characters below a space count as spaces; a text's ends as well
    text, seen = f" {text.lower()} ", None
    for at in range(0, len(text), step):
        part = text[at : at + step + max(ORDERS) - 1]
        codes = np.maximum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(32))
        rolled, found = codes, [np.empty(0, np.int32)]
        for n in range(2, max(ORDERS) + 1):
            if len(rolled) < 2:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
            if n in ORDERS:
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)
                found.append((mixed[:step] >> np.uint32(32 - BITS)).astype(np.int32))
        grams = np.concatenate(found)
        yield grams
        once, times = np.unique(grams, return_counts=True)
        again = times > 1
        if len(text) > step:
            seen = np.zeros(1 << BITS, bool) if seen is None else seen
            again |= seen[once]
            seen[once] = True
        yield ((once[again].astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x5BD1E)) & np.uint32((1 << BITS) - 1)).astype(np.int32)


def _kept(text: str | None, wanted: np.ndarray) -> np.ndarray:
    """The wanted features that occur in a text, each once."""
    found = [g[wanted[g]] for g in _grams(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def _present(text: str | None, seen: np.ndarray) -> np.ndarray:
    """All features of a text, each once; seen is a scratch array of False."""
    found = list(_grams(text))
    if not found:
        return np.empty(0, np.int32)
    grams = np.concatenate(found)
    if len(grams) > len(seen) // 8:
        seen[grams] = True
        once = np.flatnonzero(seen).astype(np.int32)
        seen[once] = False
        return once
    return np.unique(grams)


def _counted(train: DataFrame, slices: int = 16) -> DataFrame:
    """(slice, counts): in how many texts of each class the features of a slice of the hash range occur."""
    import zstandard

    width = (1 << BITS) // slices

    def count(batches):
        seen, counts = np.zeros(1 << BITS, bool), np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts[label][_present(text, seen)] += 1
        if counts.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            blobs = [pack(np.ascontiguousarray(counts[:, k * width : (k + 1) * width]).tobytes()) for k in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    return train.mapInArrow(count, "slice int, counts binary")


def _chosen(counted: DataFrame, n_pos: int, n_neg: int, per_slice: int, slices: int = 16) -> DataFrame:
    """(feature, r) of the features of each slice that tell the classes apart best."""
    import zstandard

    width = (1 << BITS) // slices

    def choose(batches):
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = np.frombuffer(unpack(blob), np.int32).reshape(2, width)
                sums[k] = sums[k] + now if k in sums else now.astype(np.int64)
        for k, (neg, pos) in sums.items():
            # chi-squared of presence against class; r: log ratio of the smoothed shares
            n, both = n_pos + n_neg, pos + neg
            spread = both * (n - both) * float(n_pos) * n_neg
            chi = np.where(spread > 0, n * (pos * float(n_neg) - neg * float(n_pos)) ** 2 / np.maximum(spread, 1), 0)
            best = np.argsort(-chi, kind="stable")[:per_slice]
            best = best[(chi[best] > 6.6) & (both[best] >= 3)]
            r = np.log((pos[best] + 1) / (n_pos + 2)) - np.log((neg[best] + 1) / (n_neg + 2))
            yield pa.RecordBatch.from_arrays([pa.array(best + k * width, pa.int32()), pa.array(r, pa.float64())], names=["feature", "r"])

    return counted.repartition(slices, "slice").mapInArrow(choose, "feature int, r double")


def _logistic(lens: np.ndarray, col: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float, rounds: int = 10) -> tuple[np.ndarray, float]:
    """Newton steps, each solved by conjugate gradients, for log loss + l2/2 |w|^2.  Row i has the next
    lens[i] of the features `col`; feature j has the value scale[j] wherever it occurs."""
    n = len(lens)
    row = np.repeat(np.arange(n, dtype=np.int32), lens)

    def times(w):
        return np.bincount(row, (scale * w)[col], n)

    def back(u):
        return scale * np.bincount(col, u[row], len(scale))

    w, b = np.zeros(len(scale)), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w) + b, -40, 40)))
        gw, gb, d = back(p - y) + l2 * w, float((p - y).sum()), p * (1 - p) + 1e-9
        x, xb, r, rb = np.zeros_like(w), 0.0, -gw, -gb
        q, qb, rr = r.copy(), rb, float(r @ r + rb * rb)
        first = rr
        for _ in range(20):
            if rr < 1e-3 * first or rr < 1e-12:
                break
            u = d * (times(q) + qb)
            hq, hb = back(u) + l2 * q, float(u.sum())
            a = rr / float(q @ hq + qb * hb)
            x, xb, r, rb = x + a * q, xb + a * qb, r - a * hq, rb - a * hb
            rr, last = float(r @ r + rb * rb), rr
            q, qb = r + rr / last * q, rb + rr / last * qb
        w, b = w + x, b + xb
        if max(np.abs(x).max(initial=0), abs(xb)) < 1e-3:
            break
    return w * scale, b


def is_held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 20_000, max_features: int = 4096, l2: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled documents that are not held out."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < (1 << 30) * max_rows // total)
    # about max_rows rows of 12 bytes: the bound of this broadcast; an id has one text, however many rows repeat it
    joined = id_and_text(documents, id_col, text_col).join(F.broadcast(known), "doc_id")
    train = written(joined.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "label"), "toxicity-train")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n_neg, n_pos = sizes.get(0, 0), sizes.get(1, 0)
    if not n_neg or not n_pos:
        return Model(n_pos / max(1, n_pos + n_neg), constant=True)
    chosen = sorted(_chosen(_counted(train), n_pos, n_neg, max_features // 16).collect())
    features, scale = np.array([c[0] for c in chosen], np.int32), np.array([c[1] for c in chosen])
    wanted = features.tobytes()

    def kept(batches):
        mask = np.zeros(1 << BITS, bool)
        mask[np.frombuffer(wanted, np.int32)] = True
        for batch in batches:
            found = [_kept(t, mask).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=["label", "found"])

    rows = train.mapInArrow(kept, "label int, found binary").toArrow()
    found = [np.frombuffer(x.as_buffer(), np.int32) if x.as_buffer().size else np.empty(0, np.int32) for x in rows.column("found")]
    lens = np.fromiter(map(len, found), np.int64, len(found))
    col = np.searchsorted(features, np.concatenate(found)).astype(np.int32)
    y = rows.column("label").to_numpy().astype(float)
    del rows, found
    weights, bias = _logistic(lens, col, y, scale, l2)
    return Model(bias, features, weights.astype(np.float32))


def score(documents: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        table = model.table()
        for batch in batches:
            scores = [model(t, table) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = id_and_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is under the threshold."""
    at = documents.columns.index(text_col)

    def run(batches):
        table = model.table()
        for batch in batches:
            yield batch.filter(pa.array([model(t, table) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
