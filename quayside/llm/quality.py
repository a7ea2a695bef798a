"""Quality: regularised quadratic discriminant over transformed document statistics.

One pass over the texts computes ``FEATURES`` per document (shares of character classes, word and line statistics, repetition),
vectorised on bytes. Each class is a normal distribution with a shrunken covariance: its own, drawn towards the pooled one and
towards a sphere. A score is the difference of the two log densities, whose Mahalanobis terms come from cached Cholesky factors,
turned into a probability with the classes' shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import _BYTE, byte_list, chunked, prefix_hash, remainder, Scratch, SOLID, span_hash, trimmed, tune, U, Words
from quayside.llm.toxicity import known_labels

FEATURES = ["length", "upper", "digit", "beyond", "space", "stop", "mark", "symbol", "bar", "other", "word_length", "distinct", "echo", "top", "line_length", "line_repeat"]

_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
for _group, _chars in ((5, b".,;:'\"()-?"), (6, b"!"), (7, b"#$%&*@^~+=<>{}[]\\/_`"), (8, b"|")):
    _KIND[list(_chars)] = _group
_KIND[[x for x in range(32) if x not in (9, 10, 11, 12, 13)]] = 9
_KIND[127] = 9


def statistics(docs: list[bytes]) -> np.ndarray:
    """The features of each text, transformed: counts as logarithms, shares as logits. A text without bytes has zeros for shares."""
    out = np.zeros((len(docs), len(FEATURES)))
    for lo, hi in chunked(docs):
        part = docs[lo:hi]
        size = np.array([len(x) for x in part])
        data = np.frombuffer(b"".join(part), np.uint8)
        doc = np.repeat(np.arange(len(part)), size)
        counts = np.bincount(doc * 10 + _KIND[data], minlength=10 * len(part)).reshape(-1, 10)
        words = Words(part, SOLID)
        n = np.maximum(words.count, 1)
        letters = np.add.reduceat(np.append(words.end - words.start, 0), np.minimum(words.first[:-1], len(words))) * (words.count > 0) if len(words) else np.zeros(len(part))
        order = np.lexsort((words.hash, words.doc))
        h, d = words.hash[order], words.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(h)))
        distinct = np.bincount(d[heads], minlength=len(part))
        top = np.zeros(len(part))
        np.maximum.at(top, d[heads], times)
        same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        echo = np.bincount(words.doc[1:][same], minlength=len(part))
        buffer = np.frombuffer(b"\n".join([b"", *part, b""]), np.uint8)
        begin = np.cumsum([1, *(size + 1)])
        ends = np.flatnonzero(buffer == 10)
        line_start, line_end = ends[:-1] + 1, ends[1:]
        some = line_end > line_start
        line_start, line_end = line_start[some], line_end[some]
        owner = np.searchsorted(begin, line_start, "right") - 1
        lines = np.bincount(owner, minlength=len(part))
        key = span_hash(prefix_hash(_BYTE[buffer]), line_start, line_end) ^ (owner.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        kept = np.bincount(owner[np.unique(key, return_index=True)[1]], minlength=len(part))

        def logit(x: np.ndarray, of: np.ndarray) -> np.ndarray:
            return np.log((x + 0.5) / (of - np.minimum(x, of) + 0.5)) * (of > 0)

        out[lo:hi] = np.column_stack(
            [np.log1p(size), *(logit(counts[:, k], size) for k in range(1, 10)), np.log1p(letters / n), logit(distinct, words.count), logit(echo, words.count), logit(top, words.count), np.log1p(size / np.maximum(lines, 1)), logit(lines - kept, lines)]
        )
    return out


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the shrunken covariances, and log shares."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    shares: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shares: np.ndarray, pool: float = 0.3, sphere: float = 0.05) -> Discriminant:
        """From rows; see :meth:`of`."""
        parts = [x[y == c] for c in (0, 1)]
        return cls.of([(len(p), p.sum(0), p.T @ p) for p in parts], shares, pool, sphere)

    @classmethod
    def of(cls, moments: list[tuple[int, np.ndarray, np.ndarray]], shares: np.ndarray, pool: float = 0.3, sphere: float = 0.05) -> Discriminant:
        """From each class's rows, sums and sums of products, which are all that the densities need. ``pool``: the part of the pooled
        covariance in each class's; ``sphere``: the part of a multiple of the identity. A class of n rows leans on the pooled one by
        at least k / (n + k), k being the number of features."""
        n = np.array([m[0] for m in moments])
        k = len(moments[0][1])
        centre = sum(m[1] for m in moments) / n.sum()
        scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in moments)) / n.sum() - centre**2, 0))
        scale[scale < 1e-9 * np.maximum(1, np.abs(centre))] = 1.0
        means, own = [], []
        for size, total, square in moments:
            mean = total / size
            means.append((mean - centre) / scale)
            own.append((square / size - np.outer(mean, mean)) / np.outer(scale, scale))
        pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
        factors = []
        for c in (0, 1):
            a = max(pool, k / (n[c] + k))
            s = (1 - a) * own[c] + a * pooled
            s = (1 - sphere) * s + sphere * max(np.trace(s) / k, 1e-3) * np.eye(k)
            factors.append(np.linalg.cholesky(s))
        return cls(centre, scale, means, factors, np.log(shares))

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the classes' shares."""
        z, out = (x - self.centre) / self.scale, []
        for c in (0, 1):
            w = np.linalg.solve(self.factors[c], (z - self.means[c]).T)
            out.append(self.shares[c] - 0.5 * (w**2).sum(0) - np.log(np.diag(self.factors[c])).sum())
        return out[1] - out[0]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(byte_list(batch.column(1)))
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "held_out", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class that a partition has: its label, rows, sums and sums of products, in one array."""
    k = len(FEATURES)
    held = np.zeros((2, 1 + k + k * k))
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        for c in (0, 1):
            part = x[y == c]
            held[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
    some = [c for c in (0, 1) if held[c, 0]]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([held[c].tolist() for c in some], pa.list_(pa.float64()))], ["label", "sums"])


def _score(model: Discriminant | None, constant: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            p = np.full(len(x), constant) if model is None else 1 / (1 + np.exp(-np.clip(model.logit(x), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and x, the features of each whole text in the order of ``FEATURES``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    return rows.mapInArrow(trimmed(_features), "doc_id long, held_out boolean, x array<double>")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Quality of every whole text of ``docs`` (doc_id, text) as ``labels`` (doc_id, quality) marks it.

    Returns one row per input row: doc_id, held_out (crc32 of the id as text is divisible by 5; such labels are never learnt),
    score (probability of label 1) and predicted (score >= ``threshold``). The densities are fitted on all labelled rows: a partition
    sums up their statistics and products, and only these sums are added up and sent to the driver.

    Edge cases: a null or empty text has the statistics of an empty text and is scored like any; without labels of both classes
    every score is the share of label 1 (0.5 without labels); a null doc_id is not held out; an empty table gives an empty result.
    """
    tune(spark)
    scratch = Scratch(spark, "quality")
    features = scratch.write(document_statistics(docs), "features")
    known = known_labels(labels.select(F.col("doc_id").cast("long").alias("doc_id"), label), label)
    there = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    k = len(FEATURES)
    sums = features.where("not held_out").join(known, "doc_id").select("label", "x").mapInArrow(trimmed(_moments), "label int, sums array<double>")
    added = sums.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum(F.col("v").cast("decimal(28,12)")).alias("v")).collect()  # 273 numbers a class; in decimals, whose sum has no order
    flat = np.zeros((2, 1 + k + k * k))
    for r in added:
        flat[r["label"], r["at"]] = float(r["v"])
    moments = [(int(f[0]), f[1 : 1 + k], f[1 + k :].reshape(k, k)) for f in flat]
    both = bool(flat[:, 0].all())
    total = sum(there.values())
    model = Discriminant.of(moments, np.array([there[0], there[1]]) / total) if both else None
    return features.mapInArrow(trimmed(_score(model, there.get(1, 0) / total if total else 0.5, threshold)), "doc_id long, held_out boolean, score double, predicted int")
