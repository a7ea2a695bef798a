"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5 characters, with word edges), hashed into ``BUCKETS`` rows, so
an unseen misspelling shares most of its vectors with the word it comes from. A passage of ``WINDOW`` words is the mean of its
words, and a linear softmax over that mean gives its two classes. A document is as toxic as its most toxic passage: averaging
over a whole long text would drown a single insult. Vectors and softmax are trained together, first on whole documents and then
on the passage that scores highest.

As everything after the vectors is linear, scoring needs one number per n-gram row. Texts are scored whole in a single pass
without a shuffle; distinct words of a chunk are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import expand, give_back, mix, prefix_hash, remainder, span_hash, trimmed, tune, U

BUCKETS, DIM, WINDOW, GRAMS = 1 << 18, 16, 3, (3, 4, 5)
#: Bound of the sample that the model is fitted on: labelled rows of each class, and bytes of their texts together.
ROWS_PER_CLASS, BYTES_PER_CLASS = 2000, 1 << 23
#: Characters that are turned into arrays at once.
CHUNK = 1 << 19

_tables: dict[str, np.ndarray] = {}


def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is part of a word, its lower case, and a 64-bit value."""
    if "solid" not in _tables:
        solid, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.int64)
        for c in range(0x30000):
            x = chr(c)
            solid[c] = x.isalnum()
            if len(x.lower()) == 1:
                lower[c] = ord(x.lower())
        solid[0x30000:] = True
        _tables.update(solid=solid, lower=lower, value=mix(np.arange(0x110001, dtype=np.uint64) + U(77)))
    return _tables["solid"], _tables["lower"], _tables["value"]


@dataclass
class Bag:
    """Distinct words of some texts as bags of n-gram rows, and the texts as sequences of these words."""

    word: np.ndarray  # word number at each place of each text
    first: np.ndarray  # where each text starts in word
    grams: np.ndarray  # n-gram rows of all distinct words
    at: np.ndarray  # where each distinct word starts in grams


def _bag(texts: list[str]) -> tuple[np.ndarray, Bag]:
    solid, lower, value = _code_tables()
    codes = lower[np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)]
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    edge = np.flatnonzero(np.diff(solid[codes].view(np.int8)))
    start, end = edge[0::2] + 1, edge[1::2] + 1
    distinct, where, word = np.unique(span_hash(prefix_hash(value[codes]), start, end), return_index=True, return_inverse=True)
    # each distinct word again, between edge marks
    s, size = start[where], (end - start)[where]
    text = codes[expand(s - 1, size + 2)]
    at = np.concatenate([[0], np.cumsum(size + 2)])
    text[at[:-1]] = ord(" ")
    text[at[1:] - 1] = ord(" ")
    prefix = prefix_hash(value[text])
    owner, rows = [], []
    for n in GRAMS:  # the shortest word, a character between its edges, has one n-gram
        count = np.maximum(size + 2 - n + 1, 0)
        place = expand(at[:-1], count)
        rows.append((span_hash(prefix, place, place + n) % U(BUCKETS)).astype(np.int32))
        owner.append(np.repeat(np.arange(len(size)), count))
    owner, rows = np.concatenate(owner), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return distinct, Bag(word.astype(np.int32), np.searchsorted(start, begin), rows[order], np.searchsorted(owner[order], np.arange(len(size) + 1)))


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` characters together."""
    lo = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > CHUNK:
            yield lo, i
            lo = i
            total = 0
        total += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def bags(texts: list[str]) -> Bag:
    """The texts of several chunks as one bag."""
    hashes, parts = zip(*(_bag(texts[a:b]) for a, b in _runs(texts)), strict=True)
    distinct, where = np.unique(np.concatenate(hashes), return_index=True)
    size = np.concatenate([np.diff(x.at) for x in parts])[where]
    shift = np.cumsum([0, *(len(x.grams) for x in parts)])
    start = np.concatenate([x.at[:-1] + k for x, k in zip(parts, shift, strict=False)])[where]
    grams = np.concatenate([x.grams for x in parts])[expand(start, size)]
    word = np.concatenate([np.searchsorted(distinct, h)[x.word].astype(np.int32) for h, x in zip(hashes, parts, strict=True)])
    count = np.concatenate([np.diff(x.first) for x in parts])
    return Bag(word, np.concatenate([[0], np.cumsum(count)]), grams, np.concatenate([[0], np.cumsum(size)]))


def word_scores(weight: np.ndarray, bag: Bag) -> np.ndarray:
    """Mean over each distinct word's n-grams of their number in ``weight``."""
    if not len(bag.grams):
        return np.zeros(0)
    total = np.add.reduceat(weight[bag.grams], bag.at[:-1])
    return total / np.diff(bag.at)


def passages(score: np.ndarray, bag: Bag) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the highest mean of ``WINDOW`` words in a row (of all words, if fewer), where it starts, and its words."""
    place = score[bag.word] if len(bag.word) else np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(place)])
    count = np.diff(bag.first)
    size = np.minimum(count, WINDOW)
    best, at = np.full(len(count), -np.inf), bag.first[:-1].copy()
    has = np.flatnonzero(count)
    if len(has):
        windows = count[has] - size[has] + 1
        starts = expand(bag.first[has], windows)
        length = np.repeat(size[has], windows)
        mean = (total[starts + length] - total[starts]) / length
        edges = np.concatenate([[0], np.cumsum(windows)])
        top = np.maximum.reduceat(mean, edges[:-1])
        hit = np.flatnonzero(mean == np.repeat(top, windows))
        at[has] = starts[hit[np.searchsorted(hit, edges[:-1])]]
        best[has] = top
    return best, at, size


@dataclass
class Model:
    vectors: np.ndarray  # n-gram rows x DIM
    softmax: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2
    prior: float  # score of a text without words

    @property
    def weight(self) -> np.ndarray:
        """Per n-gram row, what it adds to the logit of class 1 against class 0."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def fit(texts: list[str], labels: np.ndarray, rounds: tuple[int, int] = (5, 40), rate: float = 0.5, batch: int = 128, seed: int = 5) -> Model:
    """Train vectors and softmax jointly with Adagrad: ``rounds`` passes on stretches of 64 words, then on highest passages.

    Defaults were chosen by log loss on the learnable rows with crc32 modulo 5 of 1, under models of the other learnable rows.
    A step takes ``batch`` texts, and fewer of a small sample, which would be left half-trained by as few steps as that makes. Texts
    without words have no part.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32), float(labels.mean()) if len(labels) else 0.0)
    if len(set(labels.tolist())) < 2:
        model.bias[1] = 0.0 if not len(labels) else (8.0 if labels[0] else -8.0)
        model.vectors[:] = 0
        return model
    bag = bags(texts)
    use = np.flatnonzero(np.diff(bag.first))
    g_vectors, g_softmax, g_bias = np.full(BUCKETS, 1e-4, np.float32), np.full((DIM, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)
    gram_count = np.diff(bag.at)
    for epoch in range(sum(rounds)):
        if epoch < rounds[0]:
            at, size = bag.first[:-1], np.minimum(np.diff(bag.first), 64)
            # a long text is averaged over another stretch each time; its first and last words are in as many as the others
            count = np.diff(bag.first)
            at = at + np.clip((rng.random(len(at)) * (count + size)).astype(np.int64) - size, 0, count - size)
        else:
            _, at, size = passages(word_scores(model.weight, bag), bag)
        for part in np.array_split(rng.permutation(use), max(1, len(use) // max(4, min(batch, len(use) // 20)))):
            words = bag.word[expand(at[part], size[part])]
            doc = np.repeat(np.arange(len(part)), size[part])
            rows = bag.grams[expand(bag.at[words], gram_count[words])]
            share = np.repeat(1.0 / (gram_count[words] * size[part][doc]), gram_count[words]).astype(np.float32)
            owner = np.repeat(doc, gram_count[words])
            edges = np.searchsorted(owner, np.arange(len(part)))
            mean = np.add.reduceat(model.vectors[rows] * share[:, None], edges, axis=0)
            logits = mean @ model.softmax + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(part)), labels[part]] -= 1
            g_mean = error @ model.softmax.T
            d_softmax, d_bias = mean.T @ error / len(part), error.mean(0)
            distinct, inverse = np.unique(rows, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            cut = np.searchsorted(inverse[order], np.arange(len(distinct)))
            d_rows = np.add.reduceat((g_mean[owner] * share[:, None])[order], cut, axis=0)
            g_vectors[distinct] += (d_rows**2).mean(1)
            model.vectors[distinct] -= rate * d_rows / np.sqrt(g_vectors[distinct])[:, None]
            g_softmax += d_softmax**2
            g_bias += d_bias**2
            model.softmax -= 0.1 * d_softmax / np.sqrt(g_softmax)
            model.bias -= 0.1 * d_bias / np.sqrt(g_bias)
    return model


def score(weight: np.ndarray, offset: float, prior: float, texts: list[str]) -> np.ndarray:
    """Probability of class 1 for each text."""
    out = np.empty(len(texts))
    for lo, hi in _runs(texts):
        _, bag = _bag(texts[lo:hi])
        best, _, size = passages(word_scores(weight, bag), bag)
        with np.errstate(over="ignore"):
            out[lo:hi] = np.where(size > 0, 1 / (1 + np.exp(-(best + offset))), prior)
    return out


def _score(shared, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, offset = shared.value
        for batch in batches:
            p = score(weight, offset, prior, [x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labels that may be learnt: 0 or 1, with an id, outside the held-out fifth; the largest of several."""
    learn = F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)
    return labels.where(learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def sample(docs: DataFrame, known: DataFrame, per_class: int, bytes_per_class: int) -> tuple[list[str], list[int]]:
    """(texts, labels) of at most ``per_class`` of the known labels a class, in the order of a hash of the id, with whole texts as far
    as ``bytes_per_class`` goes; the text that goes beyond it is the last, and if it is by itself longer, a stretch of it is taken
    from a place that the hash names. Of rows that share an id, one is taken.

    Ids are chosen without their texts, so that only the texts of the sample are moved.
    """
    there = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(known, "doc_id")
    there = there.groupBy("h", "doc_id", "label").agg(F.max("bytes").alias("bytes"))
    picked = []
    for k in (0, 1):
        size = 0
        for r in there.where(F.col("label") == k).orderBy("h", "doc_id").limit(per_class).collect():
            if size >= bytes_per_class:
                break
            size += min(r["bytes"], bytes_per_class)
            picked.append((r["doc_id"], r["label"]))
    ids = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, label int"))  # 2 * per_class rows at most
    most = F.lit(bytes_per_class // 4)  # characters, which have four bytes at most
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - most + 1)) + 1
    text = F.when(F.octet_length("text") > bytes_per_class, F.substring(F.col("text"), place.cast("int"), most)).otherwise(F.col("text"))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "label").agg(F.max(text).alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in rows], [r["label"] for r in rows]


def _train(spark: SparkSession, rows: DataFrame, labels: DataFrame, label: str, per_class: int, bytes_per_class: int) -> tuple:
    """(weight by n-gram row and offset, broadcast; score of a text without words)."""
    known = known_labels(labels.select(F.col("doc_id").cast("long").alias("doc_id"), label), label)
    texts, learnt = sample(rows, known, per_class, bytes_per_class)
    truth = np.array(learnt, np.int64)
    model = fit(texts, truth)
    # the sample holds the classes more evenly than the labels do; the softmax's offset is set right for the latter
    there = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    taken = truth.sum()
    del texts
    give_back()
    shift = np.log(there[1] / there[0] * (len(truth) - taken) / taken) if 0 < taken < len(truth) else 0.0
    return spark.sparkContext.broadcast((model.weight.astype(np.float64), model.offset + float(shift))), min(model.prior, 0.49)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> DataFrame:
    """Toxicity of every whole text of ``docs`` (doc_id, text) as ``labels`` (doc_id, toxic) marks it.

    Returns one row per input row: doc_id, held_out (crc32 of the id as text is divisible by 5; such labels are never learnt),
    score and predicted (score >= 0.5). The model is fitted on at most ``per_class`` labelled rows a class, with some
    ``bytes_per_class`` of text; scoring covers all rows and whole texts.

    Edge cases: a null or empty text, or one without letters or digits, scores the share of toxic rows in the sample; with labels
    of one class only, everything scores as that class, with none 0.5 (texts without words: 0); a null doc_id is not held out; an
    empty table gives an empty result.
    """
    tune(spark)
    rows = _rows(docs)
    shared, prior = _train(spark, rows, labels, label, per_class, bytes_per_class)
    return rows.select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out")).mapInArrow(trimmed(_score(shared, prior)), "doc_id long, held_out boolean, score double, predicted int")


def _clean(shared, prior: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, offset = shared.value
        for batch in batches:
            p = score(weight, offset, prior, [x or "" for x in batch.column(at).cast(pa.string()).to_pylist()])
            yield batch.filter(pa.array(p < 0.5))

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic, whatever their doc_id; all columns are kept. Each row is judged by its own
    text, in the pass that reads it."""
    tune(spark)
    shared, prior = _train(spark, _rows(docs), labels, label, per_class, bytes_per_class)
    return docs.mapInArrow(trimmed(_clean(shared, prior, docs.columns.index("text"))), docs.schema)
