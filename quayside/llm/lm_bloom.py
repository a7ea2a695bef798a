"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counting. Each partition counts its distinct unigrams and bigrams in numpy and ships them, per hash bucket, as one packed block, so the
shuffle moves hashes and counts and not rows. Per bucket the blocks are merged to exact corpus counts. Buckets are as many as the
training text has ``BUCKET_BYTES``, so that what one task merges, and a segment's size, don't grow with the corpus; where they are more
than 2 ** ``DIGIT``, blocks are dealt digit by digit, as in a radix sort, so that a block never falls apart into single n-grams.

Filter. A count is held as its level q among ``LOWS``, exact for small counts: the entries (n-gram, 1) .. (n-gram, q) are set, so a
lookup probes 1, 2, .. until one is missing. Each bucket builds its own segment of the filter at ``BITS_PER_ENTRY`` bits for each entry
it has, so the filter grows with the corpus and holds every n-gram. It stays in its segments at every size: texts are written in
numbered blocks, each block's distinct n-grams go to their segments, and the quantised counts come back to the block. Only a caller
that names ``filter_bytes`` has filters of up to that size broadcast instead, which probes the same segments for the same scores.

Scores. A word's probability after another is interpolated from two probed estimates, each context weighted by its own evidence:
P(w|v) = k * c(v,w) / c(v) + (1 - k) * (c(w) + 1) / Z with k = a * c(v) / (c(v) + m), where Z is the sum of c + 1 over all types, as
the filter has their counts, and one unknown word. How far bigrams are to be trusted differs from text to text, so a text's
probability is the mean of its probabilities under the settings (a, m) of ``TRUST``, one of which is the unigram model alone: a text
that is no prose of the corpus loses no more than the logarithm of their number. ``TRUST`` was chosen by the likelihood of the
training rows with crc32 modulo 7 of 3 under a model of the other training rows.

Base scores need the exact count of every token. The most frequent types travel in a bounded table; the tokens outside it, which
are rare by definition, are joined on their hash, so no key of that join is hot.

N-grams are told apart by 64-bit hashes: of a thousand million different ones, two agree with a chance of about 3 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import byte_list, chunked, distinct, mix, remainder, Scratch, SOLID, trimmed, tune, U, Words

#: Bytes of training text for each bucket of n-gram hashes, a segment of the filter; buckets that one task takes; and the most binary
#: digits of a bucket's number by which blocks are dealt at once.
BUCKET_BYTES, BUCKETS_A_TASK, DIGIT = 1 << 21, 8, 15
BITS_PER_ENTRY, PROBES = 9, 4
#: Bytes of text in a block whose n-grams are looked up together; a longer document is a block of its own.
BLOCK_BYTES = 1 << 22
#: Types whose exact counts are sent to all workers.
HEAD = 400_000
#: How far bigrams are trusted: the highest weight of their estimate, and the count of a context at which it has half of that.
TRUST = ((0.0, 1.0), (0.3, 10.0), (0.5, 10.0), (0.9, 2.0))
#: Hash of the end token; bigrams start after it, too.
END = U(0x1B873593CC9E2D51)
#: Distinct n-grams that a counting task holds before it ships them.
HELD = 1 << 21


def _lows(ratio: float = 1.15, most: float = 1e13) -> np.ndarray:
    """The lowest count of each level: every count has its own while steps of ``ratio`` are smaller than 1."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return np.array(out, np.int64)


LOWS = _lows()


def bigram(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U(0x9FB21C651E98DF25) + (right ^ U(0x2545F4914F6CDD1D)))


def token_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each document's followed by the end token, and the tokens of each document."""
    words = Words(docs, SOLID)
    out = np.full(len(words) + len(docs), END)
    out[np.arange(len(words)) + words.doc] = words.hash
    return out, words.count + 1


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """The bigram that ends in each token. As every document ends with the end token, the one before a document's first is it."""
    return bigram(np.concatenate([[END], tokens[:-1]]), tokens)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _pack(kind: int, key: np.ndarray, count: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted hashes, by bucket (their highest ``bits`` bits), with counts in a byte each and the larger ones apart."""
    bucket, cut = np.unique(_bucket(key, bits), return_index=True)
    for lo in range(0, len(bucket), 4096):
        rows, at = [], np.append(cut, len(key))[lo : lo + 4097].tolist()
        for s, e in zip(at[:-1], at[1:], strict=True):
            c = count[s:e]
            large = c[c > 254]
            rows.append((key[s:e].tobytes(), np.minimum(c, 255).astype(np.uint8).tobytes(), large.astype(np.int64).tobytes()))
        number = bucket[lo : lo + 4096]
        columns = [pa.array(np.full(len(number), kind, np.int32)), pa.array(number), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "keys", "counts", "large"])


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _unpack(keys: bytes, counts: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = np.frombuffer(counts, np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(large, np.int64)
    return np.frombuffer(keys, np.uint64), count


_PACKED = "kind int, bucket long, keys binary, counts binary, large binary"


class _Held:
    """N-grams that a task holds, of both kinds, and ships by bucket when they get many."""

    def __init__(self, bits: int) -> None:
        self.bits, self.parts, self.size = bits, [([], []), ([], [])], [0, 0]

    def add(self, kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = self.parts[kind]
        keys.append(key)
        counts.append(n)
        self.size[kind] += len(key)
        if self.size[kind] > HELD:
            key, n = _sum(keys, counts)
            if len(key) > HELD // 2:
                yield from _pack(kind, key, n, self.bits)
                self.parts[kind], self.size[kind] = ([], []), 0
            else:
                self.parts[kind], self.size[kind] = ([key], [n]), len(key)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind in (0, 1):
            if self.parts[kind][0]:
                yield from _pack(kind, *_sum(*self.parts[kind]), self.bits)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(bits)
        for batch in batches:
            docs = byte_list(batch.column(0))
            for lo, hi in chunked(docs):
                tokens, _ = token_hashes(docs[lo:hi])
                for kind, h in enumerate((tokens, pairs_of(tokens))):
                    yield from held.add(kind, *np.unique(h, return_counts=True))
        yield from held.rest()

    return run


def _deal(bits: int):
    """Blocks of fewer buckets as blocks of 2 ** ``bits`` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(bits)
        for batch in batches:
            for i in range(batch.num_rows):
                kind, _, *packed = (batch.column(k)[i].as_py() for k in range(5))
                yield from held.add(kind, *_unpack(*packed))
        yield from held.rest()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, kind): the exact counts of each bucket."""

    def done() -> Iterator[pa.RecordBatch]:
        key, count = _sum([k for k, _ in parts], [c for _, c in parts])
        large = count[count > 254]
        row = (at[1], at[0], key.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes(), large.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["kind", "bucket", "keys", "counts", "large"])

    at, parts = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            kind, bucket, *packed = (batch.column(k)[i].as_py() for k in range(5))
            if at != (bucket, kind):
                if at is not None:
                    yield from done()
                at, parts = (bucket, kind), []
            parts.append(_unpack(*packed))
            if len(parts) > 16:
                parts = [_sum([k for k, _ in parts], [c for _, c in parts])]
    if at is not None:
        yield from done()


# --- the filter ---------------------------------------------------------------------------------------------------


def quantise(count: np.ndarray) -> np.ndarray:
    """The level of each count; 0 for none."""
    return np.searchsorted(LOWS, count, "right")


def expected(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range; 0 for none."""
    low, high = LOWS[np.maximum(q, 1) - 1], LOWS[np.minimum(np.maximum(q, 1), len(LOWS) - 1)] - 1
    return np.where(q > 0, np.sqrt(low * np.maximum(high, low).astype(np.float64)), 0.0)


def _bits(key: np.ndarray, level: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which 64-bit word of its segment an entry lies in, and its bits there."""
    h = mix(key ^ (level.astype(np.uint64) * U(0xA24BAED4963EE407)))
    bits = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        bits |= U(1) << ((h >> U(6 * i)) & U(63))
    return ((h >> U(32)) * words.astype(np.uint64) >> U(32)).astype(np.int64), bits


def build_segment(keys: list[np.ndarray], counts: list[np.ndarray], largest: int | None = None) -> np.ndarray:
    """A segment of 64-bit words over all given n-grams, of all kinds; ``largest`` bounds its words, not what it holds."""
    key, q = np.concatenate(keys), quantise(np.concatenate(counts))
    words = max(1, -(-int(q.sum()) * BITS_PER_ENTRY // 64))
    words = words if largest is None else min(words, largest)
    out = np.zeros(words, np.uint64)
    level = np.arange(int(q.sum())) - np.repeat(np.cumsum(q) - q, q) + 1
    at, bits = _bits(np.repeat(key, q), level, np.array(words))
    order = np.argsort(at, kind="stable")
    at, bits = at[order], bits[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    if len(first):
        out[at[first]] = np.bitwise_or.reduceat(bits, first)
    return out


class LogFilter:
    """All segments, one after the other, or a single one (``only``)."""

    def __init__(self, segments: dict[int, bytes], bits: int = 9, only: bool = False) -> None:
        self.bits, self.only = bits, only
        parts = [np.frombuffer(segments.get(b, b"\0" * 8), np.uint64) for b in (segments or [0] if only else range(1 << bits))]
        self.size = np.array([len(p) for p in parts])
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.words = np.concatenate(parts)

    def counts(self, key: np.ndarray) -> np.ndarray:
        """The expected count of each n-gram."""
        return expected(self.levels(key))

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The quantised count of each n-gram, from probing its levels until one is missing."""
        q, live = np.zeros(len(key), np.int64), np.arange(len(key))
        bucket = np.zeros(len(key), np.int64) if self.only else _bucket(key, self.bits)
        level = 0
        while len(live):
            level += 1
            b = bucket[live]
            at, bits = _bits(key[live], np.full(len(live), level), self.size[b])
            live = live[(self.words[self.first[b] + at] & bits) == bits]
            q[live] = level
            if level == len(LOWS):
                break
        return q


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, of both kinds: one filter segment each."""

    def done(bucket: int, parts: list) -> pa.RecordBatch:
        words = build_segment([k for k, _ in parts], [c for _, c in parts])
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([words.tobytes()], pa.binary())], ["bucket", "words"])

    at, parts = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            _, bucket, *packed = (batch.column(k)[i].as_py() for k in range(5))
            if at != bucket and parts:
                yield done(at, parts)
                parts = []
            at = bucket
            parts.append(_unpack(*packed))
    if parts:
        yield done(at, parts)


# --- a filter that isn't broadcast ----------------------------------------------------------------------------------

_BLOCK = "block long, ids array<long>, held array<boolean>, texts array<binary>"


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, held_out) as numbered blocks of about ``BLOCK_BYTES`` of text."""
    number = TaskContext.get().partitionId() << 40  # holds for good, as the blocks are written once

    def done() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, ids, held, texts), kinds, strict=True)], ["block", "ids", "held", "texts"])

    ids, held, texts, size = [], [], [], 0
    for batch in batches:
        for i, text, out in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            if texts and size + len(text) > BLOCK_BYTES:
                yield done()
                ids, held, texts, size, number = [], [], [], 0, number + 1
            ids.append(i)
            held.append(out)
            texts.append(text)
            size += len(text) + 1
    if texts:
        yield done()


def _ngrams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and bigrams of a block, and the tokens of each document."""
    parts = [token_hashes(docs[lo:hi]) for lo, hi in chunked(docs)]
    tokens = np.concatenate([t for t, _ in parts])
    return tokens, pairs_of(tokens), np.concatenate([n for _, n in parts])


def _ask(bits: int):
    """For each block its distinct n-grams, of all kinds, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, pairs, _ = _ngrams(texts)
                key = distinct(np.concatenate([tokens, pairs]))
                bucket, first = np.unique(_bucket(key, bits), return_index=True)
                cut = np.append(first, len(key)).tolist()
                for lo in range(0, len(bucket), 4096):
                    number = bucket[lo : lo + 4096]
                    packed = [key[a:b].tobytes() for a, b in zip(cut[lo : lo + len(number)], cut[lo + 1 : lo + 1 + len(number)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.ones(len(number), np.int32)), pa.array(np.full(len(number), block)), pa.array(packed, pa.binary())], ["bucket", "kind", "block", "data"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, kind), a segment (kind 0) before what is asked of it: the quantised counts, a byte each."""

    def done() -> pa.RecordBatch:
        key, where = np.unique(np.concatenate(asked), return_inverse=True)
        q = segment.levels(key).astype(np.uint8)[where]
        cut = np.cumsum([0, *map(len, asked)])
        packed = [q[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([at] * len(blocks), pa.int64()), pa.array(packed, pa.binary())], ["block", "bucket", "q"])

    at, segment, blocks, asked, size = None, None, [], [], 0
    for batch in batches:
        for bucket, kind, block, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if blocks and (bucket != at or size > HELD):  # n-grams of many blocks are probed once
                yield done()
                blocks, asked, size = [], [], 0
            if bucket != at:
                at, segment = bucket, LogFilter({bucket: data} if kind == 0 else {}, only=True)
            if kind:
                blocks.append(block)
                asked.append(np.frombuffer(data, np.uint64))
                size += len(asked[-1])
    if blocks:
        yield done()


# --- scoring --------------------------------------------------------------------------------------------------------


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Types and tokens of each level, from packed unigrams."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, count = _unpack(*(batch.column(k)[i].as_py() for k in range(3)))
            level = quantise(count)
            n = np.bincount(level)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(np.bincount(level, count)[some].astype(np.int64))], ["level", "types", "tokens"])


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) rows of packed unigrams."""
    for batch in batches:
        for i in range(batch.num_rows):
            key, count = _unpack(*(batch.column(k)[i].as_py() for k in range(3)))
            for lo in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 50_000].view(np.int64)), pa.array(count[lo : lo + 50_000])], ["h", "c"])


class Model:
    """What workers need to score: the filter, if it is broadcast, the exact counts of the most frequent types, N, V and Z."""

    def __init__(self, segments: dict[int, bytes] | None, bits: int, head: np.ndarray, head_count: np.ndarray, tokens: int, types: int, total: float) -> None:
        order = np.argsort(head)
        self.filter = None if segments is None else LogFilter(segments, bits)
        self.head, self.head_count, self.tokens, self.types, self.total = head[order], head_count[order], tokens, types, total

    def exact(self, key: np.ndarray) -> np.ndarray:
        """Exact counts, or -1 for types outside the table."""
        if not len(self.head):
            return np.full(len(key), -1)
        place = np.minimum(np.searchsorted(self.head, key), len(self.head) - 1)
        return np.where(self.head[place] == key, self.head_count[place], -1)

    def score(self, single: np.ndarray, both: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """log10 of each text's probability, from the counts of its tokens and of its bigrams; texts start at ``edges``."""
        unigram = (single + 1) / self.total
        before = np.concatenate([single[-1:], single[:-1]])  # the last token is an end token, as is the one before the first
        estimate = np.minimum(both / np.maximum(before, 1), 1)
        by_trust = []
        for most, half in TRUST:
            weight = most * before / (before + half)
            by_trust.append(np.add.reduceat(np.log(weight * estimate + (1 - weight) * unigram), edges))
        return (np.logaddexp.reduce(by_trust) - np.log(len(TRUST))) / np.log(10)


def _lines(model: Model, row: int, ids: pa.Array, held_out: pa.Array, tokens: np.ndarray, count: np.ndarray, single: np.ndarray, both: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Scores of a run of whole documents, numbered from ``row`` on, and the tokens outside the model's table of exact counts."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "h", "times"]
    norm = np.log10(model.tokens + model.types + 1)
    n = len(count)
    doc = np.repeat(np.arange(n), count)
    edges = np.concatenate([[0], np.cumsum(count)[:-1]])
    c = model.exact(tokens)
    known = c >= 0
    base = np.add.reduceat(np.where(known, np.log10(np.maximum(c, 0) + 1) - norm, 0), edges)
    score = model.score(single, both, edges)
    number = row + np.arange(n)
    none = pa.nulls(n)
    yield pa.RecordBatch.from_arrays([pa.array(number), ids, held_out, pa.array(count), pa.array(np.add.reduceat(known.astype(np.int64), edges)), pa.array(base), pa.array(score), none.cast(kinds[7]), none.cast(kinds[8])], names)
    rare = np.flatnonzero(~known)
    if len(rare):
        rare = rare[np.lexsort((tokens[rare], doc[rare]))]
        d, h = doc[rare], tokens[rare]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
        none = pa.nulls(len(first))
        yield pa.RecordBatch.from_arrays([pa.array(number[d[first]]), *(none.cast(k) for k in kinds[1:7]), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(d))))], names)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        row = TaskContext.get().partitionId() << 40  # a number for each row of this task's output
        for batch in batches:
            docs = byte_list(batch.column(1))
            for lo, hi in chunked(docs):
                tokens, count = token_hashes(docs[lo:hi])
                single, both = (model.filter.counts(key)[at] for key, at in (np.unique(h, return_inverse=True) for h in (tokens, pairs_of(tokens))))
                yield from _lines(model, row + lo, batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), tokens, count, single, both)
            row += len(docs)

    return run


def _score_blocks(shared):
    """Rows sorted by (block, last, bucket): the answers to a block, then its texts (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        row, q = TaskContext.get().partitionId() << 40, []
        for batch in batches:
            buckets = batch.column(1).to_pylist()
            for i, bucket in enumerate(buckets):
                if bucket >= 0:
                    q.append(batch.column(2)[i].as_py())
                    continue
                tokens, pairs, count = _ngrams(batch.column(5)[i].as_py())
                key, at = np.unique(np.concatenate([tokens, pairs]), return_inverse=True)
                level = np.frombuffer(b"".join(q), np.uint8)
                if len(level) != len(key):
                    raise ValueError(f"{len(level)} answers to {len(key)} n-grams")
                counts = expected(np.arange(len(LOWS) + 1))[level][at]
                yield from _lines(model, row, batch.column(3)[i].values, batch.column(4)[i].values, tokens, count, counts[: len(tokens)], counts[len(tokens) :])
                row, q = row + len(count), []

    return run


def _dealt(rows: DataFrame, bits: int) -> DataFrame:
    """Every bucket's rows in one task, as many buckets in each, which a hash would not give."""
    return rows.repartitionById(max(1, (1 << bits) // BUCKETS_A_TASK), F.floor(F.col("bucket") / BUCKETS_A_TASK).cast("int"))


def _by_segment(scratch: Scratch, rows: DataFrame, segments: DataFrame, bits: int, shared) -> DataFrame:
    """Scores of ``rows`` by a filter that stays in its segments."""
    scratch.settle()
    blocks = scratch.write(rows.mapInArrow(trimmed(_block), _BLOCK), "blocks")
    asked = blocks.select("block", "texts").mapInArrow(trimmed(_ask(bits)), "bucket long, kind int, block long, data binary")
    own = segments.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), F.col("words").alias("data"))
    met = _dealt(own.unionByName(asked), bits).sortWithinPartitions("bucket", "kind")
    answers = scratch.write(met.mapInArrow(trimmed(_answer), "block long, bucket long, q binary"), "answers")
    scratch.drop("segments")
    scratch.settle()
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("ids", "array<long>"), ("held", "array<boolean>"), ("texts", "array<binary>"))]
    last = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("q"), "ids", "held", "texts")
    met = answers.select("block", "bucket", "q", *none).unionByName(last).repartition(max(1, blocks.count()), "block")
    return met.sortWithinPartitions("block", F.col("bucket") < 0, "bucket").mapInArrow(trimmed(_score_blocks(shared)), _SCORED)


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, times long"


def train(spark: SparkSession, scratch: Scratch, texts: DataFrame, filter_bytes: int = 0, head: int = HEAD, bucket_bytes: int = BUCKET_BYTES, digit: int = DIGIT) -> tuple[Model, DataFrame, DataFrame | None, int]:
    """Count all of ``texts`` (one column of text) and build the model; also returns (h, c), the exact counts of all types, the
    filter's segments if they are more than ``filter_bytes``, when the model has none of them, and the binary digits of their numbers."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(size / bucket_bytes) - 1).bit_length()
    packed = texts.mapInArrow(trimmed(_count(min(bits, digit))), _PACKED)
    for done in range(digit, bits, digit):
        tasks = max(1, (1 << bits) // BUCKETS_A_TASK)
        packed = packed.repartition(tasks, "bucket").mapInArrow(trimmed(_deal(min(bits, done + digit))), _PACKED)
    packed = _dealt(packed, bits).sortWithinPartitions("bucket", "kind")
    counts = scratch.write(packed.mapInArrow(trimmed(_merge), _PACKED), "counts")
    one = counts.where("kind = 0").select("keys", "counts", "large")
    levels = one.mapInArrow(trimmed(_levels), "level long, types long, tokens long").groupBy("level").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"))
    levels = sorted(levels.collect(), key=lambda r: -r["level"])  # a row a level
    tokens, kinds = (sum(r[c] for r in levels) for c in ("tokens", "types"))
    weight = sum(r["types"] * float(expected(np.array(r["level"]))) for r in levels) + kinds + 1
    lowest, total = int(LOWS[-1]) + 1, 0  # the lowest count of the levels that ``head`` types are in, or fewer
    for r in levels:
        if (total := total + r["types"]) > head:
            break
        lowest = int(LOWS[r["level"] - 1])
    types = scratch.write(one.mapInArrow(trimmed(_types), "h long, c long"), "types")
    table = types.where(F.col("c") >= lowest).toPandas()
    built = _dealt(counts, bits).sortWithinPartitions("bucket").mapInArrow(trimmed(_segment), "bucket long, words binary")
    segments = scratch.write(built, "segments")
    scratch.drop("counts")
    small = filter_bytes > 0 and (segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0) <= filter_bytes
    own = {r["bucket"]: bytes(r["words"]) for r in segments.toLocalIterator()} if small else None
    model = Model(own, bits, table["h"].to_numpy(np.int64).view(np.uint64), table["c"].to_numpy(np.int64), tokens, kinds, weight)
    return model, types, None if small else segments, bits


def lm_score(spark: SparkSession, docs: DataFrame, modulus: int = 7, held: int = 2, filter_bytes: int = 0, head: int = HEAD, **options) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text) with a bigram model learnt from those whose crc32 of the id as text, modulo
    ``modulus``, is not ``held``.

    Tokens are the runs without ASCII white space of the ASCII-lower-cased text, then one end token. Returns one row per input row:
    doc_id, held_out, n_tokens, n_known (tokens that training has), train_tokens, base_score (sum of log10 of the add-one unigram
    probabilities, exact) and score (log10 probability of the text under the model). ``options``: bucket_bytes and digit of :func:`train`.

    Edge cases: a null or empty text is its end token; a null doc_id is not held out; repeated rows each count and are each scored;
    an empty table gives an empty result; if every row is held out, nothing is known and train_tokens is 0.
    """
    tune(spark)
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), modulus) == held).alias("held_out"))
    model, types, segments, bits = train(spark, scratch, rows.where(~F.col("held_out")).select("text"), filter_bytes, head, **options)
    shared = spark.sparkContext.broadcast(model)
    out = rows.mapInArrow(trimmed(_score(shared)), _SCORED) if segments is None else _by_segment(scratch, rows, segments, bits, shared)
    out = scratch.write(out, "scores")
    norm = float(np.log10(model.tokens + model.types + 1))
    rare = out.where("h is not null").select("row", "h", "times").join(types, "h", "left")
    tail = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - norm)).alias("rest"))
    whole = out.where("h is null").join(tail, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
