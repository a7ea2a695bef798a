"""Benchmark decontamination: sparse word-level suffix arrays over the training documents, searched with benchmark suffixes.

Each chunk of documents is a shard: its words become numbers of the benchmark's vocabulary (0 elsewhere), and the suffixes
that can start a window at all, because enough known words follow, are sorted into a suffix array. All benchmark suffixes are
binary-searched in it; from every hit the match is carried on to its longest verbatim extent. The benchmark is the stated query
set: it travels to the workers in blocks of bounded size, so the documents are never shuffled and no key can be hot. Words are told apart
by 64-bit hashes; a word of a document is taken for one of a million benchmark words with a chance of about 5 in 10**14.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import byte_list, chunked, distinct, expand, Scratch, trimmed, tune, Words

#: Bytes of benchmark text that are sent to the workers at once; a longer benchmark takes several passes. A worker holds some 50 bytes
#: for each of its words.
BLOCK_BYTES = 8 << 20
#: Bytes of documents in a shard: the longer, the fewer searches for the whole benchmark.
SHARD_BYTES = 1 << 20


@dataclass
class Index:
    """A block of the benchmark: its vocabulary and its items' words as numbers (0 ends each item)."""

    vocabulary: np.ndarray  # sorted hashes; the number of a word is its place plus 1
    sequence: np.ndarray  # numbers of all items, each followed by a 0
    start: np.ndarray  # where each window starts in sequence
    length: np.ndarray  # its length
    item: np.ndarray  # the item it belongs to, as an index into ids
    ids: list[str | None]
    need: np.ndarray  # by word number: the fewest words that a window starting with it has (0: none does)

    @cached_property
    def probes(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By length of window: which windows, and their keys in order; built once by a worker for all its shards."""
        out = []
        for length in np.unique(self.length).tolist():
            which = np.flatnonzero(self.length == length)
            keys = _keys(self.sequence, self.start[which], length)
            order = np.argsort(keys, kind="stable")
            out.append((length, which[order], keys[order]))
        return out

    @classmethod
    def build(cls, items: list[tuple[object, bytes]], n: int) -> Index | None:
        words = Words([text for _, text in items])
        if not len(words):
            return None
        vocabulary, number = np.unique(words.hash, return_inverse=True)
        number = number + 1
        sequence = np.zeros(len(number) + len(items), np.int64)
        sequence[np.arange(len(number)) + words.doc] = number
        first = words.first[:-1] + np.arange(len(items))
        windows = np.where(words.count >= n, words.count - n + 1, (words.count > 0).astype(np.int64))
        start, length = expand(first, windows), np.repeat(np.minimum(words.count, n), windows)
        need = np.full(len(vocabulary) + 1, 1 << 30)
        np.minimum.at(need, sequence[start], length)
        need[need == 1 << 30] = 0
        return cls(vocabulary, sequence, start, length, np.repeat(np.arange(len(items)), windows), [None if i is None else str(i) for i, _ in items], need)


def _keys(sequence: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers from each position as fixed-width strings that sort as the number sequences do."""
    padded = np.concatenate([sequence, np.zeros(n, np.int64)])
    return (padded[at[:, None] + np.arange(n)] + 1).astype(">u4").view(f"S{4 * n}").ravel()


def suffix_array(sequence: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``at``, sorted by their first ``n`` numbers, and those keys."""
    keys = _keys(sequence, at, n)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def search(index: Index, sequence: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences in ``sequence`` (numbers of the index's vocabulary) of the index's windows: (window, position)."""
    none = np.zeros(0, np.int64)
    if not len(sequence):
        return none, none
    stop = np.flatnonzero(np.append(sequence, 0) == 0)
    run = stop[np.searchsorted(stop, np.arange(len(sequence)))] - np.arange(len(sequence))
    need = index.need[sequence]
    at = np.flatnonzero((need > 0) & (run >= need))
    if not len(at):
        return none, none
    shard, keys = suffix_array(sequence, at, n)
    found = []
    for length, which, probe in index.probes:
        cut = keys if length == n else np.ascontiguousarray(keys.view("u1").reshape(len(keys), 4 * n)[:, : 4 * length]).view(f"S{4 * length}").ravel()
        lo, hi = np.searchsorted(cut, probe, "left"), np.searchsorted(cut, probe, "right")
        found.append((np.repeat(which, hi - lo), shard[expand(lo, hi - lo)]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def longest(index: Index, sequence: np.ndarray, window: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Words that each occurrence has in common with its item from the window's start on."""
    length, a, b = index.length[window].copy(), np.append(index.sequence, 0), np.append(sequence, -1)
    live = np.arange(len(window))
    while len(live):
        x = a[np.minimum(index.start[window[live]] + length[live], len(a) - 1)]
        live = live[(x == b[np.minimum(position[live] + length[live], len(b) - 1)]) & (x > 0)]
        length[live] += 1
    return length


def _numbers(index: Index, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words as numbers with a 0 after each document, and where each document starts."""
    place = np.minimum(np.searchsorted(index.vocabulary, words.hash), len(index.vocabulary) - 1)
    sequence = np.zeros(len(words) + len(words.count), np.int64)
    sequence[np.arange(len(words)) + words.doc] = np.where(index.vocabulary[place] == words.hash, place + 1, 0)
    return sequence, words.first[:-1] + np.arange(len(words.count))


@dataclass
class Found:
    """What one shard, the documents ``lo`` to ``hi``, holds of the benchmark: its longest matches, by document and place."""

    lo: int
    hi: int
    words: np.ndarray  # words of each document
    hit: np.ndarray  # words inside a match, of each document
    doc: np.ndarray  # by match, from ``lo`` on
    item: np.ndarray
    doc_word: np.ndarray
    size: np.ndarray


def find(index: Index | None, docs: list[bytes], n: int, shard: int = SHARD_BYTES) -> Iterator[Found]:
    """The documents shard by shard."""
    none = np.zeros(0, np.int64)
    for lo, hi in chunked(docs, shard):
        words = Words(docs[lo:hi])
        if index is None or not len(words):
            yield Found(lo, hi, words.count, np.zeros(hi - lo, np.int64), none, none, none, none)
            continue
        sequence, first = _numbers(index, words)
        window, position = search(index, sequence, n)
        size = longest(index, sequence, window, position)
        owner, item, diagonal = np.searchsorted(first, position, "right") - 1, index.item[window], index.start[window] - position
        # windows of one match stand on one diagonal of item and document, and their matches end together
        order = np.lexsort((position, diagonal, item, owner))
        key = np.stack([owner, item, diagonal, position + size])[:, order]
        order = order[np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])] if len(order) else order
        position, size, owner, item = position[order], size[order], owner[order], item[order]
        cover = np.bincount(position, minlength=len(sequence) + 1) - np.bincount(position + size, minlength=len(sequence) + 1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(sequence)] > 0)])
        yield Found(lo, hi, words.count, np.diff(inside[np.append(first, len(sequence))]), owner, item, position - first[owner], size)


_SCHEMA = "doc_id long, row long, n_words long, matches array<struct<item_id:string,doc_word:long,words:long>>"


_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("words", pa.int64())]))


def _scan(shared, n: int, report: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for found in find(index, byte_list(batch.column(1)), n):
                part = batch.slice(found.lo, found.hi - found.lo)
                if report:
                    items: dict[int, set] = {}
                    pairs = distinct(found.doc * len(index.ids) + found.item) if index else found.doc
                    for x in pairs.tolist():
                        items.setdefault(x // len(index.ids), set()).add(index.ids[x % len(index.ids)])
                    yield _report(part.column(0), found.words, found.hit, [items.get(d, ()) for d in range(found.hi - found.lo)])
                    continue
                matches: list[list] = [[] for _ in range(found.hi - found.lo)]
                for d, i, place, k in zip(found.doc.tolist(), found.item.tolist(), found.doc_word.tolist(), found.size.tolist(), strict=True):
                    matches[d].append({"item_id": index.ids[i], "doc_word": place, "words": k})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found.words, pa.int64()), pa.array(matches, _MATCHES)], ["doc_id", "row", "n_words", "matches"])

    return run


def _clean(shared, n: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [f.hit for f in find(shared.value, byte_list(batch.column(at)), n)]
            yield batch.filter(pa.array(np.concatenate(hit) == 0)) if hit else batch

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    block, size = [], 0
    for item_id, text in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        data = text.encode()
        if block and size + len(data) > limit:
            yield block
            block, size = [], 0
        block.append((item_id, data))
        size += len(data)
    yield block


def verbatim_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim matches of benchmark items in each document.

    ``docs``: doc_id, text; ``benchmark``: item_id, text (other columns are ignored). A window is ``n`` consecutive words of an
    item; an item of fewer words, but not none, is one window. Returns one row per input row: doc_id, n_words, and matches: an
    array of (item_id, doc_word, words), each a run of document words, starting at word doc_word, that equals a run of the item,
    holds a window and can't be carried on.

    Edge cases: null or empty texts have no words and no matches; items with a null text are left out, those with a
    null id are searched for and have a null item_id in matches; repeated items or documents each count; an empty benchmark matches nothing; an empty table gives an empty result.
    """
    return _matches(spark, docs, benchmark, n, block_bytes, False)


def _matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int, report: bool) -> DataFrame:
    """The matches, or the report on them; with one block the report is made where the matches are found."""
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("row"))
    blocks = _blocks(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        shared = spark.sparkContext.broadcast(Index.build(block, n))
        if report:
            return rows.mapInArrow(trimmed(_scan(shared, n, True)), _REPORT)
        return rows.mapInArrow(trimmed(_scan(shared, n)), _SCHEMA).drop("row")
    scratch = Scratch(spark, "decontam")
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # numbers each row once, for all passes
    out, i = None, 0
    while block is not None:
        part = scratch.write(rows.mapInArrow(trimmed(_scan(spark.sparkContext.broadcast(Index.build(block, n)), n)), _SCHEMA), f"pass-{i}")
        out = part if out is None else out.unionByName(part)
        block, following, i = following, next(blocks, None), i + 1
    out = out.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")).drop("row")
    return out.select("doc_id", "n_words", "matches").mapInArrow(trimmed(_digest), _REPORT) if report else out


def _report(doc_id: pa.Array, words: np.ndarray, hit: np.ndarray, items: list) -> pa.RecordBatch:
    code = [hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest() for found in items]
    columns = [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(code, pa.string()), pa.array(hit > 0)]
    return pa.RecordBatch.from_arrays([doc_id, *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, items = [], []
        for found in batch.column(2).to_pylist():
            reach = total = 0
            for a, k in sorted((m["doc_word"], m["words"]) for m in found):
                total += max(0, a + k - max(a, reach))
                reach = max(reach, a + k)
            hit.append(total)
            items.append({m["item_id"] for m in found})
        yield _report(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), np.array(hit, np.int64), items)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a match), n_items (different item ids, null counting as one), items_sha256
    (of the sorted item ids that aren't null, comma-joined) and contaminated. See :func:`verbatim_matches`."""
    return _matches(spark, docs, benchmark, n, block_bytes, True)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window, whatever their doc_id; all columns are kept. Each row is judged by
    its own text, in the pass that reads it, once for each block of the benchmark."""
    tune(spark)
    blocks = _blocks(benchmark, block_bytes)
    block, following, scratch, i = next(blocks), next(blocks, None), None, 0
    while True:
        shared = spark.sparkContext.broadcast(Index.build(block, n))
        docs = docs.mapInArrow(trimmed(_clean(shared, n, docs.columns.index("text"))), docs.schema)
        if following is None:
            return docs
        scratch = scratch or Scratch(spark, "decontam")
        docs = scratch.write(docs, f"pass-{i}")  # what one block leaves is searched for the next
        if i:
            scratch.drop(f"pass-{i - 1}")
        block, following, i = following, next(blocks, None), i + 1
