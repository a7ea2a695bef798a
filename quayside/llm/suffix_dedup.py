"""Suffix-array dedup: maximal repeats of at least ``min_bytes`` bytes and what of each text they cover.

Plan
----
1. Every ``min_bytes`` window of a text is owned by its *anchor*: the leftmost of its substrings of ``min_bytes`` * 2 / 5 bytes
   that has the smallest hash. Equal windows have equal anchors at the same offset, so occurrences of a repeat meet under their
   anchors' hash. A text yields one row per anchor (about one in 120 bytes for 400) with the extent of the windows it owns and
   a digest of that region; both hashes, 128 bits, tell regions apart.
2. Anchors whose hash stands once are gone after one count. Equal regions collapse to one with its number of occurrences; a
   region that occurs twice is a repeat as a whole.
3. The different regions under one hash are cut from their texts and meet in one task, if they are at most ``group``. There an
   enhanced suffix array over the suffixes at the anchors (with its twin over the reversed prefixes) is stack-scanned: each
   common-prefix interval merges its children, its left-extension diversity is the set of distinct left contexts, and where a
   merge brings two occurrences together whose left and right extension reach ``min_bytes``, a maximal repeat is found.
4. More regions under one hash than that (a passage with thousands of contexts) are never gathered: classes of their windows are
   hashed (128 bits) and counted with partial aggregation, and those not yet decided are cut finer, down to single windows.
5. Covered extents go back to all occurrences of a region, then to their documents.

Nothing is dropped, capped or sampled; a hash, digest or window count decides only between equal 128-bit values.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayside.llm.common import _BYTE, BROADCAST_ROWS, byte_list, chunked, prefix_hash, Scratch, sized, span_hash, trimmed, tune, U, unused

#: Different regions under one anchor hash that one task compares.
GROUP = 192
#: Window starts in a class, level by level, where more regions meet.
LEVELS = (24, 4, 1)
#: Bytes without white space from which a repeat is long, however few its words.
SOLID_BYTES = 400
#: Rows of (document, extents) that a join broadcasts; beyond it, the join shuffles.
EXTENTS = 200_000


# --- anchors ------------------------------------------------------------------------------------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


#: A 64-bit value for every two bytes in a row, for a second hash that is independent of the bytes' own.
_PAIR = np.random.default_rng(20240307).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


def anchors(docs: list[bytes], size: int, gram: int, digests: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunk by chunk, for every anchor of the texts that have a window: the text's number, the anchor's hash and place, the bytes
    before it and from it on that its windows span, and a digest of that region (none unless ``digests``)."""
    span = size - gram + 1
    some = [i for i, x in enumerate(docs) if len(x) >= size]
    for lo, hi in chunked([docs[i] for i in some]):
        part = some[lo:hi]
        data = np.frombuffer(b"".join(docs[i] for i in part), np.uint8)
        first = np.cumsum([0, *(len(docs[i]) for i in part)])
        prefix = prefix_hash(_BYTE[data])
        at = np.arange(len(data) - gram + 1)
        hashes = span_hash(prefix, at, at + gram)
        bits = U(max(1, int(len(data)).bit_length()))
        key = (hashes >> bits << bits) | at.astype(np.uint64)  # the smallest hash, the leftmost of equal ones
        owner = (_least(key, span) & ((U(1) << bits) - U(1))).astype(np.int64)  # by window start
        start = np.ones(len(data), bool)
        for b in first[1:]:
            start[b - size + 1 : b] = False  # windows that would leave the text
        window = np.flatnonzero(start[: len(owner)])
        own = owner[window]
        cut = np.flatnonzero(np.diff(own, prepend=-1) != 0)
        place, head, tail = own[cut], window[cut], window[np.append(cut[1:], len(window)) - 1]
        text = np.searchsorted(first, head, "right") - 1
        digest = None
        if digests:
            pairs = prefix_hash(_PAIR[data[:-1].astype(np.int64) * 256 + data[1:]])
            digest = span_hash(pairs, head, tail + size - 1).view(np.int64)
        yield np.array(part)[text], hashes[place].view(np.int64), place - first[text], place - head, tail + size - place, digest


def _anchor_hashes(size: int, gram: int):
    """The hash of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, *_ in anchors(byte_list(batch.column(0)), size, gram, False):
                yield pa.RecordBatch.from_arrays([pa.array(hashes)], ["anchor"])

    return run


def _anchor_rows(size: int, gram: int):
    """A row for every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for text, hashes, place, before, behind, digest in anchors(byte_list(batch.column(1)), size, gram):
                columns = [pa.array(hashes), pa.array(rows[text]), pa.array(place), pa.array(before, pa.int32()), pa.array(behind, pa.int32()), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "row", "place", "before", "behind", "digest"])

    return run


# --- the interval tree ----------------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Left:
    """Rank of every left context in reversed order, and the longest common left context of any two ranks."""

    def __init__(self, contexts: list[bytes]) -> None:
        order = sorted(range(len(contexts)), key=lambda i: contexts[i])
        self.rank = [0] * len(contexts)
        for r, i in enumerate(order):
            self.rank[i] = r
        self.member = order
        level = np.array([_common(contexts[a], contexts[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)
        size, self.table, width = len(level), [level.tolist()], 1
        while 2 * width <= size:
            level = np.minimum(level[:-width], level[width:])
            self.table.append(level.tolist())
            width *= 2

    def common(self, a: int, b: int) -> int:
        if a > b:
            a, b = b, a
        k = (b - a).bit_length() - 1
        return min(self.table[k][a], self.table[k][b - (1 << k)])


def maximal_repeats(left: list[bytes], right: list[bytes], size: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least ``size`` bytes among occurrences of one anchor, as (bytes before it, bytes from it on, all
    occurrences that have it, at least two).

    ``right[i]`` is the suffix at occurrence i's anchor, ``left[i]`` the reversed text before it, both as far as its region goes.
    The stack scan visits the common-prefix intervals from deep to shallow. Children merge small into large, each a sorted list
    of left ranks; a newcomer's neighbours in rank are those with which it shares most on the left. A pair that reaches ``size``
    opens a repeat, whose occurrences are the ranks around it that share as much. An interval all of whose members share the
    whole left context is not left-diverse beyond its region and gives that one repeat only.
    """
    n = len(right)
    order = sorted(range(n), key=lambda i: right[i])
    lcp = [_common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    tree = _Left(left)
    seen: dict[tuple[int, int], set[int]] = {}

    def merge(a: list[int], b: list[int], depth: int) -> tuple[list[int], list[tuple[int, int, int]]]:
        if len(a) < len(b):
            a, b = b, a
        pairs = []
        for r in b:
            k = bisect_left(a, r)
            for other in a[max(0, k - 1) : k + 1]:
                if (shared := tree.common(other, r)) + depth >= size:
                    pairs.append((shared, depth, r))
            a.insert(k, r)
        return a, pairs

    def report(ranks: list[int], pairs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[int]]]:
        for shared, depth, r in pairs:
            done = seen.setdefault((shared, depth), set())
            if r in done:
                continue
            k = bisect_left(ranks, r)
            lo = hi = k
            while lo and tree.common(ranks[lo - 1], r) >= shared:
                lo -= 1
            while hi + 1 < len(ranks) and tree.common(r, ranks[hi + 1]) >= shared:
                hi += 1
            done.update(ranks[lo : hi + 1])
            yield shared, depth, [tree.member[x] for x in ranks[lo : hi + 1]]

    stack: list[tuple[int, list[int], list]] = []  # (depth, left ranks, pairs found at this depth)
    for k in range(n):
        node = [tree.rank[order[k]]]
        depth = lcp[k] if k + 1 < n else -1
        while stack and stack[-1][0] > depth:
            d, ranks, pairs = stack.pop()
            node, more = merge(ranks, node, d)
            pairs = pairs + more
            yield from report(node, pairs)
        if depth < 0:
            break
        if stack and stack[-1][0] == depth:
            d, ranks, pairs = stack.pop()
            node, more = merge(ranks, node, d)
            stack.append((d, node, pairs + more))
        else:
            stack.append((depth, node, []))


def covered(left: list[bytes], right: list[bytes], size: int) -> list[list[tuple[int, int]]]:
    """For each occurrence the merged extents around its anchor (negative: before it) that maximal repeats cover."""
    spans: list[set] = [set() for _ in right]
    for before, behind, members in maximal_repeats(left, right, size):
        for i in members:
            spans[i].add((-before, behind))
    return [_union(sorted(x)) for x in spans]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _compare(size: int):
    """Rows sorted by anchor: the covered extents of every region that has any."""

    def finish(group: list[tuple]) -> tuple[list, list]:
        left, right = [r[:b][::-1] for _, b, r in group], [r[b:] for _, b, r in group]
        found = covered(left, right, size) if len(group) > 1 else [[]]
        some = [i for i, x in enumerate(found) if x]
        return [group[i][0] for i in some], [[{"a": a, "b": b} for a, b in found[i]] for i in some]

    def emit(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], _SPANS)], ["digest", "anchor", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            columns = batch.to_pydict()
            for k, *row in zip(columns["anchor"], columns["digest"], columns["before"], columns["region"], strict=True):
                if k != key and group:
                    digests, spans = finish(group)
                    out += [(d, key, s) for d, s in zip(digests, spans, strict=True)]
                    group = []
                    if len(out) > 5000:
                        yield emit(out)
                        out = []
                key = k
                group.append(tuple(row))
        if group:
            digests, spans = finish(group)
            out += [(d, key, s) for d, s in zip(digests, spans, strict=True)]
        yield emit(out)

    return run


def _classes(size: int, width: int):
    """From (anchor, digest, before, region, ranges): every range of window starts cut into classes of ``width`` starts at a
    grid that is fixed to the anchor; with the hashes of the core that all windows of a grid cell share and of all that the
    class spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            rows: list[tuple] = []
            for anchor, digest, before, region, ranges in zip(*(columns[c] for c in ("anchor", "digest", "before", "region", "ranges")), strict=True):
                for r in ranges:
                    at = r["a"]
                    while at < r["b"]:
                        cell = at // width * width
                        stop = min(r["b"], cell + width)
                        name = anchor.to_bytes(8, "big", signed=True)
                        core = name + cell.to_bytes(4, "big", signed=True) + region[cell + width - 1 + before : cell + before + size]
                        full = name + at.to_bytes(4, "big", signed=True) + stop.to_bytes(4, "big", signed=True) + region[at + before : stop - 1 + before + size]
                        rows.append((hashlib.blake2b(core, digest_size=16).digest(), hashlib.blake2b(full, digest_size=16).digest(), anchor, digest, at, stop))
                        at = stop
                if len(rows) > 10_000:
                    yield _class_batch(rows)
                    rows = []
            yield _class_batch(rows)

    return run


def _class_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["core", "full", "anchor", "digest", "a", "b"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The regions of each text, from (text, list of regions)."""
    for batch in batches:
        out: list[tuple] = []
        for text, regions in zip(byte_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            out += [(r["anchor"], r["digest"], r["before"], r["m"], text[r["place"] - r["before"] : r["place"] + r["behind"]]) for r in regions]
        for lo in range(0, len(out), 4096):
            part = out[lo : lo + 4096]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], ["anchor", "digest", "before", "m", "region"])


# --- the operator ---------------------------------------------------------------------------------------------------


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged = [_union(sorted((s["a"], s["b"]) for s in spans)) for spans in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"a": a, "b": b} for a, b in x] for x in merged], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["row", "spans"])


def _hot_extents(scratch: Scratch, hot: DataFrame, size: int) -> DataFrame | None:
    """Covered extents of regions that are too many under one anchor to meet in one task, level by level.

    The windows of a region are cut into classes of neighbouring starts. A class that stands twice in full is covered as a whole,
    and one row stands for all its copies from then on; a class whose core stands once holds no repeat; only what is left, classes
    at the edges of what is shared, is cut finer, down to single windows. All counts are partially aggregated.
    """
    if hot.isEmpty():
        return None
    ranges = F.array(F.struct((-F.col("before")).alias("a"), (F.length("region") - size + 1 - F.col("before")).cast("int").alias("b")))
    active, found = hot.withColumn("ranges", ranges), None
    for i, width in enumerate(min(w, size) for w in LEVELS):  # a cell's windows have at least no byte in common
        rows = scratch.write(active.mapInArrow(trimmed(_classes(size, width)), "core binary, full binary, anchor long, digest long, a int, b int"), f"classes-{i}")
        whole = scratch.write(rows.groupBy("full").agg(F.count("*").alias("n"), F.min(F.struct("anchor", "digest", "a", "b", "core")).alias("one")), f"whole-{i}")
        hits = rows.join(whole.where("n > 1").select("full"), "full", "left_semi").select("anchor", "digest", F.struct("a", (F.col("b") - 1 + size).alias("b")).alias("s"))
        found = hits if found is None else found.unionByName(hits)
        if width > 1:
            left = whole.select("one.*")
            shared = scratch.write(left.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), f"shared-{i}")
            again = left.join(shared, "core", "left_semi").groupBy("anchor", "digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
            active = hot.join(again, ["anchor", "digest"])
    return found.groupBy("anchor", "digest").agg(F.collect_list("s").alias("spans")).select("digest", "anchor", "spans")


def repeated_spans(spark: SparkSession, rows: DataFrame, scratch: Scratch, min_bytes: int, group: int = GROUP) -> DataFrame:
    """(row, spans): for each text of ``rows`` (row, text) that has any, the byte ranges covered by a string of ``min_bytes``
    bytes that also starts elsewhere in the table."""
    gram = max(1, min_bytes * 2 // 5)
    texts = rows.select("row", "text")
    long = texts.where(F.octet_length("text") >= min_bytes)
    # anchors are found twice, first to count them, as the few that stand twice are all that is worth a table; it is one of its own,
    # so that both sides of the join are plain shuffles, of which a skewed one can be split
    hashes = long.select("text").mapInArrow(trimmed(_anchor_hashes(min_bytes, gram)), "anchor long")
    often = scratch.write(hashes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    scratch.settle()
    found = long.mapInArrow(trimmed(_anchor_rows(min_bytes, gram)), "anchor long, row long, place long, before int, behind int, digest long")
    shared = scratch.write(found.join(often, "anchor", "left_semi"), "shared")
    scratch.drop("often")
    scratch.settle()
    one = F.min(F.struct("row", "place", "before", "behind")).alias("one")
    regions = scratch.write(shared.groupBy("anchor", "digest").agg(F.count("*").alias("n"), one).select("anchor", "digest", "n", "one.*"), "regions")
    many = scratch.write(regions.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "many")
    apart = regions.join(many, "anchor")
    by_text = scratch.write(apart.groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "place", "before", "behind", "m")).alias("regions")), "by-text")
    touched = by_text.count()
    if touched <= BROADCAST_ROWS:  # then texts without regions needn't move
        texts = texts.join(F.broadcast(by_text.select("row")), "row", "left_semi")
    cut = scratch.write(texts.join(by_text, "row").select("text", "regions").mapInArrow(trimmed(_cut), "anchor long, digest long, before int, m long, region binary"), "cut")
    scratch.drop("many", "by-text")
    scratch.settle()
    kind = "digest long, anchor long, spans array<struct<a:int,b:int>>"
    few = cut.where(F.col("m") <= group).select("anchor", "digest", "before", "region").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(_compare(min_bytes)), kind)
    hot = _hot_extents(scratch, scratch.write(cut.where(F.col("m") > group).select("anchor", "digest", "before", "region"), "hot"), min_bytes)
    extents = scratch.write(few.unionByName(hot) if hot else few, "extents")
    scratch.drop("cut")
    copies = regions.where("n > 1").select("anchor", "digest", F.array(F.struct((-F.col("before")).alias("a"), F.col("behind").alias("b"))).alias("spans"))
    all_extents = copies.unionByName(extents.join(copies.select("anchor", "digest"), ["anchor", "digest"], "left_anti").select("anchor", "digest", "spans"))
    hits = shared.join(all_extents, ["anchor", "digest"]).select("row", F.transform("spans", lambda s: F.struct((F.col("place") + s["a"]).alias("a"), (F.col("place") + s["b"]).alias("b"))).alias("spans"))
    spans = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(trimmed(_merge_spans), "row long, spans array<struct<a:bigint,b:bigint>>")
    out = scratch.write(spans, "spans")
    scratch.drop("shared", "regions", "extents")
    return out


def with_spans(spark: SparkSession, docs: DataFrame, min_bytes: int, group: int = GROUP) -> tuple[DataFrame, str]:
    """``docs`` with all its columns and one more, whose name comes back too: the spans of :func:`suffix_spans`."""
    tune(spark)
    scratch, row = Scratch(spark, "suffix-dedup"), unused(docs, "row")
    name = unused(docs, "spans")
    # a number for each row, so that repeated ids do no harm; written once, as it depends on how a scan splits files
    rows = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    spans = repeated_spans(spark, rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), scratch, min_bytes, group)
    size = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    return rows.join(sized(spans.select(F.col("row").alias(row), F.col("spans").alias(name)), size, EXTENTS), row, "left").drop(row), name


def suffix_spans(spark: SparkSession, docs: DataFrame, min_bytes: int = 400, group: int = GROUP) -> DataFrame:
    """``docs`` (doc_id, text; other columns are dropped) with ``spans``, the byte ranges [a, b) of each text's UTF-8 form that are
    covered by a string of ``min_bytes`` bytes which also starts anywhere else in the table, the same text included.

    Ranges are maximal, in order and apart. Edge cases: null and short texts have none (null spans); rows with a null or
    repeated doc_id count as texts of their own; an empty table gives an empty result.
    """
    out, spans = with_spans(spark, docs.select("doc_id", "text"), min_bytes, group)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(spans).alias("spans"))


def _keep(spans_name: str, min_words: int, solid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = batch.schema.names, batch.schema.get_field_index("text")
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index(spans_name)).to_pylist(), strict=True):
                if spans:
                    data, out, last = text.encode(), [], 0
                    for s in spans:
                        found = data[s["a"] : s["b"]].split()
                        if len(found) > min_words or max(map(len, found), default=0) >= solid:
                            out.append(data[last : s["a"]])
                            last = s["b"]
                    # a span may start or end inside a character; what is left of it goes
                    text = "".join(x.decode("utf-8", "ignore") for x in [*out, data[last:]])
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i, name in enumerate(names) if name != spans_name]
            yield pa.RecordBatch.from_arrays(columns, [n for n in names if n != spans_name])

    return run


def remove_passages(spark: SparkSession, docs: DataFrame, min_bytes: int = 101, min_words: int = 50, group: int = GROUP) -> DataFrame:
    """``docs`` without passages of more than ``min_words`` words that repeat: of the maximal runs of bytes covered by strings of
    ``min_bytes`` bytes that start twice in the table, those with more words go, in all their occurrences, and so do those with a
    stretch of ``SOLID_BYTES`` bytes without white space; shorter ones stay. 51 words have 101 bytes at least.

    All columns are kept; n_chars, if there, is set to the characters left in texts that changed. A text may become empty; no row goes.
    """
    found, spans = with_spans(spark, docs, min_bytes, group)
    found = found.withColumn("text", F.col("text").cast("string"))
    schema = StructType([f for f in found.schema.fields if f.name != spans])
    touched = found.where(F.col(spans).isNotNull()).mapInArrow(trimmed(_keep(spans, min_words, SOLID_BYTES)), schema)
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return found.where(F.col(spans).isNull()).drop(spans).unionByName(touched)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, runs, kept = [], [], [], []
        for text, spans in zip(byte_list(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            spans = spans or []
            h, at = hashlib.sha256(), 0
            for s in spans:
                h.update(text[at : s["a"]])
                at = s["b"]
            h.update(text[at:])
            size.append(len(text))
            removed.append(sum(s["b"] - s["a"] for s in spans))
            runs.append(len(spans))
            kept.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_report(spark: SparkSession, docs: DataFrame, min_bytes: int = 400, group: int = GROUP) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes outside :func:`suffix_spans`)."""
    return suffix_spans(spark, docs, min_bytes, group).select("doc_id", "text", "spans").mapInArrow(trimmed(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
