"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

Plan
----
1. One pass over the texts yields, per document, a 128-bit text digest, its number of distinct 5-word shingles and one hash
   per band. Equal texts collapse to one representative with a partially aggregated groupBy, so a text that fills a third
   of the table is one row from here on.
2. Band hashes are shuffled; each bucket links its members to its smallest one, and the linked documents' components are the
   candidate clusters. Nothing is emitted per pair.
3. Only clustered representatives have their shingle sets cut again from the text. Groups of them are compared: a whole cluster, or,
   where that is fewer pairs, each bucket of a cluster (low similarities chain buckets into large clusters), a pair in the first
   band that it shares. A group of up to ``BLOCK`` is verified in one task; a larger one is dealt by set size and salt into blocks,
   and every two blocks whose sizes allow the threshold meet in one task. So no group is gathered whole, and each pair is verified
   exactly once.
4. A task emits one row per document (its number of links) and a spanning forest of its links, never its pairs.

With 20 bands of 4 rows a pair of similarity 0.8 becomes a candidate with probability 1 - (1 - 0.8**4)**20 = 0.99997; a cluster
that is compared as a whole finds even a pair that shares no band, through a common neighbour.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import byte_list, chunked, distinct, mix, Scratch, shingles, sized, trimmed, tune, U, unused, Words
from quayside.llm.graph import components

#: Representatives of a cluster that one task compares with each other or with another block.
BLOCK = 128


def band_shape(threshold: float, recall: float, signature: int = 80) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, for which a pair at the threshold becomes a
    candidate with probability ``recall`` within ``signature`` hash functions."""
    for rows in range(signature, 0, -1):
        bands = signature // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError(f"no banding of {signature} functions reaches recall {recall} at {threshold}")


def signatures(docs: list[bytes], n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles and band hashes of each document (rows of zeros where it has no words)."""
    factor = np.random.default_rng(11).integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    sizes, out = np.zeros(len(docs), np.int64), np.zeros((len(docs), bands), np.uint64)
    for lo, hi in chunked(docs):
        key, owner = shingles(Words(docs[lo:hi]), n)
        if not len(key):
            continue
        has, begin = np.unique(owner, return_index=True)
        low, sign = (key >> U(32)).astype(np.uint32), np.empty((len(has), bands * rows), np.uint32)
        for i, a in enumerate(factor):
            sign[:, i] = np.minimum.reduceat(low * a + np.uint32(i * 0x9E3779B1 & 0xFFFFFFFF), begin)
        for b in range(bands):
            h = np.full(len(has), b + 1, np.uint64)
            for r in range(rows):
                h = mix(h * U(0x9E3779B97F4A7C15) + sign[:, b * rows + r].astype(np.uint64))
            out[lo + has, b] = h
        sizes[lo + has] = [len(distinct(key[s:e])) for s, e in zip(begin, [*begin[1:], len(key)], strict=True)]
    return sizes, out


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _sketch(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = byte_list(batch.column(1))
            sizes, hashes = signatures(docs, n, bands, rows)
            flat = pa.array(hashes.view(np.int64).ravel())
            offsets = pa.array(np.arange(len(docs) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(x) for x in docs], pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "digest", "size", "bands"],
            )

    return run


def _cut_shingles(n: int):
    """Digest of each text and its sorted distinct shingle hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sets = byte_list(batch.column(0)), []
            for lo, hi in chunked(docs):
                key, owner = shingles(Words(docs[lo:hi]), n)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                sets += [distinct(key[s:e]).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in docs], pa.binary()), pa.array(sets, pa.binary())], ["digest", "grams"])

    return run


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs (i in left, j in right, each unordered pair once) whose Jaccard similarity is at least ``threshold``.

    The intersections of one left document with all right ones come from one lookup of its shingles in an inverted list of
    the right side, so the cost is the number of shingle occurrences and not pairs times set size.
    """
    order = np.argsort(flat := np.concatenate([sets[j] for j in right]), kind="stable")
    grams, owner = flat[order], np.repeat(np.arange(len(right)), [len(sets[j]) for j in right])[order]
    sizes = np.array([len(sets[j]) for j in right])
    same = left is right
    for a, i in enumerate(left):
        lo, hi = np.searchsorted(grams, sets[i], "left"), np.searchsorted(grams, sets[i], "right")
        some = hi > lo
        lengths = (hi - lo)[some]
        if not len(lengths):
            continue
        at = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        good = shared >= threshold * (sizes + len(sets[i]) - shared) - 1e-9
        for j in np.flatnonzero(good & (np.arange(len(right)) > a if same else True)):
            yield a, int(j)


def _verify(threshold: float):
    """Rows sorted by task: per document its links (weighted by copies) and edges of a spanning forest."""

    def finish(task: list[tuple]) -> tuple[list, list, list]:
        docs = [x[0] for x in task]
        sets = [np.frombuffer(x[3], np.uint64) for x in task]
        band = task[0][4]  # of a bucket's task; null if it is a cluster's
        bands = None if band is None else np.array([x[5] for x in task])
        side = np.array([x[2] for x in task])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        if not len(right):
            right = left
        links, parent, edges = [0] * len(task), list(range(len(task))), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in _linked(sets, left, right, threshold) if len(left) and len(right) else ():
            i, j = int(left[a]), int(right[b])
            if band is not None and np.flatnonzero(bands[i] == bands[j])[0] != band:
                continue  # met in an earlier band
            links[i] += task[j][1]
            links[j] += task[i][1]
            if (p := root(i)) != (q := root(j)):
                parent[q] = p
                edges.append((docs[i], docs[j]))
        u = docs + [x for x, _ in edges]
        return u, [None] * len(docs) + [y for _, y in edges], links + [0] * len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task = None, []
        for batch in batches:
            columns = batch.to_pydict()
            for k, *row in zip(columns["task"], columns["rep"], columns["copies"], columns["side"], columns["grams"], columns["band"], columns["bands"], strict=True):
                if k != key and task:
                    u, v, w = finish(task)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.int64())], ["u", "v", "links"])
                    task = []
                key = k
                task.append(tuple(row))
        if task:
            u, v, w = finish(task)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.int64())], ["u", "v", "links"])

    return run


def _groups(scratch: Scratch, members: DataFrame, buckets: DataFrame, hubs: DataFrame, block: int) -> DataFrame:
    """The groups whose members are compared: every member by ``group`` and ``band`` (null in a cluster), with the group's size m.

    A cluster beyond ``block`` is compared bucket by bucket if that takes fewer pairs. Buckets of one cluster with the same members
    count once, as the first band in which a pair meets is that of the earliest of them.
    """
    sizes = scratch.write(members.groupBy("cluster").agg(F.count("*").alias("m")), "cluster-sizes")
    large = sizes.where(F.col("m") > block)
    of = hubs.join(members.select(F.col("rep").alias("hub"), "cluster"), "hub").join(large.withColumnRenamed("m", "whole"), "cluster")
    once = scratch.write(of.groupBy("cluster", "m", "mark", "cross", "whole").agg(F.min(F.struct("band", "bucket")).alias("b")).select("cluster", "m", "whole", "b.*"), "bucket-groups")
    pairs = once.groupBy("cluster", "whole").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    split = scratch.write(pairs.where(F.col("pairs") < F.col("whole") * F.col("whole")).select("cluster"), "split-clusters")
    columns = ["rep", "digest", "size", "copies"]
    whole = members.join(sizes.join(split, "cluster", "left_anti"), "cluster").select(*columns, F.col("cluster").alias("group"), F.lit(None).cast("int").alias("band"), "m")
    chosen = scratch.write(once.join(split, "cluster", "left_semi").select("bucket", "m"), "chosen-buckets")
    parts = buckets.join(chosen, "bucket").join(members.select(*columns), "rep").select(*columns, F.col("bucket").alias("group"), "band", "m")
    return scratch.write(whole.unionByName(parts), "groups")


def _tasks(scratch: Scratch, groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """One row for each task that a member takes part in: task, side (0, or 1 for the second of two blocks)."""
    step = F.floor(F.log("size") / F.lit(-math.log(threshold))).cast("int")
    kind = F.coalesce("band", F.lit(-1))
    one = groups.where(F.col("m") <= block).select("rep", "digest", "copies", "band", F.xxhash64(F.lit(0), "group", kind).alias("task"), F.lit(0).alias("side"))
    big = groups.where(F.col("m") > block).withColumn("s", step).drop("m")
    count = big.groupBy("group", "s").agg(F.count("*").alias("m"))
    parts = count.select("group", "s", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    near = parts.select("group", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).alias("s"), F.col("s").alias("t"), "parts")
    other = near.groupBy("group", "s").agg(F.collect_list(F.struct("t", "parts")).alias("others"))  # three at most
    own = scratch.write(parts.join(other, ["group", "s"]), "parts")
    dealt = big.join(own, ["group", "s"]).withColumn("j", F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("parts")).cast("int"))
    met = dealt.select("rep", "digest", "copies", "band", "group", "s", "j", F.explode(F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["parts"] - 1), lambda k: F.struct(o["t"].alias("t"), k.alias("k")))))).alias("o"))
    first = (F.col("s") < F.col("o.t")) | ((F.col("s") == F.col("o.t")) & (F.col("j") <= F.col("o.k")))
    low, high = F.struct(F.col("s").alias("a"), F.col("j").alias("b")), F.struct(F.col("o.t").alias("a"), F.col("o.k").alias("b"))
    pair = F.xxhash64(F.lit(1), "group", kind, F.least(low, high), F.greatest(low, high))
    return one.unionByName(met.select("rep", "digest", "copies", "band", pair.alias("task"), F.when(first, 0).otherwise(1).alias("side")))


def jaccard_join(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block: int = BLOCK) -> DataFrame:
    """Similarity classes of ``docs`` (doc_id, text; other columns are ignored) under shingle-set Jaccard similarity.

    Returns one row per input row: doc_id, class_id (smallest doc_id of the connected component of links; the document's own
    where it has none), n_links (documents linked with it, copies of its text included) and rep_id (smallest doc_id with the
    same text). Words are ASCII-lower-cased runs of letters, digits and characters beyond ASCII; a text of 1 to n-1 words has
    one shingle, its whole word sequence.

    Edge cases: a null or empty text, or one without words, has no shingles and links to nothing, not even to its copies;
    rows with a null doc_id come back with null class_id and rep_id and no links; rows that repeat a doc_id count as that many
    documents in ``n_links``, and if their texts differ they share a class and their links add up; an empty table gives an
    empty result.
    """
    tune(spark)
    scratch = Scratch(spark, "ngram-join")
    bands, rows = band_shape(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.write(docs.mapInArrow(trimmed(_sketch(n, bands, rows)), "doc_id long, digest binary, size long, bands array<long>"), "sketch")
    known = sketch.where("doc_id is not null and size > 0")
    reps = scratch.write(known.groupBy("digest").agg(F.min(F.struct("doc_id", "size", "bands")).alias("r"), F.count("*").alias("copies")).select("digest", F.col("r.doc_id").alias("rep"), F.col("r.size").alias("size"), "copies", F.col("r.bands").alias("bands")), "reps")
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    # a table of its own, so that both sides of the join are plain shuffles, of which a skewed one can be split
    mark = F.xxhash64("rep")  # two sums over the members tell buckets of the same ones
    hub = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.min("band").alias("band"), F.count("*").alias("m"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("mark"), F.bit_xor(mark).alias("cross"))
    hubs = scratch.write(hub.where("m > 1"), "hubs")
    edges = buckets.join(hubs.select("bucket", "hub"), "bucket").where("rep != hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    clusters = scratch.write(components(scratch, edges, "candidates").withColumnRenamed("node", "rep").withColumnRenamed("root", "cluster"), "clusters")
    members = scratch.write(reps.select("rep", "digest", "size", "copies").join(clusters, "rep"), "members")
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    grams = docs.join(sized(ids, members.count()), "doc_id", "left_semi").select("text").mapInArrow(trimmed(_cut_shingles(n)), "digest binary, grams binary")
    if not sketch.groupBy("doc_id").count().where("count > 1").join(ids, "doc_id", "left_semi").isEmpty():
        grams = grams.dropDuplicates(["digest"])  # repeated rows
    grams = scratch.write(grams, "grams")
    tasks = _tasks(scratch, _groups(scratch, members, buckets, hubs, block), threshold, block)
    bands_of = reps.select("digest", F.col("bands").alias("all_bands"))
    plain = tasks.where("band is null").withColumn("bands", F.lit(None).cast("array<long>"))
    tasks = plain.unionByName(tasks.where("band is not null").join(bands_of, "digest").withColumnRenamed("all_bands", "bands"))
    dealt = tasks.join(grams, "digest").repartition("task").sortWithinPartitions("task")
    found = scratch.write(dealt.select("task", "rep", "copies", "side", "grams", "band", "bands").mapInArrow(trimmed(_verify(threshold)), "u long, v long, links long"), "found")
    scratch.settle()
    classes = components(scratch, found.where("v is not null").select("u", "v"), "classes")
    links = found.where("v is null and links > 0").groupBy("u").agg(F.sum("links").alias("links"))
    by_rep = reps.select("digest", "rep", "copies").join(links, reps.rep == links.u, "left").drop("u").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    by_rep = by_rep.select("digest", F.col("rep").alias("rep_id"), F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    scratch.drop("hubs", "members", "grams", "groups", "parts")
    linked = sketch.select("doc_id", F.when(F.expr("doc_id is not null and size > 0"), F.col("digest")).alias("digest")).join(by_rep, "digest", "left")
    return linked.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep_id", "doc_id").alias("rep_id"))


def deduplicate(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each similarity class: the smallest doc_id, of equal ids any one, a null id only if the class has no
    other. All columns are kept. Rows are told apart by a number of their own, so null and repeated ids do no harm.
    """
    scratch = Scratch(spark, "duplicates")
    name = unused(docs, "row")
    rows = scratch.write(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    found = jaccard_join(spark, rows.select(F.col(name).alias("doc_id"), "text"), **options).where("n_links > 0").select(F.col("doc_id").alias("row"), "class_id")
    linked = scratch.write(rows.select(F.col(name).alias("row"), F.col("doc_id").alias("id")).join(found, "row"), "linked")
    keeper = scratch.write(linked.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("k")).select("k.row"), "keepers")
    gone = scratch.write(linked.join(keeper, "row", "left_anti").select(F.col("row").alias(name)), "gone")
    return rows.join(sized(gone), name, "left_anti").drop(name)
