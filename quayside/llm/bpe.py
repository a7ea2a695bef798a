"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into words on whole arrays of code points; the distinct words of a batch are laid out in one symbol array, and an
index maps each adjacent pair to all its positions there. Pairs are applied in ascending rank: one step merges every occurrence
of a pair in the batch, and the pairs that arise or vanish to its left and right update the index. Encoded words are kept
within a task, up to a bound, so a frequent word is merged once. Words are told apart by 64-bit hashes: among the million words that a
task holds at most, two agree with a chance of about 3 in 10**8.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import distinct as different, expand, mix, prefix_hash, span_hash, trimmed, tune, U

#: Characters that are cut into words at once.
CHUNK_CHARS = 1 << 17
#: Symbols of encoded words that a task keeps; beyond it, it starts afresh.
KEPT_SYMBOLS = 2_000_000
#: Unicode's White_Space characters, as the word pattern's \s has them.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE, SPECIAL = range(5)
#: Stands for an added token in arrays of code points.
MARK = 0x110000

_tables: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """The class of every code point in the word pattern."""
    if "kind" not in _tables:
        kind = np.zeros(MARK + 1, np.uint8)
        major = {"L": LETTER, "N": NUMBER}
        for c in range(sys.maxunicode + 1):
            if k := major.get(unicodedata.category(chr(c))[0]):
                kind[c] = k
        kind[SPACES], kind[MARK] = SPACE, SPECIAL
        _tables["kind"] = kind
        _tables["code"] = mix(np.arange(MARK + 1, dtype=np.uint64) + U(0xABCDEF))
    return _tables["kind"]


def byte_symbols() -> dict[str, int]:
    """Which printable character stands for which byte in the vocabulary: printable Latin-1 bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """The tables of a byte-level BPE vocabulary file."""

    pieces: list[bytes]  # by id
    byte_id: np.ndarray  # id of each single byte
    pair: np.ndarray  # sorted keys left * size + right
    rank: np.ndarray  # rank of each pair
    left: np.ndarray  # by rank
    right: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    flat: np.ndarray = field(init=False)  # bytes of all pieces
    at: np.ndarray = field(init=False)
    digits: np.ndarray = field(init=False)  # the ids as decimals, each with a comma before it
    digits_at: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.flat, self.at = np.frombuffer(b"".join(self.pieces), np.uint8), np.cumsum([0, *map(len, self.pieces)])
        texts = [f",{i}".encode() for i in range(len(self.pieces))]
        self.digits, self.digits_at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        symbol, vocab = byte_symbols(), file["model"]["vocab"]
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        size = 1 + max([*vocab.values(), *special.values()])
        pieces = [b""] * size
        for text, i in vocab.items():
            pieces[i] = bytes(symbol[c] for c in text) if all(c in symbol for c in text) else text.encode()
        for text, i in special.items():
            pieces[i] = text.encode()
        merges = [x.split(" ") if isinstance(x, str) else x for x in file["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        merged, key = np.array([vocab[a + b] for a, b in merges], np.int64), left * size + right
        order = np.argsort(key)
        one = {b: c for c, b in symbol.items()}
        return cls(pieces, np.array([vocab[one[b]] for b in range(256)], np.int64), key[order], order, left, right, merged, special)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left * len(self.pieces) + right
        place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[place] == key, self.rank[place], -1)


def cut_words(texts: list[str], special: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Cut texts as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` does.

    Returns where each word starts in the joined text (with its end as last entry), the words of each text, the words' hashes
    and the joined text, in which an added token is one character.
    """
    pieces, sizes, marks, at = [], [], [], 0
    for text in texts:
        parts, size, forced = [(text, -1)], 0, at
        for name, i in special.items():
            if name in text:
                split = []
                for part, known in parts:
                    if known >= 0:
                        split.append((part, known))
                    else:
                        for k, x in enumerate(part.split(name)):
                            split += [("\0", i)] * (k > 0) + [(x, -1)]
                parts = split
        for part, known in parts:
            if known >= 0:
                marks.append((at + size, known))
            pieces.append(part)
            size += len(part)
        at = forced + size
        sizes.append(size)
    joined = "".join(pieces)
    kinds = _kinds()
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    n, first = len(codes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if marks:
        codes[[m for m, _ in marks]] = MARK
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(texts), np.int64), np.zeros(0, np.uint64), joined
    kind = kinds[codes]
    start = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    stop = np.zeros(n + 1, bool)  # where nothing may be carried over from before
    stop[first], stop[n] = True, True
    if marks:
        special_at = np.flatnonzero(kind == SPECIAL)
        stop[special_at], stop[special_at + 1] = True, True
    start |= stop
    # white space before something: all but its last character is a word; a last blank joins what follows
    end = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~stop[1:n])
    start[end] = True
    blank = end[codes[end] == 32]
    start[blank + 1] = False
    # a single apostrophe that starts a word and the short endings after it
    quote = np.flatnonzero((codes == 39) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[start[quote + 1] & ~stop[quote + 1]]
    c1, c2 = codes[quote + 1], codes[np.minimum(quote + 2, n - 1)]
    one = np.isin(c1, [ord(c) for c in "stmd"])
    two = ((c1 == ord("r")) & (c2 == ord("e")) | (c1 == ord("v")) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))) & (quote + 2 < n) & ~stop[np.minimum(quote + 2, n)]
    start[quote[one | two] + 1] = False
    start[quote[one] + 2] = True
    start[quote[two] + 3] = True
    begin = np.flatnonzero(start)
    values = _tables["code"][codes]
    hashes = span_hash(prefix_hash(values), begin[:-1], begin[1:])
    for place, i in marks:
        hashes[np.searchsorted(begin, place)] = i + 1  # an added token's own
    return begin, np.diff(np.searchsorted(begin, first)), hashes, joined


def merge(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each word after all merges: (ids of all words, where each word starts)."""
    size = np.array([len(w) for w in words], np.int64)
    n, first = int(size.sum()), np.concatenate([[0], np.cumsum(size)])
    symbol = v.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[first[1:][size > 0] - 1] = -1
    before[first[:-1][size > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(position: np.ndarray) -> None:
        """Enter the pairs that start at these positions."""
        rank = v.ranks(symbol[position], symbol[after[position]])
        order = np.argsort(rank, kind="stable")
        position, rank = position[order], rank[order]
        cut = np.flatnonzero(np.diff(rank, prepend=-2))
        for k, (r, s) in enumerate(zip(rank[cut].tolist(), cut.tolist(), strict=True)):
            if r >= 0:
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(position[s : cut[k + 1] if k + 1 < len(cut) else None])

    add(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        p = lists[0] if len(lists) == 1 else different(np.concatenate(lists))
        a, b = v.left[r], v.right[r]
        q = after[p]
        live = (symbol[p] == a) & (q >= 0) & (symbol[q] == b)
        if not live.all():
            p, q = p[live], q[live]
        if a == b and len(p) > 1:  # in a run of one symbol, every other pair
            linked = np.concatenate([[False], q[:-1] == p[1:]])
            place = np.arange(len(p))
            keep = (place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0
            p, q = p[keep], q[keep]
        if not len(p):
            continue
        symbol[p], symbol[q] = v.merged[r], -1
        behind = after[q]
        after[p] = behind
        has = behind >= 0
        before[behind[has]] = p[has]
        front = before[p]
        touched = np.concatenate([front[front >= 0], p[has]])
        if len(touched):
            add(different(touched) if a == b else touched)
    left = symbol >= 0
    return symbol[left], np.concatenate([[0], np.cumsum(left)])[first]


class Encoder:
    """Encodes batches of texts, keeping the words that it has met."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.reset()

    def reset(self) -> None:
        ids = np.array(sorted(self.v.special.values()), np.int64)  # an added token's hash is its id plus 1
        self.hash, self.place = (ids + 1).astype(np.uint64), np.arange(len(ids))
        self.symbols, self.at = [ids], np.arange(len(ids) + 1)
        self.flat = ids

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if len(self.flat) > KEPT_SYMBOLS:
            raise OverflowError
        ids, first = merge(words, self.v)
        self.at = np.concatenate([self.at, len(self.flat) + first[1:]])
        self.flat = np.concatenate([self.flat, ids])
        self.hash, place = np.concatenate([self.hash, hashes]), np.concatenate([self.place, len(self.place) + np.arange(len(words))])
        order = np.argsort(self.hash)
        self.hash, self.place = self.hash[order], place[order]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, tokens of each text) of successive runs of the texts."""
        if len(self.flat) > KEPT_SYMBOLS:
            self.reset()
        parts, fresh = [], {}
        lo = total = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or total and total + len(texts[i]) > CHUNK_CHARS:
                begin, counts, hashes, joined = cut_words(texts[lo:i], self.v.special)
                distinct, where = np.unique(hashes, return_index=True)
                spot = np.minimum(np.searchsorted(self.hash, distinct), len(self.hash) - 1)
                for h, w in zip((new := self.hash[spot] != distinct).nonzero()[0].tolist(), where[new].tolist(), strict=True):
                    if (key := int(distinct[h])) not in fresh:
                        fresh[key] = joined[begin[w] : begin[w + 1]].encode()
                parts.append((hashes, counts))
                lo, total = i, 0
            if i < len(texts):
                total += len(texts[i])
        if fresh:
            self.learn(np.fromiter(fresh, np.uint64, len(fresh)), list(fresh.values()))
        for hashes, counts in parts:
            word = self.place[np.searchsorted(self.hash, hashes)]
            lengths = self.at[word + 1] - self.at[word]
            edges = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
            yield self.flat[expand(self.at[word], lengths)], np.diff(edges)


def spell(flat: np.ndarray, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The pieces of each run of ids, one after the other."""
    lengths = at[ids + 1] - at[ids]
    data = flat[expand(at[ids], lengths)].tobytes()
    edges = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in spell(v.flat, v.at, ids, counts)]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _encode(shared, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        v = encoder.v
        for batch in batches:
            done = 0
            for ids, counts in encoder.encode(_texts(batch.column(1))):
                doc_id = batch.column(0).slice(done, len(counts))
                done += len(counts)
                if digest:
                    decimals = [hashlib.sha256(x[1:]).hexdigest() for x in spell(v.digits, v.digits_at, ids, counts)]
                    texts = [hashlib.sha256(x.encode()).hexdigest() for x in decode(v, ids, counts)]
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.array(decimals, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "n_tokens", "ids"])

    return run


def _share(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary.load(path))  # a vocabulary file, whatever the data


def bpe_encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every text with the byte-level BPE vocabulary file at ``path`` (on the driver): doc_id, n_tokens, ids.

    The strings of added tokens become those tokens, none are added. Edge cases: a null or empty text has no tokens; a null or
    repeated doc_id is carried along; other columns are ignored; an empty table gives an empty result.
    """
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_encode(_share(spark, path), False)), "doc_id long, n_tokens long, ids array<int>")


def bpe_decode(spark: SparkSession, tokens: DataFrame, path: str) -> DataFrame:
    """Texts of token ids (doc_id, ids): doc_id, text. Null ids give an empty text; added tokens are spelled out."""
    shared = _share(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            ids = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode(shared.value, ids, np.array([len(x) for x in lists], np.int64)), pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(trimmed(run), "doc_id long, text string")


def bpe_round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Encode every text, decode its ids, and digest both: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256. Edge cases as in :func:`bpe_encode`."""
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_encode(_share(spark, path), True)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
