"""Every operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quayside.llm import bpe, chat_format, decontam, lm_bloom, ngram_join, quality, queries, sharding, suffix_dedup, topk, toxicity

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Columns that the operators use inside; inputs may have them too.
CLASH = "row long, digest string, spans string, anchor string, size string, bucket string, `group` string, shard string, label string, x string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120))) for _ in range(n)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    for i in range(0, n, 7):
        texts[i] = texts[i] + "\n" + passage
    for i in range(1, n, 9):
        w = texts[i - 1].split(" ")
        if len(w) > 30:
            w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)
    long = " ".join(r.choice(vocabulary) for _ in range(60_000))
    return [*texts, texts[3], texts[3], None, "", "   ", "!!!", "!!!", "ab", "ab", "a" * 900, long]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, *[None] * 10) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids."""
    return spark.createDataFrame([(None, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six"), (8, None), (None, None), (7, "other words here")], "doc_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_jaccard_join_finds_every_link(spark, docs, texts):
    for block in (128, 2):
        got = by_id(ngram_join.jaccard_join(spark, docs, block=block))
        sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
        links, parent = Counter(), list(range(len(texts)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
        assert sum(links.values()) > 10
        for i in range(len(texts)):
            assert (got[i]["n_links"], got[i]["class_id"]) == (links[i], root(i))
    kept = ngram_join.deduplicate(spark, docs)
    assert {r["doc_id"] for r in kept.collect()} == {root(i) for i in range(len(texts))}
    assert kept.columns == docs.columns


def test_jaccard_join_odd_rows(spark, odd, none):
    rows = ngram_join.jaccard_join(spark, odd).collect()
    assert len(rows) == 6
    assert [r["class_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert ngram_join.jaccard_join(spark, none).count() == 0
    assert ngram_join.band_shape(0.8, 0.9999) == (20, 4)


def test_preference_pairs(spark):
    turns = "pair_id long, turn long, role string, text string, side string"
    chosen = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "good", "x"), (2, 0, "user", "a", None), (2, 1, "assistant", "b", None), (3, 0, None, None, "x"), (None, 0, "user", "z", "x"), (4, 0, "user", "only", "x"), (5, None, "user", "n", ""), (5, 0, "user", "n", "")]
    rejected = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "bad", "x"), (2, 0, "user", "a", None), (2, 1, "assistant", "b", None), (2, 2, "user", "c", None), (3, 0, "user", "", "x"), (5, 0, "user", "n", ""), (5, 0, "user", "m", "")]
    pairs = chat_format.preference_pairs(spark.createDataFrame(chosen, turns), spark.createDataFrame(rejected, turns))
    got = {r["pair_id"]: r for r in chat_format.preference_texts(pairs).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["n_prompt_turns"] == 1 and got[1]["prompt"] == "<|im_start|>user\nq<|im_end|>\n"
    assert got[1]["chosen"] == "<|im_start|>assistant\ngood<|im_end|>\n" and got[1]["chosen_mask"] == "0:22,1:15"
    assert got[2]["n_prompt_turns"] == 2 and got[2]["chosen"] == "" and "c<|im_end|>" in got[2]["rejected"]
    assert got[3]["n_prompt_turns"] == 1 and got[3]["chosen"] == got[3]["rejected"] == ""
    assert got[4]["n_prompt_turns"] == 0 and got[4]["rejected"] is None and "only" in got[4]["chosen"]
    assert got[5]["n_prompt_turns"] == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1
    empty = spark.createDataFrame([], turns)
    assert chat_format.preference_pairs(empty, empty).count() == 0


def _labelled(spark, n=400):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 80))]
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        if toxic:
            w.insert(r.randrange(len(w)), "zuxqo" + r.choice(["", "n", "rr", "kk"]))
        if not good:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "label", "at"), [(toxicity.toxicity, "toxic", 0.5), (quality.quality, "quality", 0.3)])
def test_classifiers(spark, odd, none, docs, run, label, at):
    rows, labels = _labelled(spark)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    got = by_id(run(spark, rows, labels))
    assert len(got) == len(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at) for r in got.values())
    # labels of the held-out fifth don't matter
    from pyspark.sql import functions as F

    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    again = by_id(run(spark, rows, flipped))
    assert all(again[i]["score"] == got[i]["score"] for i in got)
    assert run(spark, odd, labels).count() == 6
    assert run(spark, docs, labels).count() == docs.count()
    assert run(spark, none, labels).count() == 0
    one = labels.withColumn(label, F.lit(1))
    assert {r["predicted"] for r in run(spark, rows, one).collect()} == {1}
    assert run(spark, rows, labels.limit(0)).count() == len(truth)
    strange = labels.unionByName(spark.createDataFrame([(None, 1, 1), (0, None, None), (1, 7, 7)], labels.schema))
    assert run(spark, rows, strange).count() == len(truth)


def test_toxic_documents_go(spark):
    rows, labels = _labelled(spark)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(spark, rows, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sum(truth[i] for i in kept) < 0.1 * sum(truth.values())
    assert sum(1 - truth[i] for i in kept) > 0.97 * sum(1 - x for x in truth.values())
    mixed = spark.createDataFrame([(None, "abc zuxqo def"), (None, "abc def"), (5, "abc zuxqor"), (5, "abc def"), (6, None), (7, "")], "doc_id long, text string")
    left = [tuple(r) for r in toxicity.drop_toxic(spark, mixed.unionByName(rows), labels).where("doc_id is null or doc_id in (5, 6, 7)").collect()]
    assert (None, "abc def") in left and (5, "abc def") in left and (6, None) in left and (7, "") in left and not any("zuxqo" in (t or "") for _, t in left)


def _covered(data, size):
    place = defaultdict(list)
    for i, t in enumerate(data):
        for k in range(len(t) - size + 1):
            place[t[k : k + size]].append((i, k))
    cover = [bytearray(len(t)) for t in data]
    for found in place.values():
        if len(found) > 1:
            for i, k in found:
                cover[i][k : k + size] = b"\1" * size
    return cover


@pytest.mark.parametrize(("size", "group"), [(400, 192), (60, 1), (20, 2), (7, 3)])
def test_suffix_dedup_is_exact(spark, texts, docs, size, group):
    use = docs.where("coalesce(length(text), 0) < 20000") if size < 400 else docs
    got = by_id(suffix_dedup.dedup_report(spark, use, size, group))
    data = [(t or "").encode() for t in texts]
    data = [t if len(t) < 20000 or size == 400 else b"" for t in data]
    for i, (t, c) in enumerate(zip(data, _covered(data, size), strict=True)):
        if i in got:
            runs = sum(1 for k in range(len(c)) if c[k] and not (k and c[k - 1]))
            kept = hashlib.sha256(bytes(x for x, y in zip(t, c, strict=True) if not y)).hexdigest()
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), sum(c), runs, kept)


def test_maximal_repeats_lists_all_occurrences():
    left = [x[::-1] for x in (b"xxab", b"yyab", b"zzab", b"q")]
    right = [b"cdefg", b"cdefg", b"cdxx", b"cdefg"]
    found = {(a, b): sorted(m) for a, b, m in suffix_dedup.maximal_repeats(left, right, 4)}
    assert found[(2, 5)] == [0, 1]
    assert found[(2, 2)] == [0, 1, 2]
    assert found[(0, 5)] == [0, 1, 3]


def test_passages_go_and_clean_texts_stay(spark, odd, none, docs, texts):
    out = suffix_dedup.remove_passages(spark, docs.withColumn("n_chars", docs.doc_id))
    assert out.columns == [*docs.columns, "n_chars"] and out.count() == len(texts)
    got = by_id(out)
    passage = texts[0].split("\n")[1]
    assert all(passage not in (r["text"] or "") for r in got.values())
    assert got[len(texts) - 1]["text"] == texts[-1] and got[4]["text"] == texts[4]
    names = suffix_dedup.remove_passages(spark, docs.withColumn("row_", docs.doc_id).withColumn("__row", docs.doc_id).withColumn("__spans", docs.doc_id))
    assert names.columns == [*docs.columns, "row_", "__row", "__spans"] and names.where("not (row_ <=> doc_id and __row <=> doc_id and __spans <=> doc_id)").count() == 0
    assert suffix_dedup.remove_passages(spark, none).count() == 0 and ngram_join.deduplicate(spark, none).count() == 0
    assert suffix_dedup.dedup_report(spark, odd, 10).count() == 6
    assert suffix_dedup.dedup_report(spark, none).count() == 0


def test_decontamination(spark, docs, texts, odd, none):
    items = [(0, " ".join(words(texts[0])[3:40])), (1, "never there at all in any of the texts of this corpus"), (2, "ab"), (2, None), (None, texts[0]), (11, texts[5]), (11, texts[5]), (3, "!!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        if w := words(t):
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(i)
    for limit in (1 << 24, 50):
        got = by_id(decontam.contamination(spark, docs, bench, block_bytes=limit))
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if x := windows.get(tuple(w[k : k + n])):
                        found |= x
                        hit |= set(range(k, k + n))
            code = hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest()
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) == (len(w), len(hit), len(found), code, bool(hit))
    first = by_id(decontam.verbatim_matches(spark, docs, bench))[0]["matches"]
    assert any(m["item_id"] == "0" and m["doc_word"] == 3 and m["words"] == len(words(items[0][1])) for m in first)
    clean = decontam.decontaminate(spark, docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i in got if not got[i]["contaminated"]} and clean.columns == docs.columns
    rows = decontam.decontaminate(spark, odd, spark.createDataFrame([(1, "two three four")], "item_id long, text string")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(8, None), (None, None), (7, "other words here")], key=str)
    assert {r["doc_id"] for r in decontam.decontaminate(spark, docs, bench, block_bytes=50).collect()} == {r["doc_id"] for r in clean.collect()}
    assert decontam.decontaminate(spark, none, bench).count() == 0 and decontam.decontaminate(spark, odd, bench.limit(0)).count() == 6
    assert decontam.contamination(spark, odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(spark, none, bench).count() == 0


def test_bpe_equals_the_library(spark, docs, texts, odd, none):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.VOCABULARY)
    r = random.Random(2)
    more = ["".join(r.choice("aabs'tdlrve  \n\t1é中!\u0085　") for _ in range(r.randint(0, 50))) for _ in range(800)]
    more += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "x" * 3000, "\U0001f600 \0\x7f", " 's 're'm''s !'s"]
    for chunk in (bpe.CHUNK_CHARS, 40):
        before, bpe.CHUNK_CHARS = bpe.CHUNK_CHARS, chunk
        encoder, got = bpe.Encoder(bpe.Vocabulary.load(queries.VOCABULARY)), []
        for ids, counts in encoder.encode(more):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        bpe.CHUNK_CHARS = before
        assert got == [x.ids for x in known.encode_batch(more, add_special_tokens=False)]
    rows = by_id(bpe.bpe_round_trip(spark, docs, queries.VOCABULARY))
    for i, t in enumerate(texts):
        ids = known.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = by_id(bpe.bpe_decode(spark, bpe.bpe_encode(spark, docs, queries.VOCABULARY), queries.VOCABULARY))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(texts))
    assert bpe.bpe_round_trip(spark, odd, queries.VOCABULARY).count() == 6
    assert bpe.bpe_encode(spark, none, queries.VOCABULARY).count() == 0
    assert bpe.bpe_decode(spark, bpe.bpe_encode(spark, none, queries.VOCABULARY), queries.VOCABULARY).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.3, 16).tolist(), "x") for i in range(300)] + [(i, [0.5] * 16, "x") for i in range(300, 420)]
    rows += [(500, None, ""), (501, [1.0, None], ""), (502, [float("nan")] * 16, ""), (503, [1.0], ""), (504, [2.0], ""), (None, [0.1] * 16, ""), (0, rows[0][1], ""), (505, [1e30] * 16, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    valid = [(i, np.floor(256 * np.array(v, float))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    for block in (2_000_000, 40):
        got = defaultdict(list)
        for x in topk.top_k(spark, df, df.where("vec_id % 25 = 0 or vec_id = 503"), block_values=block).collect():
            got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
        asked = {i: v for i, v in valid if i % 25 == 0 or i == 503}
        assert set(got) == set(asked)
        for q, v in asked.items():
            scores = sorted((-min(sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), topk.LONG), i) for i, w in valid if i != q and len(w) == len(v))[:5]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert topk.top_k(spark, df.limit(0), df).count() == 0 and topk.top_k(spark, df, df.limit(0)).count() == 0


def test_sharding(spark, docs, texts, odd, none):
    many = spark.createDataFrame([(i, f"text {i % 700 if i % 3 else 0}") for i in range(3000)], "doc_id long, text string")
    for df in (docs, many, odd):
        rows = sharding.shard_documents(spark, df).collect()
        counts = Counter(r["shard"] for r in rows)
        assert len(rows) == df.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
        for s in counts:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
        assert {r["law"] for r in rows} == {"rows"}
    rows = by_id(sharding.shard_documents(spark, docs))
    for i, t in enumerate(texts):
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    spread = defaultdict(set)
    for r in sharding.shard_documents(spark, many).join(many, "doc_id").collect():
        spread[r["text"]].add(r["shard"])
    assert len(spread["text 0"]) <= 12 and np.mean([len(x) for k, x in spread.items() if k != "text 0"]) < 1.2
    assert sharding.shard_documents(spark, none).count() == 0


def test_short_words_and_unspaced_passages_go(spark):
    r = random.Random(6)
    short = " ".join(r.choice("abcdefghij") for _ in range(60))
    solid = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(200))
    few = " ".join("".join(r.choice("klmnop") for _ in range(9)) for _ in range(20))
    own = [" ".join("".join(r.choice("qrstuv") for _ in range(7)) for _ in range(40)) + chr(0x3041 + i) for i in range(6)]
    texts = [own[0] + short, own[1] + short, own[2] + solid, own[3] + solid, own[4] + few, own[5] + few]
    got = by_id(suffix_dedup.remove_passages(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["text"] for i in range(6)] == [*own[:4], *texts[4:]]


def test_spans_stay_with_their_rows_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = line(500)
    texts = [line(300) + chr(0x4E00 + i) + (passage if i % 5 == 0 else line(50)) for i in range(48)]
    for i in range(12):
        spark.createDataFrame([(k, texts[k]) for k in range(i, 48, 12)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    search = suffix_dedup.repeated_spans

    def then_split_anew(*a):
        out = search(*a)
        spark.conf.set("spark.sql.files.minPartitionNum", "12")
        return out

    monkeypatch.setattr(suffix_dedup, "repeated_spans", then_split_anew)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        got = by_id(suffix_dedup.dedup_report(spark, spark.read.parquet(f"{tmp_path}/docs")))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert {i for i, x in got.items() if x["n_removed"]} == set(range(0, 48, 5))
    assert all(got[i]["kept_sha256"] == hashlib.sha256(texts[i][:301].encode()).hexdigest() for i in range(0, 48, 5))


def test_lm_scores(spark, docs, texts, odd, none):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    learn = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i in learn for w in tokens[i])
    total, types = sum(c.values()), len(c)
    for head in (lm_bloom.HEAD, 5, 0):
        got = by_id(lm_bloom.lm_score(spark, docs, head=head))
        for i, t in tokens.items():
            base = sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t)
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in learn, len(t), sum(c[w] > 0 for w in t), total)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    tiny = by_id(lm_bloom.lm_score(spark, docs, filter_bytes=4096))
    assert all(r["score"] <= 0 for r in tiny.values()) and tiny[0]["base_score"] == pytest.approx(got[0]["base_score"])
    assert lm_bloom.lm_score(spark, odd).count() == 6
    assert lm_bloom.lm_score(spark, none).count() == 0


def test_lm_filter_holds_all_ngrams_at_any_size(spark, docs, odd, none):
    want = by_id(lm_bloom.lm_score(spark, docs, filter_bytes=48 << 20))
    for size in (4096, 0):  # not broadcast, but probed by segment
        got = by_id(lm_bloom.lm_score(spark, docs, filter_bytes=size))
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert r["score"] == pytest.approx(want[i]["score"], rel=1e-9) and r["base_score"] == pytest.approx(want[i]["base_score"], rel=1e-9)
            assert (r["held_out"], r["n_tokens"], r["n_known"]) == (want[i]["held_out"], want[i]["n_tokens"], want[i]["n_known"])
    assert lm_bloom.lm_score(spark, odd, filter_bytes=0).count() == 6 and lm_bloom.lm_score(spark, none, filter_bytes=0).count() == 0


def test_lm_score_equals_brute_force(spark, docs, texts):
    """From exact counts, quantised as the filter has them; a probe may take an n-gram for a little more frequent than it is."""
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    held = lambda n: float(lm_bloom.expected(lm_bloom.quantise(np.array(n))))
    one = Counter(w for i in learn for w in tokens[i])
    two = Counter(x for i in learn for x in zip([None, *tokens[i]], tokens[i], strict=False))
    total = sum(held(c) for c in one.values()) + len(one) + 1
    # dealt in one step and in several, and in few and many buckets
    runs = [by_id(lm_bloom.lm_score(spark, docs)), by_id(lm_bloom.lm_score(spark, docs, bucket_bytes=500, digit=2))]
    for i, t in tokens.items():
        sums = []
        for most, half in lm_bloom.TRUST:
            s = 0.0
            for v, w in zip([None, *t], t, strict=False):
                cv, cvw = held(one[v]), held(two[v, w])
                k = most * cv / (cv + half)
                s += math.log(k * min(cvw / max(cv, 1), 1) + (1 - k) * (held(one[w]) + 1) / total)
            sums.append(s)
        want = (np.logaddexp.reduce(sums) - math.log(len(sums))) / math.log(10)
        for got in runs:
            assert abs(got[i]["score"] - want) <= 0.02 * abs(want) + 0.5
    # the probabilities of all words after one, and of one unknown, make 1 for exact counts
    v = texts[5].split()[0].translate(LOWER)
    if max(n for (a, _), n in two.items() if a == v) < 8 and one[v] < 8:
        k = 0.5 * one[v] / (one[v] + 10)
        assert sum(k * two[v, w] / one[v] + (1 - k) * (held(one[w]) + 1) / total for w in one) + (1 - k) / total == pytest.approx(1)


def test_levels_are_exact_for_small_counts():
    n = np.arange(1, 100_000)
    assert (np.diff(lm_bloom.quantise(n)) >= 0).all() and (lm_bloom.expected(lm_bloom.quantise(n[:6])) == n[:6]).all() and len(lm_bloom.LOWS) < 256
    assert (np.abs(lm_bloom.expected(lm_bloom.quantise(n)) / n - 1) < 0.1).all() and lm_bloom.expected(np.zeros(1, int))[0] == 0


def test_log_filter_never_undercounts():
    r = np.random.default_rng(3)
    key = np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64)) * np.uint64(2)
    count = (r.pareto(1.0, len(key)) * 2 + 1).astype(np.int64)
    bucket = (key >> np.uint64(55)).astype(int)
    segments = {b: lm_bloom.build_segment([key[bucket == b]], [count[bucket == b]], 1 << 16).tobytes() for b in set(bucket.tolist())}
    f = lm_bloom.LogFilter(segments)
    assert (f.counts(key) >= lm_bloom.expected(lm_bloom.quantise(count)) - 1e-9).all()
    assert (f.counts(r.integers(0, 1 << 63, 20000).astype(np.uint64)) > 0).mean() < 0.1
    assert (np.abs(np.log(lm_bloom.expected(lm_bloom.quantise(count)) / count)) < 0.36).all()


def test_a_chain_of_buckets_is_compared_bucket_by_bucket(spark):
    """Texts that each overlap the next one make one cluster of many buckets; only neighbours are alike enough."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    chain = [[word() for _ in range(300)]]
    for _ in range(39):
        chain.append([*chain[-1][25:], *(word() for _ in range(25))])
    texts = [" ".join(w) for w in chain]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in chain]
    links = Counter(x for i in range(40) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for x in (i, j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (3, 128):
        got = by_id(ngram_join.jaccard_join(spark, df, block=block))
        assert {i: got[i]["n_links"] for i in range(40)} == {i: links[i] for i in range(40)} and {x["class_id"] for x in got.values()} == {0}


def test_deduplicate_keeps_one_row_of_a_class(spark, odd, none):
    kept = [tuple(r) for r in ngram_join.deduplicate(spark, odd).collect()]
    assert sorted(kept, key=str) == sorted([(7, "one two three four five six"), (8, None), (None, None), (7, "other words here")], key=str)
    alone = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "other", 3)], "doc_id long, text string, row_0 int")
    rows = ngram_join.deduplicate(spark, alone).collect()
    assert len(rows) == 2 and {r["doc_id"] for r in rows} == {None, 3} and ngram_join.deduplicate(spark, alone).columns == alone.columns
    assert ngram_join.deduplicate(spark, none).count() == 0


def test_suffix_dedup_of_files(spark, tmp_path, texts):
    """From files, as the queries read them, in many small splits."""
    rows = [(i, t) for i, t in enumerate(texts) if len(t or "") < 20000]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(f"{tmp_path}/docs")
    got = by_id(suffix_dedup.dedup_report(spark, spark.read.parquet(f"{tmp_path}/docs"), 60))
    data = [(t or "").encode() for _, t in rows]
    for (i, _), t, c in zip(rows, data, _covered(data, 60), strict=True):
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (sum(c), hashlib.sha256(bytes(x for x, y in zip(t, c, strict=True) if not y)).hexdigest())


def test_toxicity_scores_equal_brute_force():
    """The score of a text from the vectors: every word the mean of its n-grams' vectors, every three words their mean, the highest logit."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcéd") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))) for _ in range(60)] + ["", "!!", "Ab"]
    labels = np.array([int("abc" in t) for t in texts])
    model = toxicity.fit(texts, labels, (2, 2))
    bag = toxicity.bags(texts)
    got = toxicity.score(model.weight.astype(float), model.offset, model.prior, texts)
    for i, t in enumerate(texts):
        vectors = [model.vectors[bag.grams[bag.at[w] : bag.at[w + 1]]].astype(float).mean(0) for w in bag.word[bag.first[i] : bag.first[i + 1]]]
        if not vectors:
            assert got[i] == model.prior
            continue
        width = min(3, len(vectors))
        logits = [np.mean(vectors[k : k + width], 0) @ model.softmax.astype(float) + model.bias for k in range(len(vectors) - width + 1)]
        assert got[i] == pytest.approx(max(1 / (1 + math.exp(a - b)) for a, b in logits), abs=1e-4)
    edged = [[f" {w} "[k : k + n] for n in (3, 4, 5) for k in range(len(w) + 2 - n + 1)] for w in texts[0].split()]
    assert [int(bag.at[w + 1] - bag.at[w]) for w in bag.word[: bag.first[1]]] == [len(x) for x in edged]


def test_quality_scores_equal_brute_force():
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(0, 1, (70, 5)), r.normal(1, 2, (50, 5))])
    y = np.array([0] * 70 + [1] * 50)
    model = quality.Discriminant.fit(x, y, np.array([0.6, 0.4]), pool=0.3, sphere=0.05)
    z = (x - x.mean(0)) / x.std(0)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (70 * own[0] + 50 * own[1]) / 120
    log = []
    for c in (0, 1):
        s = 0.7 * own[c] + 0.3 * pooled
        s = 0.95 * s + 0.05 * np.trace(s) / 5 * np.eye(5)
        d = z - z[y == c].mean(0)
        log.append(np.log([0.6, 0.4][c]) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.logit(x), log[1] - log[0])


def test_sharding_cuts_fewer_links_than_chance(spark):
    """Links between copies whose ends lie in different shards, against those of a random assignment of the same sizes."""
    rows = [(i, f"text {i % 300}") for i in range(1500)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()}
    pairs = [(i, i + 300 * k) for i in range(300) for k in range(1, 5)]
    assert sum(got[a] != got[b] for a, b in pairs) < 0.1 * len(pairs)  # 5 in 6 by chance
