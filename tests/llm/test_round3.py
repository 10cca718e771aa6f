"""Importance resampling, spelling variants and packing against brute force: nulls, empty and long texts, ties,
repeated rows, clashing column names, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import importance, packing, variants

SCHEMA = ("doc_id long, text string, weight string, score string, rank string, n_words string, word string, n string,"
          " sequence_id string, ids string, `start` string")
VOCAB = "house river stone cloud light paper table green seven walk under over maybe other été straße ÑANDÚ q7 x".split()


def _texts():
    rng = np.random.default_rng(11)
    make = lambda n: " ".join(rng.choice(VOCAB, n))
    return [*[make(int(n)) for n in rng.integers(1, 90, 24)], make(9000), None, "", " \n ", "x", "don't <|endoftext|> stop",
            "a\x1cb \x1f c ½ ª º ×÷ x́! 12a3 foo_bar...", "aaaa aaaaa aaaaaa", "housse housse housse river", "日本語 text" * 9,
            "riverr rivver " * 4, "iver " * 7]


ROWS = [(None if i == 3 else i, t, *["x"] * 9) for i, t in enumerate(_texts())]
ROWS += [ROWS[2], ROWS[2], (5, "another text of the same id " * 6, *["x"] * 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _buckets(text, n, buckets):
    w = _words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_importance_equals_brute_force(spark, docs, n):
    target = ["river stone cloud", None, "light paper", "the unseen words"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    s, t = Counter(), Counter()
    for r in ROWS:
        s.update(_buckets(r[1], n, 100))
    for x in target:
        t.update(_buckets(x, n, 100))
    s_all, t_all = s.total() + 100, t.total() + 100
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(100)]
    want = []
    for r in ROWS:
        f = _buckets(r[1], n, 100)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((r[0], len(_words(r[1])), len(f), weight, score))
    got = importance.resample(docs, bench, n=n, buckets=100, least_words=5, percent=40).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([tuple(g)[:5] for g in got], key=key) == sorted(want, key=key)
    able = sorted((w for w in want if w[1] >= 5), key=lambda w: (-w[4], w[0] is not None, w[0] or 0))
    most = len(able) * 40 // 100
    ranked = sorted((g for g in got if g["rank"] is not None), key=lambda g: g["rank"])
    assert [g["rank"] for g in ranked] == list(range(1, most + 1))
    assert [(g["doc_id"], g["score"]) for g in ranked] == [(w[0], w[4]) for w in able[:most]]


def test_head_and_tail_give_the_same_buckets():
    texts = [[w.encode() for w in _words(t)] for t in _texts()]
    whole = importance.Features(3, 997)
    head = importance.Features(3, 997, [b"house", b"river", b"x"], [(b"house", b"river"), (b"x", b"x")])
    for a, b in zip(whole.of(texts), head.of(texts), strict=True):
        assert (a == b).all()
    assert len(head.of([])[0]) == 0 and len(head.of([[]])[0]) == 0


def test_importance_of_an_empty_table(spark, docs, none):
    assert importance.resample(none, docs).count() == 0
    got = importance.resample(docs, none, n=1)
    assert got.count() == len(ROWS) and got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(4, 9))) for _ in range(500)} | {"aaaa", "aaaaa", "aaaaaa", "日本語文", "日本語文字"}
    got = {tuple(r) for r in variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and _near(a, b)}
    assert len(got) > 500  # the table isn't trivial


def test_variants_equal_brute_force(docs, none):
    count = Counter()
    for r in ROWS:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            count[run if h % 7 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 4 and c >= 2}
    want = {}
    for w in n:
        near = sorted((v for v in n if _near(v, w)), key=lambda v: (-n[v], v))
        form = near[0] if near and n[near[0]] >= 2 * n[w] else None
        want[w] = [form, n[w], len(near), n[form] if form else None]
    found = variants.runs(docs).select(variants.noised(F.col("run"), F.col("doc_id"), 7).alias("word"))
    got = variants.forms(variants.vocabulary(found, 4, 2)).collect()
    assert {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"]] for r in got} == want and len(got) == len(want)
    for r in got:
        at = r["word"]
        while want[at][0]:
            at = want[at][0]
        assert r["root"] == at
    assert sum(r["form"] is not None for r in got) >= 3
    assert variants.forms(variants.vocabulary(variants.runs(none).select(F.col("run").alias("word")))).count() == 0
    with pytest.raises(ValueError):
        variants.near_pairs(docs.limit(1).select(F.lit("abc").alias("word")))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_keeps_every_id_once(spark, docs, none, capacity):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    pieces = packing.pack(docs, capacity=capacity)
    rows = pieces.collect()
    want = Counter((r[0], *tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1) for r in ROWS)
    by_doc = {}
    for p in rows:
        assert p["length"] * 4 == len(p["ids"]) > 0 and p["offset"] + p["length"] <= capacity
        by_doc.setdefault(p["doc_id"], []).append(p)
    told = {i: [k for k, n in want.items() for _ in range(n) if k[0] == i] for i in by_doc}
    for i, ps in by_doc.items():
        assert sum(p["length"] for p in ps) == sum(len(k) - 1 for k in told[i])
        if len(told[i]) == 1:
            ps.sort(key=lambda p: p["start"])
            assert [p["start"] for p in ps] == list(np.cumsum([0, *(p["length"] for p in ps)])[:-1])
            assert tuple(np.frombuffer(b"".join(p["ids"] for p in ps), "<u4")) == told[i][0][1:]
    assert set(by_doc) == {r[0] for r in ROWS}
    seqs, padding = {}, 0
    for p in rows:
        seqs.setdefault(p["sequence_id"], []).append(p)
    for ps in seqs.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == list(np.cumsum([0, *(p["length"] for p in ps)])[:-1])
        n = sum(p["length"] for p in ps)
        padding += 0 if n & n - 1 == 0 else capacity - n
    used = sum(p["length"] for p in rows)
    assert padding <= 0.05 * used
    whole = packing.sequences(pieces, capacity, 7).collect()
    assert sum(len(s["ids"]) for s in whole) == used + padding and sum(s["used"] for s in whole) == used
    assert packing.pack(none, capacity=capacity).count() == 0


def test_many_workers_pass_on_what_is_left(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    few, many = packing.pack(docs, capacity=128), packing.pack(docs.repartition(9), capacity=128)
    assert few.agg(F.sum("length")).first()[0] == many.agg(F.sum("length")).first()[0]
    full = many.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert full.filter("n <> m or n > 128").count() == 0


def test_encoder_equals_the_library_when_it_forgets():
    encoder = packing.WordEncoder(packing.word_tokenizer(), memory=2000)
    for _ in range(2):
        for t in _texts():
            want = encoder._tokenizer.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode([t or ""])[0], "<u4").tolist() == want


def test_a_repeated_query_lists_each_neighbour_once(spark):
    from logloom.llm import topk
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-9, 9, 6).astype(float).tolist()) for i in range(60)]
    c = spark.createDataFrame(rows, "id long, v array<double>")
    q = spark.createDataFrame([rows[0], rows[0], rows[5]], "id long, v array<double>")
    got = topk.top_k(c, q, 10).collect()
    for i in (0, 5):
        scores = sorted(((-int(np.dot(rows[i][1], v)), j) for j, v in rows if j != i))[:10]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == [
            (n, j, -s) for n, (s, j) in enumerate(scores, 1)]


def test_a_null_doc_id_keeps_its_added_spans(spark):
    from logloom.llm import secrets
    key = "qZ8kT1vX0pLr7WcJ3nBd5yHs2MfGa9Ue4KtRiVo6"
    rows = spark.createDataFrame([(None, f"see {key} now"), (1, f"see {key} now"), (2, "nothing")], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(rows).collect()}
    assert spans[None] == spans[1] != [] and spans[2] == []


def test_ann_lists_each_neighbour_once_for_a_repeated_query(spark):
    from logloom.llm import ann
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(80)]
    index = ann.Index(spark.createDataFrame(rows, "id long, v array<double>"))
    got = index.search(spark.createDataFrame([rows[3], rows[3]], "id long, v array<double>"), 10).collect()
    assert len(got) == len({r["vec_id"] for r in got}) == 10


def test_unknown_pieces_go_to_the_tokenizer_together():
    from logloom.llm import bpe, tokenfile
    from tokenizers import Tokenizer
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéß漢'.,!\n-1", k=rng.randint(1, 9))) for _ in range(6000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(40)] + [
        "", " ", "  two  spaces ", "a\n b \n", "x<|endoftext|>y <|endoftext|> z", "  n  b", "tail  "]
    encoder = tokenfile._encoder.__wrapped__(bpe.default_tokenizer())
    calls, inner = [], encoder._encode_pieces
    encoder._encode_pieces = lambda pieces: calls.append(len(pieces)) or inner(pieces)
    plain = Tokenizer.from_file(bpe.default_tokenizer())
    for _ in range(2):  # the second time from memory
        ids, sizes = encoder.encode_flat(texts)
        ends = sizes.cumsum()
        got = [ids[e - n:e].tolist() for e, n in zip(ends, sizes, strict=True)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 2 and calls[0] > 3000 and calls[1] < 20


def test_decoding_needs_no_automaton(spark):
    from logloom.llm import bpe
    path = bpe.default_tokenizer()
    assert bpe.token_bytes(path) == bpe.Vocabulary(path).bytes_of
    df = spark.createDataFrame([(1, "ab é"), (2, None), (3, "x" * 50)], "doc_id long, text string")
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {1: "ab é", 2: "", 3: "x" * 50}
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 10, "c"]})
    assert [p.num_rows for p in bpe._parts(batch, pa.array([10, None, 10, 1]), 11)] == [2, 2]
