"""Figures that grow with a group's size or with the lines."""

import numpy as np
import pyarrow as pa

from .test_operators import _shingles


def test_links_of_a_group_are_counted_block_against_block(spark, monkeypatch):
    from logloom.llm import ngram_join
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(60):  # near copies of one text: some link, some only through others
        words = list(base)
        for at in rng.choice(130, rng.integers(1, 3), replace=False):
            words[at] = f"new{i}at{at}"
        rows.append((i, " ".join(words)))
    sets = {i: frozenset(_shingles(t, 4)) for i, t in rows}
    linked = lambda x, y: x != y and 100 * len(x & y) >= 85 * len(x | y)
    want = {i: sum(linked(x, y) for y in set(sets.values())) for i, x in sets.items()}
    join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = join.run(links=True)
    assert {r["doc_id"]: r["links"] for r in got.collect()} == want and max(want.values()) > 10
    # no join makes pairs: a class leaves once for each block of its component
    blocks = join._blocks(join._joined()[1])
    n = blocks.select("root", "i").distinct().count()
    assert n > 3 and blocks.count() <= len(set(sets.values())) * n
    assert join.links().count() * 2 == sum({sets[i]: n for i, n in want.items()}.values())


def test_linked_counts_long_sets_exactly(monkeypatch):
    from logloom.llm import ngram_join
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(200, rng.integers(100, 190), replace=False)) for _ in range(30)]
    for b in (np.zeros(30, int), np.arange(30) % 2 + 3):
        table = pa.table({"class": np.arange(30) * 7, "b": b, "i": np.full(30, b.min()), "j": np.full(30, b.max()), "set": [x.tolist() for x in sets]})
        names, ends = ngram_join._linked(table, 60)
        got = {tuple(sorted((x, y))) for x, y in zip(*ends, strict=True)}
        want = {(x, y) for x in range(30) for y in range(x) if (b[x] != b[y]) or b.min() == b.max()}
        want = {(y, x) for x, y in want if 100 * len(np.intersect1d(sets[x], sets[y])) >= 60 * len(np.union1d(sets[x], sets[y]))}
        assert got == want and want and len(ends[0]) == len(want) and names.tolist() == [7 * i for i in range(30)]


def test_words_are_chosen_as_by_single_steps():
    from logloom.llm import tokenfile
    rng = np.random.default_rng(2)
    for n in (1, 2, 15, 16, 17, 240, 241, 5000):
        ids = (rng.integers(0, 2, n) * rng.integers(0, 1 << 20, n)).astype(np.uint64)
        following = np.minimum(np.arange(n) + rng.integers(1, 241, n), n)
        want, i = [], 0
        while i < n:
            want.append(i)
            i = following[i]
        assert tokenfile._starts(np.append(following, n)).tolist() == want
        assert (tokenfile.unpack(*tokenfile.pack(ids), n) == ids).all()
    assert not len(tokenfile._starts(np.zeros(1, np.int64)))
    edge = np.array([0, 1, 2, 65535, 65536, (1 << 60) - 1], np.uint64)
    assert (tokenfile.unpack(*tokenfile.pack(edge), 6) == edge).all() and (tokenfile.unpack(*tokenfile.pack(edge[:4]), 4) == edge[:4]).all()


def test_a_reused_worker_keeps_no_vocabulary_of_other_operators():
    from logloom.llm import bpe, common, tokenfile
    path = bpe.default_tokenizer()
    want = [bpe._encoder(path).encode(["some words, again"]), tokenfile._encoder(path).encode(["some words, again"])]
    common.release()
    assert not any(f.cache_info().currsize for f in (bpe._encoder, bpe._vocabulary, bpe.token_bytes, tokenfile._encoder))
    assert want == [bpe._encoder(path).encode(["some words, again"]), tokenfile._encoder(path).encode(["some words, again"])]


def test_training_holds_narrow_rows():
    from logloom.llm import langid
    found, counts = langid._counted(b"abcabc abc")
    assert found.itemsize + counts.itemsize <= 6 and counts.sum() == 10 + 9 + 8 + 7
    at, x = langid._vector((found, counts), np.ones(langid.DIM))
    assert at.dtype == np.int64 and np.isclose(x.sum(), langid.SCALE)
    assert [len(v) for v in langid._vector(langid._counted(b""), np.ones(langid.DIM))] == [0, 0]
