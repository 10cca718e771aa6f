"""The join's links against brute force: inside components none is left out and none counts twice."""

import numpy as np

from logloom.llm import ngram_join

from .test_operators import WORDS, _shingles


def test_every_link_between_different_sets_is_counted(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(3):  # groups of near copies: most of their pairs link
        base = [f"g{g}w{x}" for x in range(70)] + list(rng.choice(WORDS, 10))
        for c in range(9):
            rows.append((len(rows), " ".join([*base[:c * 8], f"new{c}", *base[c * 8 + 1:]])))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, "one two")]
    sets = {i: frozenset(_shingles(t, 4)) for i, t in rows}
    linked = lambda x, y: bool(x and y) and x != y and 100 * len(x & y) >= 85 * len(x | y)
    want = {i: sum(linked(x, y) for y in set(sets.values())) for i, x in sets.items()}
    join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in join.run(links=True).collect()}
    assert {i: r["links"] for i, r in got.items()} == want and max(want.values()) > 4
    for i in got:
        assert (got[i]["class"] is None) == (not sets[i])
        assert all((got[i]["class"] == got[j]["class"]) == (sets[i] == sets[j]) for j in got)
    pairs = [tuple(r) for r in join.links().collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    distinct = sorted(set(sets.values()), key=sorted)
    assert len(pairs) == sum(linked(x, y) for n, x in enumerate(distinct) for y in distinct[:n])
