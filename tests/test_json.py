"""JSON of any depth, with repeated keys and numbers as written, against the standard library."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions.sqltext import last_wins_map
from logloom.operators import fingerprint as fp
from logloom.operators import tokenizers as tk

DEEP = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":1,"i":"x"}}}}}}},"z":[1, {"q":[2.50]}],"e":{},"n":null}'
GOOD = [
    DEEP, '{"a":[{"z":1,"b":"x"},"\\u00e9"],"c":[3]}', '{"a":1.0,"b":1e5,"c":123456789012345678901234567890123456789012,"d":-0.50,"e":"1.0"}', '{"a":{"x":1,"y":{"z":2}},"b":3,"a":{"w":4}}',
    '{"a":1,"a":{"b":{"c":2.0}}}', '{"a":{"b":1},"a":2.0}', '{"a.b":1.5,"a":{"b":2}}', '{"a":{"b":2},"a.b":1.5}', '{}', ' noise {"k":"v"} ',
    '{"q":"br{ce } \\" [ : , \\\\","u":"\\u00e9\\ud83d\\ude00\\n","f":1.5}', '{"k":{"k":{"k":{"k":{"k":{"k":{"k":{"k":{}}}}}}}},"t":true,"s":""}',
    '{"a":[],"b":[[],{}],"c":[{"a":{"b":1}}],"d":1.0}', '{"a":1,"b":{"c":"d"}}', '{"é":{"ü":1.0}, "x" : { "y" : false } }', '{"":1.5,"a":{"":2}}',
    json.dumps({f"k{i}": {"v": i / 2, "w": "x" * (i % 7)} for i in range(1500)}),
]
BAD = ["", None, "no brace", '{"a":1', '{"a":1} tail', '[{"a":1}]x', '{"a":1.0,}', '{"a":tru,"b":1.0}', '{"a":1.0}{"b":2}', '{a:1.0}']


def _flat(d, prefix=""):
    out = {}
    for k, v in d.items():
        key = f"{prefix}.{k}" if prefix else k
        if isinstance(v, dict) and v:
            out.update(_flat(v, key))
        else:
            out[key] = v
    return out


class Number(str):
    pass


def _text(v):
    if v is None or isinstance(v, str):
        return None if v is None else str(v)
    if isinstance(v, bool):
        return "true" if v else "false"

    def spell(x):
        if isinstance(x, Number):
            return str(x)
        if isinstance(x, list):
            return "[" + ",".join(map(spell, x)) + "]"
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k)}:{spell(y)}" for k, y in x.items()) + "}"
        return json.dumps(x)
    return spell(v)  # arrays as they were sent, without blanks


def _want(text):
    d = json.loads(text[text.index("{"):], parse_float=Number, parse_int=Number)
    flat = {k: _text(v) for k, v in _flat(d).items()}
    return flat | {k: _text(v) for k, v in d.items() if not (isinstance(v, dict) and v)}


def test_tokens_equal_the_standard_library(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*GOOD, *BAD])], "n INT, payload STRING")
    got = {r["n"]: r["tokens"] for r in tk.tokenize_json(df).collect()}
    for i, t in enumerate(GOOD):
        assert got[i] == _want(t), t[:80]
    assert [got[len(GOOD) + i] for i in range(len(BAD))] == [None] * len(BAD)


def test_both_ways_give_the_same_entries(spark):
    plain = ['{"a":1,"b":{"c":"d","e":{"f":[1,2,"x y"]}},"t":true,"n":null,"x":{}}', '{"a.b":1,"a":{"b":2,"c":3}}', '{"s":"{\\"x\\":1}"}', "{}"]
    df = spark.createDataFrame([(t,) for t in plain], "t STRING")
    a, b = tk.json_entries(tk.json_variant("t"), "t"), tk.json_walk("t")
    both = df.selectExpr("t", f"{a} AS a", f"{b} AS b")
    for r in both.selectExpr("t", f"{last_wins_map('a')} AS a", f"{last_wins_map('b')} AS b").collect():
        assert r["a"] == r["b"], r["t"]


@pytest.mark.parametrize("key, value, hits", [("a.b.c.d.e.f.g.i", "x", [0]), ("a.y", None, []), ("a.w", "4", [3]), ("a", None, [0, 1, 2, 3, 4, 5, 6, 7, 12, 13]), ("a.b.c", None, [0, 4])])
def test_fingerprints_see_every_depth_and_repeated_keys(spark, key, value, hits):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(GOOD[:15])], "n INT, text STRING")
    got = sorted(r["n"] for r in df.filter(fp.fp_json_key(key, value)).select("n").collect())
    assert got == hits


def test_plain_arrays_and_empty_objects_are_not_walked(spark):
    """Both ways give the same entries; a text that needs no walk takes none, whatever follows its arrays."""
    import re
    plain = ['{"l":[1,2],"o":{}}', '{"l":["a{b","]"],"o":{"x":1}}', '{"l":[],"m":[true,null],"s":"\\\\n{"}', '{"t":"[x] {y}","o":{"p":{}}}']
    odd = ['{"l":[[1],{"b":1,"a":2}]}', '{"l":[1,"\\u00e9"]}', '{"l":["]",{"z":1,"a":2}]}', '{"l":[1,[2,{"z":1}]]}', '{"x":"[","l":["]",[{"b":1,"a":2}]]}',
           '{"l":[1,2],"m":[{"b":1,"a":2}]}', '{"l":["a]","b\\"c]",{"z":1,"a":0}]}']
    # Python and Java read this pattern alike
    assert [bool(re.search(tk._OTHER_SPELLING, t)) for t in plain + odd] == [False] * len(plain) + [True] * len(odd)
    nested = '{"p":{"q":{"r":{"s":7}}},"a":{"b":"n"},"l":[1,2],"o":{},"e":{"f":{}}}'  # more braces than JSON_DEPTH, fewer objects with members
    texts = plain + odd + [nested]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = {r["i"]: r["tokens"] for r in tk.tokenize_json(df).collect()}
    staged = df.selectExpr("i", f"{tk.json_walk('payload')} AS w").selectExpr("i", f"{last_wins_map('w')} AS tokens")
    assert got == {r["i"]: r["tokens"] for r in staged.collect()} and all(got.values())
