"""Repair of JSON: cases, cuts at every length, and random texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.json_repair import repair_json

CASES = {
    '{"a": 1}': {"a": 1}, "so:\n```json\n[{'a': [1, 2,],}]\n``` done": [{"a": [1, 2]}], '{"a": {"b": {"c": [1,': {"a": {"b": {"c": [1]}}},
    '{"a":': {"a": ""}, '{"a":,"b":2}': {"a": "", "b": 2}, '{"a": 1, "b': {"a": 1, "b": ""}, '{"a" "b" "c": 1}': {"a": "b", "c": 1}, '{"a": tru': {"a": "tru"},
    "{'a': 'it\\'s', b: True, c: None, d: it's}": {"a": "it's", "b": True, "c": None, "d": "it's"}, '{"a": "x\ny\tz\x01", "b": "he said "hi" to"}': {"a": "x\ny\tz ", "b": 'he said "hi" to'},
    '{"a": [1, 2}': {"a": [1, 2]}, "[[1,[2": [[1, [2]]], '{"a": "x,}"}': {"a": "x,}"}, '{"u": "\\u12': {"u": ""}, '{"s": "abc\\': {"s": "abc"}, '{"q": "a\\"b"': {"q": 'a"b'}, '{"q": "a\\\\"}': {"q": "a\\"},
    "{a: http://x.y/z?q=1, b: 007, c: 1., d: -3e5, e f: g h}": {"a": "http://x.y/z?q=1", "b": "007", "c": 1, "d": -3e5, "e f": "g h"}, '{"a": "\\x \\u00e9"}': {"a": "\\x é"},
    "{}}{": {}, '{,,"a":1,,}': {"a": 1}, '// c\n{"a": 1 /* x */, // y\n "b": 2}': {"a": 1, "b": 2}, '{"a": “smart” , "k" : \'v\'}': {"a": "smart", "k": "v"}, "[,1]": [1], '{"a": 1} {"b": 2}': {"a": 1}, '[":"]': [":"], '{"a": ]1}': {"a": 1},
    "": None, "no": None,
}
PIECES = ["{", "}", "[", "]", ":", ",", '"', "'", "\\", " ", "\n", "a", "b1", "1", "-2.5e3", "true", "None", "/", "//", "/*", "*/", "“", "”", "\t", "\x01", "é", "u00", "`", '"a": ', '"k"', "'x y'"]


def repaired(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.orderBy("i").select(repair_json(F.col("t")).alias("x")).collect()]


def test_cases(spark):
    for (text, want), got in zip(CASES.items(), repaired(spark, CASES)):
        assert (None if got is None else json.loads(got)) == want, text
    assert repaired(spark, [None]) == [None]


def value(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind >= 5:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {f"k{i}" * (i + 1): value(rng, depth - 1) for i in range(rng.randrange(4))}
    return [rng.randrange(-99, 99), rng.random() * 1e5, rng.choice([True, False, None]), "".join(rng.choice('ab ,:{}[]"\\\n\té/') for _ in range(rng.randrange(9))), "word"][kind]


def prefix_of(got, whole):
    """Whether got is what is left of whole when its text is cut off somewhere."""
    if isinstance(got, dict) and isinstance(whole, dict):
        keys, names = list(got), list(whole)
        *own, last = keys or [None]
        if not keys:
            return True
        return own == names[: len(own)] and len(keys) <= len(names) and names[len(own)].startswith(last) and all(got[k] == whole[k] for k in own) and (got[last] == "" or last in whole and prefix_of(got[last], whole[last]))
    if isinstance(got, list) and isinstance(whole, list):
        return len(got) <= len(whole) and got[:-1] == whole[: max(0, len(got) - 1)] and (not got or prefix_of(got[-1], whole[len(got) - 1]))
    text = json.dumps(whole)
    return got == whole or isinstance(got, str) and (isinstance(whole, str) and whole.startswith(got) or text.startswith(got)) or isinstance(got, int | float) and text.startswith(json.dumps(got).removesuffix(".0"))


def test_cuts_at_every_length(spark):
    rng = random.Random(1)
    wholes = [v for v in (value(rng, 4) for _ in range(60)) if isinstance(v, dict | list)]
    cuts = [(w, json.dumps(w)[:n]) for w in wholes for n in range(1, len(json.dumps(w)) + 1)]
    out = repaired(spark, [t for _, t in cuts])
    for (whole, text), got in zip(cuts, out):
        found = json.loads(got)
        assert found == whole if text == json.dumps(whole) else type(found) is type(whole) and prefix_of(found, whole), (text, got)


def test_anything_becomes_json(spark):
    rng = random.Random(2)
    texts = [rng.choice("{[") + "".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(5000)]
    for text, got in zip(texts, repaired(spark, texts)):
        json.loads(got, parse_constant=lambda c: pytest.fail(f"{c} in {text}"))


def test_long_texts(spark):
    long = {"x": "y \\ \" z" * 30_000, "z": list(range(20_000)), "d": [[]] * 200}
    whole, cut = repaired(spark, [json.dumps(long), json.dumps(long)[:-700]])
    assert json.loads(whole) == long and json.loads(cut)["z"] == long["z"]
    assert json.loads(repaired(spark, ["{" + "a: b, " * 5000])[0]) == {"a": "b"}
    assert json.loads(repaired(spark, ["[" * 500])[0]) is not None


def test_a_column_beside_it_may_bear_the_name_of_one_that_it_reads(spark):
    df = spark.createDataFrame([('{"a": [1', 8), ('{"a": [1', 5)], "t string, n int")
    out = df.select(F.lit("other").alias("t"), F.lit(1).alias("n"), repair_json(F.left("t", F.col("n"))).alias("x"))
    assert [r.x for r in out.collect()] == ['{"a":[1]}', '{"a":""}']
