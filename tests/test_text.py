import json
import re

import pytest
from pyspark.sql import functions as F

from trialyst.functions import jsontext as X
from trialyst.functions import text as T


def _one(spark, text, fn):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(fn(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "code,want",
    [
        ("x = 1  # BUG here\n", "x = 1\n"),
        ("# TODO later\nx = 1", "x = 1"),
        ("\n\n  # wrong\ny", "y"),
        ("a = '#'  # note\nb", "a = '#'  # note\nb"),
        ("a = 1 # fine # should be 2\nb", "a = 1\nb"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("prefix # fixed", "prefix # fixed"),
        ("z = 1 # Fix", "z = 1"),
        ("é = 1 # Off-by one", "é = 1"),
        ("only # off by\n# plain\nq", "only\n# plain\nq"),
    ],
)
def test_scrub(spark, code, want):
    assert _one(spark, code, T.scrub) == want


def test_scrub_is_fast_on_a_long_line(spark):
    long = "word " * 200_000
    assert _one(spark, long + "# BUG", T.scrub) == long.rstrip()


@pytest.mark.parametrize(
    "text,want",
    [
        ("```python\nx\n```", "x"),
        ("```\ny\n``` ```python\nx\n```", "x"),
        ("```\ny\n```", "y"),
        ("  plain \n", "plain"),
        ("```python\n```", ""),
    ],
)
def test_extract_code(spark, text, want):
    assert _one(spark, text, T.extract_code) == want


def test_last_code(spark):
    assert _one(spark, "```python\na\n``` ```python\nb\n```", T.extract_last_code) == "b"
    assert _one(spark, "none", T.extract_last_code) is None


def test_extract_function_survives_long_bodies(spark):
    body = "def f(x):\n" + "    x += 1\n" * 20_000
    assert _one(spark, body + "f(1)\n", lambda c: T.extract_function(c, "f")) == body.rstrip()


@pytest.mark.parametrize("n", [3, 7, 8, 9, 12])
@pytest.mark.parametrize("end", ["", "\n", "\n\n"])
def test_shorten_fences(spark, n, end):
    body = "\n".join(f"l{i}" for i in range(n)) + end
    text = f"a ```html\n{body}``` b"
    kept = "\n".join(body.splitlines()[:8])
    assert _one(spark, text, T.shorten_fences) == f"a ```html\n{kept}\n... [code truncated]\n``` b"


def test_truncate_middle_keeps_the_limit(spark):
    out = _one(spark, "ab" * 500, lambda c: T.truncate_middle(c, 200))
    assert len(out) <= 200 and "[truncated 800 chars]" in out
    assert _one(spark, "x" * 30, lambda c: T.truncate_middle(c, 10)) == "x" * 10


def test_signature_needs_only_visible_characters(spark):
    text = (" \n\t" * 500).join("Ab" for _ in range(150)) + "tail"
    want = " ".join(text.lower().split())[:200]
    assert _one(spark, text, lambda c: T.desc_signature(c, 200)) == want
    assert _one(spark, text, T.desc_signature) == re.sub(r"\s+", " ", text.lower())


def test_title_case_restarts_after_digits(spark):
    assert _one(spark, "3d model o'neil v2x", T.title_case) == "3D Model O'Neil V2X"


@pytest.mark.parametrize("x,want", [(0.125, "12%"), (0.375, "38%"), (1.0, "100%"), (0.0, "0%")])
def test_percent_rounds_half_to_even(spark, x, want):
    assert spark.range(1).select(T.percent(F.lit(x)).alias("v")).first()["v"] == want


@pytest.mark.parametrize(
    "text,parsed,q",
    [
        ('{"quality_score": 0.7}', True, 0.7),
        ('```json\n{"quality_score": 0.7}\n```', True, 0.7),
        ('so {"quality_score": 0.7} ok', True, 0.7),
        ('{"quality_score": 0.7} {"quality_score": 1}', False, 0.5),
        ("nothing", False, 0.5),
        ("} {", False, 0.5),
        ('{"quality_score": "0.25"}', True, 0.25),
    ],
)
def test_parse_judge(spark, text, parsed, q):
    v = _one(spark, text, X.parse_judge)
    assert (v["parsed"], v["quality_score"]) == (parsed, q)


@pytest.mark.parametrize(
    "text,want",
    [
        ('<think>{x}</think> {"a": "}\\"{"} z', '{"a": "}\\"{"}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ("no braces", "no braces"),
        ('pre {"a": {"b"', '{"a": {"b"'),
        ('{"a": 1} {"b": 2}', '{"a": 1}'),
    ],
)
def test_first_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert X.first_json(df, "t", "o").first()["o"] == want


@pytest.mark.parametrize("raw,want", [(r"a\n\\n\"", 'a\n\\n"'), (r"\u0041\uZZZZ.", "A\\uZZZZ."), (r"A\uZZ", "AuZZ"), (r"\d\/", "d/"), ("end\\", "end\\")])
def test_unescape_is_one_pass(spark, raw, want):
    assert X.unescape(spark.createDataFrame([(raw,)], "s string"), "s", "o").first()["o"] == want


def test_unescape_pairs_and_halves(spark):
    df = spark.createDataFrame([(r"\ud83d\ude00\u00e9 \ud83d!",), ("x" * 200_000 + "\\n",), (None,)], "s string")
    got = [r["o"] for r in X.unescape(df, "s", "o").collect()]
    assert got == ["😀é \\ud83d!", "x" * 200_000 + "\n", None]


def test_first_json_of_long_texts(spark):
    text = '{"a": "' + "{\\\"" * 50_000 + '", "b": [' + "{}," * 20_000 + "1]}"
    df = spark.createDataFrame([("x " + text + " y",), (None,)], "t string")
    assert [r["o"] for r in X.first_json(df, "t", "o").collect()] == [text, None]


def test_unclosed_file_and_timeout(spark):
    text = (
        '<tool_call>{"name": "bash", "arguments": {"command": "ls", "timeout": 30, oops}}</tool_call>'
        '<tool_call>{"name": "write_file", "arguments": {"path": "a", "content": "see <tool_call>"}}'
        '<tool_call>{"name": "write_file", "arguments": {"path": "b.py", "content": "print(1)\\nleft open'
    )
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [(r["name"], json.loads(r["arguments"]), r["closed"]) for r in X.open_tool_calls(df, "t").orderBy("pos").collect()]
    assert got == [
        ("bash", {"command": "ls", "timeout": 30}, True),
        ("write_file", {"path": "a", "content": "see <tool_call>"}, False),
        ("write_file", {"path": "b.py", "content": "print(1)\nleft open"}, False),
    ]


def test_lenient_tool_calls(spark):
    good = json.dumps({"name": "execute_code", "arguments": json.dumps({"code": "ok", "test_code": "t"})})
    broken = '{"name": "execute_code", "arguments": {"code": "print("a")\\nx", "test_code": "assert "q""}}'
    text = f"<tool_call>{good}</tool_call> mid <tool_call>\n{broken}\n</tool_call><tool_call>{{oops}}</tool_call>"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    strict = X.tool_calls(df, "t").collect()
    assert [(r["pos"], r["code"], r["test_code"]) for r in strict] == [(0, "ok", "t")]
    got = sorted((r["pos"], r["code"], r["test_code"], r["recovered"]) for r in X.tool_calls(df, "t", lenient=True).collect())
    assert got == [(0, "ok", "t", False), (1, 'print("a")\nx', 'assert "q"', True)]
    assert _one(spark, text, T.strip_tool_calls) == "mid"


def test_open_tool_calls(spark):
    text = 'a <tool_call>{"name": "bash", "arguments": {"command": "</tool_call>"}}</tool_call><tool_call> {"name": "x"'
    df = spark.createDataFrame([(1, text), (2, "none")], "id int, t string")
    got = X.open_tool_calls(df, "t").collect()
    assert [(r["id"], r["name"], json.loads(r["arguments"]), r["closed"]) for r in got] == [(1, "bash", {"command": "</tool_call>"}, True)]


def test_broken_open_calls_are_salvaged(spark):
    text = (
        '<tool_call>{"name": "write_file", "arguments": {"path": "a.py", "content": "print("x")\\n"}}</tool_call>'
        '<tool_call>{"name": "bash", "arguments": {"command": "ls \\"a\\"" oops}}</tool_call>'
        '<tool_call>not json</tool_call><tool_call>{"name": "read_file", "arguments": {"path": "p.png"'
    )
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [(r["name"], json.loads(r["arguments"]), r["closed"]) for r in X.open_tool_calls(df, "t").orderBy("pos").collect()]
    assert got == [
        ("write_file", {"path": "a.py", "content": 'print("x")\n'}, True),
        ("bash", {"command": 'ls "a"'}, True),
        ("read_file", {"path": "p.png"}, False),
    ]


def test_only_the_text_true_is_true(spark):
    from trialyst.operators import normalize as N

    df = spark.createDataFrame([("True", True), ("true", False), ("TRUE", None), ("1", True), (None, True)], "s string, b boolean")
    got = df.select(N.as_bool(df, "s").alias("s"), N.as_bool(df, "b").alias("b")).collect()
    assert [r["s"] for r in got] == [True, False, False, False, False]
    assert [r["b"] for r in got] == [True, False, False, True, True]
