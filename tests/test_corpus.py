import json

import pytest
from pyspark.sql import functions as F

from trialyst.operators import corpus as C
from trialyst.operators import normalize as N


def test_message_length_equals_json_dump(spark):
    rows = [
        [("user", "plain", None, None)],
        [("assistant", 'q"\n\t\\ é € 😀 \x01 /', None, [("bash", '{"a": "ü"}'), ("x", "")])],
        [("tool", None, [("text", "screenshot:", None), ("image", None, "a/ö.png")], None), ("user", "", None, None)],
    ]
    schema = "m array<struct<role:string,content_text:string,content_parts:array<struct<type:string,text:string,image:string>>,tool_calls:array<struct<name:string,arguments:string>>>>"

    def plain(m):
        role, text, parts, calls = m
        content = text if parts is None else [{"type": t, ("text" if t == "text" else "image"): a if t == "text" else b} for t, a, b in parts]
        out = {"role": role, "content": content}
        if calls:
            out["tool_calls"] = [{"type": "function", "function": {"name": n, "arguments": a}} for n, a in calls]
        return out

    want = [len(json.dumps([plain(m) for m in r])) for r in rows]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, " + schema)
    got = [r["n"] for r in df.orderBy("i").select(C.messages_length(F.col("m")).alias("n")).collect()]
    assert got == want


def test_quota_shares(spark):
    rows = [(i, "one_revise") for i in range(90)] + [(i, "two_revise") for i in range(100, 140)] + [(i, "three_revise") for i in range(200, 230)] + [(999, "no_revise")]
    df = spark.createDataFrame(rows, "task_id bigint, stratum string")
    n = {r["stratum"]: r["count"] for r in C.quota_sample(df).groupBy("stratum").count().collect()}
    assert n == {"one_revise": 30, "two_revise": 40, "three_revise": 30}
    again = sorted(C.quota_sample(df.repartition(9)).collect())
    assert again == sorted(C.quota_sample(df.repartition(1)).collect())


def test_quota_shortfall_is_not_refilled(spark):
    df = spark.createDataFrame([(i, "one_revise") for i in range(50)], "task_id bigint, stratum string")
    assert C.quota_sample(df, total=100).count() == 30


def test_assign_strata_is_exact(spark):
    df = spark.range(101).withColumnRenamed("id", "task_id")
    got = C.assign_strata(df, 0.5, 1).groupBy("target").count().collect()
    # round(50.5) is 50: ties go to the even number
    assert {r["target"]: r["count"] for r in got} == {"no_revise": 50, "revise": 51}


def _code_row(spark, passed, fixed, iters):
    res = spark.createDataFrame([("t", passed, fixed, iters, "", "")], "task_id string, ss_passed boolean, rv_passed boolean, rv_iters bigint, ss_final_code string, rv_final_code string")
    tasks = spark.createDataFrame([("t", "Fix\n  ```python\nx = 1\ny\n  ```\nend", "assert x", ["off"])], "task_id string, description string, test_code string, common_bugs array<string>")
    return C.code_traces(res, tasks).first()


@pytest.mark.parametrize(
    "passed,fixed,iters,kinds",
    [
        (True, True, 1, ["generate", "execute", "submit"]),
        (False, True, 2, ["generate", "execute", "review", "revise", "execute", "submit"]),
        (False, False, 1, ["generate", "execute", "submit"]),
        (False, False, 2, ["generate", "execute", "review", "execute", "submit"]),
        (False, False, 9, ["generate", "execute", "review", "execute", "review", "execute", "submit"]),
        (True, False, 1, ["generate", "execute", "submit"]),
    ],
)
def test_code_trace_branches(spark, passed, fixed, iters, kinds):
    t = _code_row(spark, passed, fixed, iters)
    assert [s["step_type"] for s in t["steps"]] == kinds
    assert t["final_reward"] == (1.0 if fixed else 0.0)
    code = "# Fixed version addressing: off\nx = 1\ny" if passed else "x = 1\ny"
    assert t["steps"][0]["output_text"] == f"[GENERATE]:\n```python\n{code}\n```"
    assert t["steps"][-1]["reward"] == (1.0 if passed or fixed else 0.0)


def test_scrub_gate_stops_the_job(spark):
    df = spark.createDataFrame([("a", False, True), ("b", True, True)], "task_id string, buggy_passed boolean, fixed_passed boolean")
    assert N.assert_scrub(df.filter("task_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="scrub broke task b"):
        N.assert_scrub(df).collect()


def test_gate_reports_the_first_broken_rule(spark):
    rows = [("a", 30, False, "x", False), ("b", 3, False, "x", False), ("c", 3, True, "final", False), ("d", 3, True, "final", True)]
    df = spark.createDataFrame(rows, "task_id string, n_steps int, k boolean, status string, buildable boolean").select(
        "*", F.lit("web").alias("category"), F.lit(False).alias("final_passed"), F.struct(F.col("k").alias("keep")).alias("judge"),
        F.array(C._message("assistant", F.lit("x" * 100))).alias("messages"),
    )
    got = {r["task_id"]: r["reject_reason"] for r in C.gate_traces(df, max_steps=20, max_chars=50, judge_keep=True, final_passed=True).collect()}
    assert got == {"a": "steps", "b": "judge", "c": "missing_image", "d": "too_long"}
    # without given limits no length is a reason
    assert {r["task_id"]: r["reject_reason"] for r in C.gate_traces(df).collect()} == {"a": "missing_image", "b": "missing_image", "c": "missing_image", "d": None}
