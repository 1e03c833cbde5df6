import json

import pytest
from pyspark.sql import functions as F

from trialyst.operators import normalize as N
from trialyst.operators import raters as M
from trialyst.operators.rank import dedupe_runs
from trialyst.operators.summary import category_summary
from trialyst.plans import catalog, files  # noqa: F401  (the catalog loads the plans in order)
from trialyst.sources import readers as I
from trialyst.sources import writers as O
from trialyst.streaming import live


def _put(folder, name, data):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(p)


def test_bundles(spark, tmp_path):
    _put(tmp_path, "a/one.json", {"results": [{"problem_id": "p", "baseline": "B", "passed": True, "tokens": 5}, {"problem_id": "q", "baseline": "B"}], "summary": {}})
    _put(tmp_path, "summary.json", {"results": [{"problem_id": "z"}]})
    _put(tmp_path, "b/bad.json", '{"results": [')
    rows = {r["problem_id"]: r for r in I.read_bundles(spark, str(tmp_path)).collect()}
    assert set(rows) == {"p", "q"}
    assert rows["p"]["source_file"] == "a/one.json" and rows["p"]["total_tokens"] == 5
    assert rows["q"]["passed"] is False


def test_runs_skip_what_is_no_list(spark, tmp_path):
    a = _put(tmp_path, "x_run2.json", [{"task_id": "t", "ss_meets": "True"}, {"task_id": "u", "run": 7}])
    b = _put(tmp_path, "y_run3.json", {"task_id": "no"})
    c = _put(tmp_path, "z_run4.json", "[{")
    rows = I.read_runs(spark, [a, b, c, str(tmp_path / "absent.json")]).orderBy("pos").collect()
    assert [(r["task_id"], r["run"], r["pos"]) for r in rows] == [("t", 2, 0), ("u", 7, 1)]
    assert I.read_runs(spark, [str(tmp_path / "none*.json")]).count() == 0


def test_rejects_say_why(spark, tmp_path):
    files = {"a.json": "[{}]", "b.json": "[{", "c.json": '{"results": [1]}', "d.json": " \n", "e.json": '{"results": 3}'}
    for name, text in files.items():
        _put(tmp_path, name, text)
    said = lambda shape: {r["file"]: r["reason"] for r in I.read_rejects(spark, [f"{tmp_path}/*.json"], shape).collect()}
    assert said("list") == {"b.json": "not JSON", "c.json": "not a list", "d.json": "empty", "e.json": "not a list"}
    assert said("bundle") == {"a.json": "no list of results", "b.json": "not JSON", "d.json": "empty", "e.json": "no list of results"}
    assert I.read_rejects(spark, [f"{tmp_path}/none*.json"]).count() == 0


def test_grid(spark, tmp_path):
    p = _put(tmp_path, "s1.json", {"H": {"1000": {"t1": {"passed": True, "tokens_used": 9}, "t2": {}}}, "L": {}})
    rows = I.read_grid(spark, {1: p, 2: str(tmp_path / "no.json")}).orderBy("task_id").collect()
    assert [(r["seed"], r["strategy"], r["budget"], r["task_id"], r["passed"], r["tokens_used"]) for r in rows] == [
        (1, "H", 1000, "t1", True, 9), (1, "H", 1000, "t2", False, 0)]


def test_task_files_come_in_three_shapes(spark, tmp_path):
    t = lambda i: {"task_id": i, "requirements": ["r"]}
    ps = [_put(tmp_path, "a.json", [t("a")]), _put(tmp_path, "b.json", {"v": 1, "tasks": [t("b")]}), _put(tmp_path, "c.json", {"suite": [t("c")]})]
    assert sorted(r["task_id"] for r in I.read_tasks(spark, ps).collect()) == ["a", "b", "c"]


def test_metrics_import_counts_samples_again(spark, tmp_path):
    p = _put(tmp_path, "m.json", {"B": {"p": {"n_samples": 99, "results": [{"passed": True, "tokens": 3}, {}]}}})
    rows = I.import_metrics(spark, p).collect()
    assert len(rows) == 2 and sum(r["total_tokens"] for r in rows) == 3


def test_votes_and_agreement(spark, tmp_path):
    head = "rater_id,pair_id,modality,choice,rt_ms,ts\n"
    a = _put(tmp_path, "r1.csv", head + "r1,p1,web,A,10,2026-01-01T00:00:00Z\nr1,p1,web,B,10,2026-01-02T00:00:00Z\n")
    b = _put(tmp_path, "r2.csv", head + "r2,p1,web,B,10,2026-01-01T00:00:00Z\nr3,p1,web,same,9,2026-01-01T00:00:00Z\n")
    v = I.read_votes(spark, [a, b, str(tmp_path / "r9.csv")])
    r = M.rater_agreement(v, "ts").first()
    assert (r["n_pairs"], r["agree"], r["total"]) == (1, 1, 3)


def test_preference_strict_leaves_out_all_same_modalities(spark):
    key = spark.createDataFrame([("p1", "web", "rv", "ss", True), ("p2", "fig", "ss", "rv", True)], "pair_id string, modality string, A_condition string, B_condition string, decisive boolean")
    votes = spark.createDataFrame([("r", "p1", "A"), ("r", "p2", "same"), ("r", "p9", "A")], "rater_id string, pair_id string, choice string")
    j = M.judge_votes(votes, key)
    assert {r["modality"]: (r["rv"], r["same"]) for r in M.preference(j).collect()} == {"web": (1, 0), "OVERALL": (1, 0)}
    assert {r["modality"]: (r["a"], r["b"], r["same"]) for r in M.tie_control(j).collect()} == {"web": (0, 0, 0), "OVERALL": (0, 0, 0)}


def test_golden_code_suite(spark, tmp_path):
    # 15 tasks under the old key names: 10 pass at first, all after review
    failed_first = {1, 3, 8, 11, 13}
    recs = [{"task_id": f"code_{i:03d}", "single_shot_passed": i not in failed_first, "reviewed_passed": True} for i in range(1, 16)]
    p = _put(tmp_path, "code_swe_results.json", recs)
    df = N.with_metric_flag(N.normalize_pairs(N.with_category(I.read_runs(spark, [p]).drop("category"))))
    r = category_summary(dedupe_runs(df)).first()
    assert (r["category"], r["metric"], r["n"], r["fixed"]) == ("code_swe", "pass_rate", 15, 5)
    assert (r["ss_value"], r["rv_value"]) == (pytest.approx(10 / 15), 1.0)


def test_golden_animation_suite(spark, tmp_path):
    ss, rv = [0.3, 0.75, 0.0, 0.0, 0.3, 0.1, 0.7, 0.2], [0.3, 0.75, 0.0, 0.6, 0.3, 0.1, 0.7, 0.2]
    recs = [{"task_id": f"anim_{i + 1:03d}", "single_shot_quality": a, "reviewed_quality": b} for i, (a, b) in enumerate(zip(ss, rv))]
    probe = _put(tmp_path, "anim_fix_verify.json", [{"task_id": "anim_007"}, {"task_id": "anim_009"}])
    p = _put(tmp_path, "animation_results.json", recs)
    df = N.with_metric_flag(N.normalize_pairs(N.with_category(I.read_runs(spark, [probe, p]).drop("category"))))
    kept = dedupe_runs(df)
    assert kept.count() == 9 and kept.filter("task_id = 'anim_007' AND has_metric").count() == 1
    r = category_summary(kept).first()
    assert (r["metric"], r["n"]) == ("quality", 8)
    assert (round(r["ss_value"], 3), round(r["rv_value"], 3)) == (0.294, 0.369)


def test_collect_all_families(spark, tmp_path):
    _put(tmp_path, "t/slides/slide_tasks.json", [{"task_id": "slide_1", "description": "d", "requirements": ["r"], "expected_issues": []}])
    _put(tmp_path, "t/code/code_tasks.json", [{"task_id": "code_1", "description": "d", "test_code": "t", "common_bugs": []}])
    _put(tmp_path, "r/slide_results.json", [{"task_id": "slide_1", "single_shot_quality": 0.5, "reviewed_quality": 0.9, "reviewed_iters": 2}])
    _put(tmp_path, "r/slides_results_run1.json", [{"task_id": "slide_1", "ss_quality": 0.5, "rv_quality": None}])
    _put(tmp_path, "r/code_onpolicy_run1.json", [{"task_id": "code_1", "ss_quality": 1.0, "rv_quality": 1.0, "ss_final_code": "go()"}])
    rows = I.collect_all(spark, str(tmp_path / "r"), str(tmp_path / "t")).collect()
    got = {(r["task_type"], r["task_id"]): r for r in rows}
    assert set(got) == {("slide", "slide_1"), ("code", "code_1")}
    assert len(got[("slide", "slide_1")]["steps"]) == 6 and "go()" in got[("code", "code_1")]["steps"][0]["output_text"]


def test_lists_are_written_compressed_and_read_whole(spark, tmp_path):
    """Lists of records repeat their field names; what goes to the disk is a small part of that."""
    rec = F.struct(F.col("id").cast("string").alias("task_id"), (F.col("id") % 7).alias("ss_n_defects"), F.lit(True).alias("ss_passed"))
    lists = spark.range(20000).groupBy((F.col("id") % 2).alias("c")).agg(F.to_json(F.collect_list(rec)).alias("value"))
    path = files._one_file_each(lists.select("value"), str(tmp_path / "lists"))
    back = I.read_runs(spark, [path])
    assert (back.count(), back.agg(F.sum("ss_n_defects")).first()[0], back.select("file").distinct().count()) == (20000, 59997, 2)
    written = sum(f.stat().st_size for f in (tmp_path / "lists").glob("part-*"))
    assert written * 5 < lists.agg(F.sum(F.length("value"))).first()[0]


def test_markdown_starts_with_its_header(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    O.write_summary(df, str(tmp_path / "md"), "markdown")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines == ["| k | n |", "|---|---|", "| a | 1 |", "| b | 2 |"]


# --- streams -----------------------------------------------------------------


def test_first_wins_over_restarts(spark, tmp_path):
    schema = "run bigint, task string, v bigint"
    store, mark = str(tmp_path / "store"), str(tmp_path / "mark")

    def go():
        s = live.stream_trials(spark, str(tmp_path / "in"), schema)
        live.ingest_first(s, ["run", "task"], ["v"], store, mark).awaitTermination()
        return sorted((r["run"], r["task"], r["v"]) for r in live.read_first(spark, store).collect())

    _put(tmp_path, "in/a.json", '{"run":1,"task":"t","v":5}\n{"run":1,"task":"t","v":4}')
    assert go() == [(1, "t", 4)]
    _put(tmp_path, "in/b.json", '{"run":1,"task":"t","v":1}\n{"run":2,"task":"t","v":9}')
    assert go() == [(1, "t", 4), (2, "t", 9)]
    assert go() == [(1, "t", 4), (2, "t", 9)]
