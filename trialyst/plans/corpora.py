"""Registered corpus queries. Nested results are flattened to rows, long texts
to digests, so that they compare in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialyst.functions import phrases as P

from trialyst.operators import corpus as C
from trialyst.operators import normalize as N
from trialyst.operators import reports as R
from trialyst.operators.rank import with_stratum
from trialyst.operators.summary import dialect_share
from trialyst.plans import fixtures as fx
from trialyst.plans.registry import query
from trialyst.plans.texts import _strip


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _hash(*parts: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def _pick(values: list[str], *parts: str) -> str:
    return f"({_sql_list(values)})[{_hash(*parts)} % {len(values)} + 1]"


# --- review traces: documents as drafts with 0..3 attempts -------------------

REVIEW = """rt AS (SELECT doc_id AS task_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS bug_class, concat('Fix ', source) AS description,
      concat('assert f() == ', CAST(doc_id AS VARCHAR)) AS test_code, text AS draft_code, doc_id % 4 AS n_att, doc_id % 4 > 0 AND doc_id % 11 = 0 AS lost,
      CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN repeat('x', 301) ELSE ' check it ' END AS before_exec,
      CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE '  ' END AS confirm FROM documents)"""


def review_traces(spark, sf):
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    ok = F.struct(F.lit(True).alias("passed"), none.alias("error"), F.lit("fine").alias("stdout"), none.alias("stderr"))
    bad = F.struct(F.lit(False).alias("passed"), F.lit("E").alias("error"), F.lit("").alias("stdout"), F.col("text").alias("stderr"))
    n = (i % 4).cast("int")
    lost = (n > 0) & (i % 11 == 0)

    def attempt(k):
        return F.struct(
            F.concat(F.lit(" diag "), k.cast("string")).alias("diagnosis"), F.when(k % 2 == 0, " ").otherwise("Now:").alias("revision_preamble"),
            F.concat(F.lit("v"), k.cast("string"), F.lit("\n")).alias("code"), F.when((k == n) & ~lost, ok).otherwise(bad).alias("exec"),
        )

    attempts = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), attempt)).otherwise(F.transform(F.array().cast("array<int>"), attempt))
    return fx.table(spark, sf, "documents").select(
        i.alias("task_id"), F.when(i % 3 != 0, F.col("lang")).alias("bug_class"), F.concat(F.lit("Fix "), "source").alias("description"),
        F.concat(F.lit("assert f() == "), i.cast("string")).alias("test_code"), F.col("text").alias("draft_code"),
        F.when(n == 0, ok).otherwise(bad).alias("draft_exec"), attempts.alias("attempts"),
        F.lit("v1\n").alias("fixed_code"), ok.alias("fixed_exec"),
        F.struct(
            F.lit(" I start. ").alias("preamble"),
            F.when(i % 5 == 0, "").when(i % 5 == 1, F.lit("x" * 301)).otherwise(" check it ").alias("before_exec"),
            F.when(i % 2 == 0, "done").otherwise("  ").alias("confirm"), F.lit(" it broke ").alias("diagnosis"), F.lit("").alias("revision_preamble"),
        ).alias("voice"),
    )


_STRATUM = "CASE n_att WHEN 0 THEN 'no_revise' WHEN 1 THEN 'one_revise' WHEN 2 THEN 'two_revise' ELSE 'three_revise' END"


@query("with_stratum", f"WITH {REVIEW} SELECT task_id, {_STRATUM} AS stratum FROM rt WHERE NOT lost")
def _(spark, sf):
    return with_stratum(review_traces(spark, sf)).select("task_id", "stratum")


def _flat(examples, *extra):
    """Messages as rows: position, role, digest of the text, tool arguments."""
    m = examples.select(*extra, F.posexplode("messages").alias("pos", "m"))
    parts = F.transform("m.content_parts", lambda p: F.coalesce(p["text"], p["image"]))
    return m.select(
        *extra, F.col("pos").cast("bigint").alias("pos"), F.col("m.role").alias("role"),
        F.md5(F.coalesce(F.col("m.content_text"), F.array_join(parts, "|"))).alias("content"),
        F.size(F.coalesce(F.col("m.tool_calls"), F.array().cast("array<struct<name:string,arguments:string>>"))).cast("bigint").alias("n_calls"),
    )


def _stitch_sql(version: int) -> str:
    verify, confirm = (P.VERIFY_V1, P.CONFIRM_V1) if version == 1 else (P.VERIFY_V3, P.CONFIRM_V3)
    tid = "CAST(task_id AS VARCHAR)"
    nl2 = "chr(10), chr(10)"
    lead = f"CASE WHEN before_exec IN ('', repeat('x', 301)) THEN {_pick(verify, chr(39) + '5' + chr(39), tid, chr(39) + 'verify' + chr(39))} ELSE 'check it' END"
    draft = f"concat('I start.', {nl2}, '```python', chr(10), {_strip('draft_code')}, chr(10), '```', {nl2}, {lead})"
    ok = """'{"passed":true,"error":null,"stdout":"fine","stderr":""}'"""
    esc = "CAST(to_json(draft_code) AS VARCHAR)"
    bad = f"""concat('{{"passed":false,"error":"E","stdout":"","stderr":', {esc}, '}}')"""
    last = f"CASE WHEN confirm = 'done' THEN 'done' ELSE {_pick(confirm, chr(39) + '5' + chr(39), tid, chr(39) + 'confirm' + chr(39))} END"
    head = f"""SELECT task_id, 0 AS pos, 'user' AS role, description AS t, 0 AS n_calls FROM s UNION ALL SELECT task_id, 1, 'assistant', {draft}, 1 FROM s
      UNION ALL SELECT task_id, 2, 'tool', CASE WHEN n_att = 0 THEN {ok} ELSE {bad} END, 0 FROM s"""
    if version == 1:
        fix = f"concat('it broke', {nl2}, {_pick(P.FAIL_TO_FIX, chr(39) + '5' + chr(39), tid, chr(39) + 'fix' + chr(39))}, {nl2}, 'Here is the fix:', {nl2}, '```python', chr(10), 'v1', chr(10), '```', {nl2}, {_pick(P.VERIFY_FIX_V1, chr(39) + '5' + chr(39), tid, chr(39) + 'verify_fix' + chr(39))})"
        mid = f"SELECT task_id, 3, 'assistant', {fix}, 1 FROM s WHERE n_att > 0 UNION ALL SELECT task_id, 4, 'tool', {ok}, 0 FROM s WHERE n_att > 0"
        end = f"SELECT task_id, CASE WHEN n_att > 0 THEN 5 ELSE 3 END, 'assistant', {last}, 0 FROM s"
        att = ""
    else:
        att = ", a AS (SELECT *, unnest(generate_series(1, n_att)) AS k FROM s)"
        no = "CAST(k - 1 AS VARCHAR)"
        retry = f"CASE WHEN k > 1 THEN concat({_pick(P.RETRY, chr(39) + '5' + chr(39), tid, chr(39) + 'retry' + chr(39), no)}, {nl2}) ELSE '' END"
        fix = f"concat({retry}, 'diag ', CAST(k AS VARCHAR), {nl2}, CASE WHEN k % 2 = 0 THEN 'Here is the fix:' ELSE 'Now:' END, {nl2}, '```python', chr(10), 'v', CAST(k AS VARCHAR), chr(10), '```', {nl2}, {_pick(P.VERIFY_FIX_V3, chr(39) + '5' + chr(39), tid, chr(39) + 'verify_fix' + chr(39), no)})"
        mid = f"SELECT task_id, 1 + 2 * k, 'assistant', {fix}, 1 FROM a UNION ALL SELECT task_id, 2 + 2 * k, 'tool', CASE WHEN k = n_att THEN {ok} ELSE {bad} END, 0 FROM a"
        end = f"SELECT task_id, 3 + 2 * n_att, 'assistant', {last}, 0 FROM s"
    return f"""WITH {REVIEW}, s AS (SELECT * FROM rt WHERE NOT lost){att}, m AS ({head} UNION ALL {mid} UNION ALL {end})
    SELECT task_id, CAST(pos AS BIGINT) AS pos, role, md5(t) AS content, CAST(n_calls AS BIGINT) AS n_calls FROM m"""


@query("stitch_v1", _stitch_sql(1))
def _(spark, sf):
    return _flat(C.stitch_v1(with_stratum(review_traces(spark, sf)), 5), "task_id")


@query("stitch_v3", _stitch_sql(3))
def _(spark, sf):
    return _flat(C.stitch_v3(with_stratum(review_traces(spark, sf)), 5), "task_id")


@query(
    "train_flags",
    f"WITH {REVIEW} SELECT task_id, CAST(1 + 2 * n_att AS BIGINT) AS after_prefix, CAST(2 + n_att AS BIGINT) AS assistant_turns FROM rt WHERE NOT lost",
)
def _(spark, sf):
    ex = C.stitch_v3(with_stratum(review_traces(spark, sf)), 5)
    n = lambda c: F.size(F.filter(c, lambda x: x)).cast("bigint")
    a = C.train_flags(ex, "prefix").select("*", n("trainable").alias("after_prefix")).drop("trainable")
    return C.train_flags(a, "assistant").select("task_id", "after_prefix", n("trainable").alias("assistant_turns"))


_ELIGIBLE = f"""{REVIEW}, pool AS (SELECT task_id, {_STRATUM} AS stratum, {_hash("'7'", 'CAST(task_id AS VARCHAR)')} AS h FROM rt WHERE NOT lost)"""


@query(
    "quota_sample",
    f"""WITH {_ELIGIBLE}, sh AS (SELECT * FROM (VALUES ('one_revise', 0.3::DOUBLE), ('two_revise', 0.4::DOUBLE), ('three_revise', 0.3::DOUBLE)) v(stratum, share)),
    ct AS (SELECT stratum, share, count(*) AS n FROM pool JOIN sh USING (stratum) GROUP BY 1, 2),
    tot AS (SELECT min(CAST(floor(n / share) AS BIGINT)) AS total FROM ct),
    rk AS (SELECT stratum, task_id, row_number() OVER (PARTITION BY stratum ORDER BY h, task_id) AS rn FROM pool)
    SELECT rk.stratum, task_id FROM rk JOIN ct USING (stratum), tot WHERE rn <= CAST(round_even(share * total, 0) AS BIGINT)""",
)
def _(spark, sf):
    return C.quota_sample(with_stratum(review_traces(spark, sf)).select("task_id", "stratum"))


@query(
    "assign_strata",
    f"""WITH r AS (SELECT doc_id AS task_id, row_number() OVER (ORDER BY {_hash("'3'", 'CAST(doc_id AS VARCHAR)')}, doc_id) AS rn, count(*) OVER () AS n FROM documents)
    SELECT task_id, CASE WHEN rn <= CAST(round_even(n * 0.4::DOUBLE, 0) AS BIGINT) THEN 'no_revise' ELSE 'revise' END AS target FROM r""",
)
def _(spark, sf):
    return C.assign_strata(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("task_id")), 0.4, 3)


@query(
    "draw_candidates",
    f"SELECT doc_id AS task_id FROM documents ORDER BY {_hash(chr(39) + '9' + chr(39), 'CAST(doc_id AS VARCHAR)')}, doc_id LIMIT 40",
)
def _(spark, sf):
    return C.draw_candidates(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("task_id")), 40, 9)


@query(
    "scrub_tasks",
    """SELECT doc_id AS task_id, md5('x = 1') AS buggy_code, md5(concat('y = 2', chr(10), CAST(n_chars AS VARCHAR))) AS fixed_code FROM documents""",
)
def _(spark, sf):
    d = fx.table(spark, sf, "documents")
    tasks = d.select(
        F.col("doc_id").alias("task_id"), F.lit("x = 1  # BUG: wrong").alias("buggy_code"),
        F.concat(F.lit("# should be 3\ny = 2\n"), F.col("n_chars").cast("string")).alias("fixed_code"),
    )
    ran = d.select(F.col("doc_id").alias("task_id"), F.lit(False).alias("buggy_passed"), F.lit(True).alias("fixed_passed"))
    return C.scrub_tasks(tasks, ran).select("task_id", F.md5("buggy_code").alias("buggy_code"), F.md5("fixed_code").alias("fixed_code"))


@query(
    "prompt_rows",
    f"""WITH {REVIEW} SELECT task_id, test_code, md5(concat('Fix the bug in this code.', chr(10), chr(10), description, chr(10), chr(10),
      'You can verify your fix against these tests via the execute_code tool:', chr(10), '```python', chr(10), test_code, chr(10), '```')) AS prompt FROM rt""",
)
def _(spark, sf):
    return C.prompt_rows(review_traces(spark, sf)).withColumn("prompt", F.md5("prompt"))


# --- agentic traces: conversations with screenshots --------------------------

AGENT = f"""base AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' AND turn > 1 THEN row_number() OVER (PARTITION BY conv_id, role = 'user' AND turn > 1 ORDER BY turn) END AS shot FROM conversations),
    stock AS (SELECT conv_id, conv_id % 4 AS n_saved FROM conversations GROUP BY 1),
    flatm AS (SELECT b.conv_id, turn, CASE WHEN shot IS NOT NULL THEN 'tool' ELSE role END AS role, CASE role WHEN 'system' THEN {_sql_list([P.STUDENT_PROMPT])[1:-1]} WHEN 'assistant' THEN text
        ELSE CASE WHEN shot IS NULL THEN text WHEN shot <= n_saved THEN concat('screenshot:|img_', CAST(b.conv_id AS VARCHAR), '_', CAST(shot AS VARCHAR))
        ELSE '{{"kind": "image", "see": 1}}' END END AS t, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_calls, shot IS NOT NULL AND shot <= n_saved AS is_shot, shot FROM base b JOIN stock s ON b.conv_id = s.conv_id),
    conv AS (SELECT conv_id, count(*) AS n_steps, bool_or(role = 'assistant') AS spoken, bool_or(is_shot AND (conv_id * 7 + shot) % 13 = 0) AS lost FROM flatm GROUP BY 1)"""


def agent_traces(spark, sf):
    none, no_parts, no_calls = F.lit(None).cast("string"), F.lit(None), F.lit(None)

    def msg(role, text=none, parts=no_parts, calls=no_calls):
        return F.struct(
            (role if not isinstance(role, str) else F.lit(role)).alias("role"), text.alias("content_text"),
            parts.cast("array<struct<type:string,text:string,image:string>>").alias("content_parts"),
            calls.cast("array<struct<name:string,arguments:string>>").alias("tool_calls"),
        )

    turns = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts")
    )
    picture = F.array(F.struct(F.lit("image_url").alias("type"), none.alias("text"), F.lit("data:").alias("image")))
    call = F.array(F.struct(F.lit("bash").alias("name"), F.lit('{"command": "ls -la"}').alias("arguments")))

    def expand(t):
        shot = F.array(msg("tool", F.lit('{"kind": "image", "see": 1}')), msg("user", parts=picture))
        plain = F.array(msg(t["role"], t["text"], calls=F.when(t["role"] == "assistant", call)))
        return F.when((t["role"] == "user") & (t["turn"] > 1), shot).otherwise(plain)

    c = F.col("conv_id")
    saved = F.transform(F.sequence(F.lit(0), (c % 4).cast("int")), lambda k: F.concat_ws("_", F.lit("img"), c.cast("string"), k.cast("string")))
    step = F.transform(
        F.filter("ts", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(
            t["turn"].cast("int").alias("step"), t["text"].alias("assistant_content"), F.lit(1.5).alias("gen_s"),
            F.array(
                F.struct(F.lit("write_file").alias("name"), F.to_json(F.struct(F.lit("a.html").alias("path"), t["text"].alias("content"))).alias("arguments")),
                F.struct(F.lit("bash").alias("name"), F.lit('{"command": "ls"}').alias("arguments")),
            ).alias("tool_calls"),
            F.array(F.struct(F.lit("bash").alias("tool"), F.lit(True).alias("ok"), F.lit("text").alias("kind"), t["text"].alias("summary"))).alias("tool_results"),
        ),
    )
    return turns.select(
        "conv_id", c.alias("task_id"), F.when(c % 3 == 0, "code").otherwise("slides").alias("category"),
        F.when(c % 5 == 0, "step_cap").otherwise("final").alias("status"), F.size("ts").alias("n_steps"), (c % 2 == 0).alias("final_passed"),
        F.slice(saved, F.lit(2), F.size(saved)).alias("saved_images"), F.flatten(F.transform("ts", expand)).alias("messages"),
        F.struct((c % 7 != 0).alias("keep"), (c % 6 != 0).alias("review_specific")).alias("judge"), step.alias("steps"),
    )


@query(
    "collapse_messages",
    f"""WITH {AGENT} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, md5(t) AS content, CAST(n_calls AS BIGINT) AS n_calls FROM flatm""",
)
def _(spark, sf):
    return _flat(C.collapse_messages(agent_traces(spark, sf)), "conv_id")


def _examples(spark, sf):
    ex = C.collapse_messages(agent_traces(spark, sf))
    conv = fx.table(spark, sf, "conversations").select("conv_id").distinct()
    files = conv.select("conv_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).filter(
        (F.col("conv_id") * 7 + F.col("k")) % 13 != 0
    ).select(F.concat_ws("_", F.lit("img"), F.col("conv_id").cast("string"), F.col("k").cast("string")).alias("path"))
    return C.build_examples(ex, files, ["conv_id"])


@query("build_examples", f"WITH {AGENT} SELECT conv_id, spoken AND NOT coalesce(lost, false) AS buildable FROM conv")
def _(spark, sf):
    return _examples(spark, sf).select("conv_id", "buildable")


@query(
    "gate_traces",
    f"""WITH {AGENT}, len AS (SELECT conv_id, sum(length(t)) AS n FROM flatm GROUP BY 1),
    g AS (SELECT c.conv_id, CASE WHEN n_steps > 6 THEN 'steps' WHEN c.conv_id % 7 = 0 THEN 'judge' WHEN c.conv_id % 3 = 0 AND c.conv_id % 2 <> 0 THEN 'final_passed'
      WHEN c.conv_id % 3 <> 0 AND c.conv_id % 5 = 0 THEN 'final_passed' WHEN NOT (spoken AND NOT coalesce(lost, false)) THEN 'missing_image' ELSE 'ok' END AS reason FROM conv c)
    SELECT reason, count(*) AS n FROM g GROUP BY 1""",
)
def _(spark, sf):
    g = C.gate_traces(_examples(spark, sf), max_steps=6, max_chars=10_000_000, judge_keep=True, final_passed=True)
    return N.reject_counts(g)


@query(
    "gate_visual",
    """SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 6 <> 0 AND conv_id % 7 <> 0 AND conv_id % 4 <> 0""",
)
def _(spark, sf):
    t = agent_traces(spark, sf)
    tasks = t.filter(F.col("conv_id") % 4 != 0).select("category", "task_id")
    return C.gate_visual(t, tasks).select("conv_id")


@query(
    "apply_judge",
    """WITH t AS (SELECT DISTINCT conv_id, conv_id % 3 = 0 AS code FROM conversations), e AS (SELECT *, CASE WHEN conv_id % 10 = 0 THEN 'no_messages' WHEN conv_id % 10 = 1 THEN 'task_not_found'
      WHEN conv_id % 10 = 2 THEN 'judge_failed' END AS error FROM t)
    SELECT conv_id, error, CASE WHEN code AND coalesce(error, 'judge_failed') = 'judge_failed' THEN conv_id % 2 = 0 WHEN error IS NOT NULL THEN false ELSE conv_id % 7 <> 0 END AS keep,
    CASE WHEN code AND coalesce(error, 'judge_failed') = 'judge_failed' THEN conv_id % 2 = 0 WHEN error IS NULL THEN conv_id % 8 <> 0 END AS final_meets_spec FROM e""",
)
def _(spark, sf):
    c = F.col("conv_id")
    ids = fx.table(spark, sf, "conversations").select("conv_id").distinct()
    cat = F.when(c % 3 == 0, "code").otherwise("web")
    t = ids.select(
        "conv_id", c.alias("task_id"), cat.alias("category"), F.when(c % 10 == 0, 0).otherwise(3).alias("n_messages"),
        (c % 10 != 1).alias("task_known"), (c % 2 == 0).alias("final_passed"),
    )
    v = ids.filter(c % 10 != 2).select(c.alias("task_id"), cat.alias("category"), (c % 7 != 0).alias("keep"), (c % 8 != 0).alias("final_meets_spec"))
    return C.apply_judge(t, v).select("conv_id", "error", "keep", "final_meets_spec")


@query(
    "step_summary",
    """WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn AS step, md5(left(text, 400)) AS said, 'a.html' AS path, CAST(length(text) AS BIGINT) AS content_bytes, md5(left(text, 200)) AS content_head, 'ls' AS command FROM a""",
)
def _(spark, sf):
    s = R.step_summary(agent_traces(spark, sf)).select("task_id", F.explode("steps").alias("s"))
    first, second = F.get(F.col("s.tool_calls"), F.lit(0)), F.get(F.col("s.tool_calls"), F.lit(1))
    return s.select(
        F.col("task_id").alias("conv_id"), F.col("s.step").cast("bigint").alias("step"), F.md5("s.assistant_content_head").alias("said"),
        first["path"].alias("path"), first["content_bytes"].cast("bigint").alias("content_bytes"), F.md5(first["content_head"]).alias("content_head"), second["command"].alias("command"),
    )


@query(
    "judge_input",
    """WITH a AS (SELECT conv_id, turn, concat_ws(chr(10), concat('--- STEP ', CAST(turn AS VARCHAR), ' ---'), concat('AGENT_SAID:', chr(10), text),
      concat('TOOL_CALLS:', chr(10), '  write_file path=''a.html'' bytes=', CAST(length(text) AS VARCHAR), chr(10), '  bash ''ls'''), concat('TOOL_RESULT: ok=True kind=text -> ', text), '') AS s
      FROM conversations WHERE role = 'assistant'),
    n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), j AS (SELECT n.conv_id, n, string_agg(s, chr(10) ORDER BY turn) AS ss FROM n LEFT JOIN a ON n.conv_id = a.conv_id GROUP BY 1, 2)
    SELECT conv_id, md5(concat_ws(chr(10), concat('CATEGORY: ', CASE WHEN conv_id % 3 = 0 THEN 'code' ELSE 'slides' END), concat('TASK_ID: ', CAST(conv_id AS VARCHAR)), concat('SPEC:', chr(10), 'Do it'),
      concat('REQUIREMENTS:', chr(10), '- r1', chr(10), '- r2'), '', ss, concat('FINAL_STATUS: ', CASE WHEN conv_id % 5 = 0 THEN 'step_cap' ELSE 'final' END, ' final_passed=', CASE WHEN conv_id % 2 = 0 THEN 'True' ELSE 'False' END,
      ' n_steps=', CAST(n AS VARCHAR)))) AS judge_input FROM j""",
)
def _(spark, sf):
    t = agent_traces(spark, sf)
    tasks = t.select("task_id", F.lit("Do it").alias("description"), F.array(F.lit("r1"), F.lit("r2")).alias("requirements"))
    return R.judge_input(t, tasks).select(F.col("task_id").alias("conv_id"), F.md5("judge_input").alias("judge_input"))


# --- visual traces -----------------------------------------------------------

VTURNS = """a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'),
    vt AS (SELECT *, conv_id % 2 = 0 AS code, NOT (conv_id % 9 = 0 AND i = 0 AND n > 1) AS art FROM a),
    okc AS (SELECT conv_id FROM vt GROUP BY 1 HAVING bool_and(art))"""


def visual_turns(spark, sf):
    """Assistant turns with artifacts; some first turns lack one."""
    turns = fx.table(spark, sf, "conversations").filter(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts")
    )
    c = F.col("conv_id")
    lang = F.when(c % 2 == 0, "python").otherwise("html")

    def turn(t, i):
        fence = F.when((c % 9 == 0) & (i == 0) & (F.size("ts") > 1), "no artifact").otherwise(F.concat(F.lit("```"), lang, F.lit("\nx\n```")))
        return F.struct(
            F.concat(F.lit("see "), fence).alias("assistant"), F.when(i % 2 == 0, t["text"]).alias("reasoning"),
            F.struct(F.concat(F.lit("fb"), i.cast("string")).alias("text_payload")).alias("feedback"),
        )

    return turns.select(
        "conv_id", c.alias("task_id"), F.when(c % 2 == 0, "code").otherwise("slides").alias("category"), F.lit("Make it").alias("user_turn"),
        F.transform("ts", turn).alias("turns"), F.struct((c % 5 != 0).alias("keep")).alias("judge"), F.lit(1000).alias("seed"), F.lit(0).alias("pos"),
    )


_VIS = """m AS (SELECT conv_id, 0 AS pos, 'system' AS role, CASE WHEN conv_id % 2 = 0 THEN 'code it' ELSE 'draw it' END AS t FROM okc UNION ALL SELECT conv_id, 1, 'user', 'Make it' FROM okc
      UNION ALL SELECT vt.conv_id, 2 + 2 * i, 'assistant', concat(CASE WHEN i % 2 = 0 THEN concat('<think>', chr(10), {cut}, chr(10), '</think>', chr(10), chr(10)) ELSE '' END, 'see ',
        CASE WHEN art THEN concat('```', CASE WHEN code THEN 'python' ELSE 'html' END, chr(10), 'x', chr(10), '```') ELSE 'no artifact' END) FROM vt JOIN okc ON vt.conv_id = okc.conv_id
      UNION ALL SELECT vt.conv_id, 3 + 2 * i, 'user', CASE WHEN code THEN concat('fb', CAST(i + 1 AS VARCHAR)) ELSE concat('rendered screenshot(s):|slides_', CAST(vt.conv_id AS VARCHAR), '_turn', CAST(i AS VARCHAR), '_1920x1080_resized.png') END
        FROM vt JOIN okc ON vt.conv_id = okc.conv_id WHERE i < n - 1)""".replace("{cut}", r"regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+\z', '')")
_SYSTEMS = {"code": "code it", "slides": "draw it"}


@query(
    "visual_examples",
    f"WITH {VTURNS}, {_VIS} SELECT conv_id, CAST(pos AS BIGINT) AS pos, role, md5(t) AS content, CAST(0 AS BIGINT) AS n_calls FROM m",
)
def _(spark, sf):
    ex = C.build_visual_examples(visual_turns(spark, sf), _SYSTEMS)
    return _flat(ex.withColumnRenamed("task_id", "conv_id"), "conv_id")


@query(
    "rejection_set",
    f"WITH {VTURNS} SELECT vt.conv_id, CAST(2 + count(*) * 2 - 1 AS BIGINT) AS n_messages FROM vt JOIN okc ON vt.conv_id = okc.conv_id WHERE vt.conv_id % 5 <> 0 AND vt.conv_id % 3 <> 0 GROUP BY 1",
)
def _(spark, sf):
    t = visual_turns(spark, sf)
    again = t.withColumn("pos", F.lit(1))
    tasks = t.filter(F.col("conv_id") % 3 != 0).select("category", "task_id")
    out = C.rejection_set(t.unionByName(again), tasks, _SYSTEMS)
    return out.select(F.col("task_id").alias("conv_id"), F.size("messages").cast("bigint").alias("n_messages"))


# --- synthetic interaction traces --------------------------------------------

RESULTS = f"""{fx.PAIRS}, res AS (SELECT task_id, ss_meets, rv_meets, rv_iters, ss_n_defects AS a, ss_n_defects + rv_n_defects AS nn, CAST(ss_tokens % 101 AS DOUBLE) / 100 AS q1, CAST(rv_tokens % 101 AS DOUBLE) / 100 AS q2 FROM pairs)"""


def _results(spark, sf):
    return fx.pairs(spark, sf).select(
        "task_id", F.col("ss_meets").alias("ss_passed"), F.col("rv_meets").alias("rv_passed"), "rv_iters",
        ((F.col("ss_tokens") % 101).cast("double") / 100).alias("ss_quality"), ((F.col("rv_tokens") % 101).cast("double") / 100).alias("rv_quality"),
        F.lit(None).cast("double").alias("ss_accuracy"), F.lit(None).cast("double").alias("rv_accuracy"),
        F.when(F.col("task_id") % 3 == 0, "ss()").alias("ss_final_code"), F.when(F.col("task_id") % 2 == 0, "rv()").otherwise("").alias("rv_final_code"),
    )


def _tasks(spark, sf):
    k = F.col("o_orderkey")
    n = k.cast("string")
    return fx.table(spark, sf, "orders").select(
        k.alias("task_id"), F.concat(F.lit("Task "), n, F.when(k % 4 == 0, F.concat(F.lit("\n```python\nb"), n, F.lit("\n```"))).otherwise("")).alias("description"),
        F.lit("assert 1").alias("test_code"), F.when(k % 5 != 0, F.array(F.concat(F.lit("bug "), n))).alias("common_bugs"),
        F.array(F.lit("r1"), F.lit("r2")).alias("requirements"), F.when(k % 5 != 0, F.array(F.concat(F.lit("issue "), n))).alias("expected_issues"),
        F.lit("clip.mp4").alias("source_video"),
    )


def _steps(traces):
    s = traces.select("task_id", "final_reward", "success", F.posexplode("steps").alias("pos", "s"))
    return s.select(
        "task_id", "final_reward", "success", F.col("pos").cast("bigint").alias("pos"), F.col("s.step_type").alias("step_type"),
        F.md5("s.output_text").alias("output"), F.md5("s.feedback").alias("feedback"), F.col("s.reward").alias("reward"),
    )


_PCT1, _PCT2 = (f"concat(CAST(CAST(round_even({q} * 100, 0) AS BIGINT) AS VARCHAR), '%')" for q in ("q1", "q2"))


def _steps_sql(parts: list[str], reward: str, success: str, extra: str = "") -> str:
    body = " UNION ALL ".join(parts)
    return f"""WITH {RESULTS}{extra}, st AS ({body}) SELECT st.task_id, {reward} AS final_reward, {success} AS success, row_number() OVER (PARTITION BY st.task_id ORDER BY o) - 1 AS pos,
    step_type, md5(output) AS output, md5(feedback) AS feedback, CAST(reward AS DOUBLE) AS reward FROM st JOIN res ON st.task_id = res.task_id"""


_N = "chr(10)"
_HINT = "CASE WHEN task_id % 5 <> 0 THEN concat('bug ', CAST(task_id AS VARCHAR)) ELSE 'edge case handling error' END"
_BODY = "concat('b', CAST(task_id AS VARCHAR))"


def _attempt_sql(fixed: str) -> str:
    return f"CASE WHEN task_id % 4 <> 0 THEN concat('# Code for task (bug: ', {_HINT}, ')', {_N}, 'pass') WHEN {fixed} THEN concat('# Fixed version addressing: ', {_HINT}, {_N}, {_BODY}) ELSE {_BODY} END"


def _py(code: str) -> str:
    return f"concat('[GENERATE]:', {_N}, '```python', {_N}, {code}, {_N}, '```')"


_STDERR = (
    f"concat('FAILED: test assertions did not pass.', {_N}, {_N}, '--- stderr ---', {_N}, 'AssertionError: Test assertion failed.', {_N}, 'The code does not correctly handle: ', {_HINT}, {_N}, "
    f"'Traceback (most recent call last):', {_N}, '  File \"test_script.py\", line 1, in <module>', {_N}, '    assert candidate(...) == expected', {_N}, 'AssertionError')"
)
_PASSED = "'PASSED: all test assertions succeeded.'"


@query(
    "code_traces",
    _steps_sql(
        [
            f"SELECT task_id, 0 AS o, 'generate' AS step_type, {_py(f'CASE WHEN task_id % 3 = 0 THEN {chr(39)}ss(){chr(39)} ELSE {_attempt_sql(chr(115) + chr(115) + chr(95) + chr(109) + chr(101) + chr(101) + chr(116) + chr(115))} END')} AS output, NULL AS feedback, NULL AS reward FROM res",
            f"SELECT task_id, 1, 'execute', '[EXECUTE]', CASE WHEN ss_meets THEN {_PASSED} ELSE {_STDERR} END, NULL FROM res",
            f"SELECT task_id, 2, 'review', concat('[REVIEW]: The test failure is caused by: ', {_HINT}, '. The fix requires modifying the code to properly handle this case. I will revise the implementation.'), NULL, NULL FROM res WHERE NOT ss_meets AND rv_meets",
            f"SELECT task_id, 3, 'revise', {_py(f'CASE WHEN task_id % 2 = 0 THEN {chr(39)}rv(){chr(39)} ELSE {_attempt_sql(chr(116) + chr(114) + chr(117) + chr(101))} END')}, NULL, NULL FROM res WHERE NOT ss_meets AND rv_meets",
            f"SELECT task_id, 4, 'execute', '[EXECUTE]', {_PASSED}, NULL FROM res WHERE NOT ss_meets AND rv_meets",
            f"SELECT task_id, 5 + 2 * k, 'review', concat('[REVIEW]: Attempt ', CAST(k + 2 AS VARCHAR), ' — the previous fix didn''t address the root cause. The issue is: ', {_HINT}, '. Trying a different approach.'), NULL, NULL FROM res, (VALUES (0), (1)) v(k) WHERE NOT ss_meets AND NOT rv_meets AND k < rv_iters - 1",
            "SELECT task_id, 6 + 2 * k, 'execute', '[EXECUTE]', 'FAILED: test assertions did not pass.', NULL FROM res, (VALUES (0), (1)) v(k) WHERE NOT ss_meets AND NOT rv_meets AND k < rv_iters - 1",
            "SELECT task_id, 99, 'submit', CASE WHEN ss_meets OR rv_meets THEN '[SUBMIT]: Tests pass. Submitting solution.' ELSE '[SUBMIT]: Budget exhausted. Submitting best attempt.' END, NULL, CASE WHEN ss_meets OR rv_meets THEN 1.0 ELSE 0.0 END FROM res",
        ],
        "CAST(CASE WHEN rv_meets THEN 1 ELSE 0 END AS DOUBLE)", "rv_meets",
    ),
)
def _(spark, sf):
    return _steps(C.code_traces(_results(spark, sf), _tasks(spark, sf)))


_ISSUE = "concat('issue ', CAST(task_id AS VARCHAR))"
_HTML_STUB = (
    f"concat('<!DOCTYPE html>', {_N}, '<html lang=\"en\">', {_N}, '<head>', {_N}, '  <meta charset=\"UTF-8\">', {_N}, '  <meta name=\"viewport\" content=\"width=device-width, initial-scale=1.0\">', {_N}, "
    f"'  <title>Slide</title>', {_N}, '  <style>', {_N}, '    /* Styles for slide */', {_N}, '    body {{ margin: 0; padding: 20px; font-family: sans-serif; }}', {_N}, '  </style>', {_N}, '</head>', {_N}, '<body>', {_N}, "
    f"'    <!-- Requirement: r1 -->', {_N}, '    <!-- Requirement: r2 -->', {_N}, '  <!-- Content based on: ', descr, ' -->', {_N}, '</body>', {_N}, '</html>')"
).replace("{{", "{").replace("}}", "}")
_DESCR = f", rd AS (SELECT *, concat('Task ', CAST(task_id AS VARCHAR), CASE WHEN task_id % 4 = 0 THEN concat({_N}, '```python', {_N}, 'b', CAST(task_id AS VARCHAR), {_N}, '```') ELSE '' END) AS descr FROM res)"


def _web(code: str) -> str:
    return f"concat('[GENERATE]:', {_N}, '```html', {_N}, {code}, {_N}, '```')"


_DRAFT = f"CASE WHEN task_id % 3 = 0 THEN 'ss()' ELSE {_HTML_STUB} END"
_KNOWN = f"CASE WHEN task_id % 5 <> 0 THEN {_ISSUE} ELSE 'layout or visual issues' END"


@query(
    "visual_traces",
    _steps_sql(
        [
            f"SELECT task_id, 0 AS o, 'generate' AS step_type, {_web(_DRAFT)} AS output, NULL AS feedback, NULL AS reward FROM rd",
            f"SELECT task_id, 1, 'execute', '[EXECUTE]: Rendering HTML in headless browser.', CASE WHEN q1 < 0.9 THEN concat('Visual quality score: ', {_PCT1}, '.', {_N}, 'Issues detected:', {_N}, '- [', CASE WHEN q1 < 0.5 THEN 'critical' ELSE 'major' END, '] ', CASE WHEN task_id % 5 <> 0 THEN {_ISSUE} ELSE 'No major issues' END) ELSE concat('Visual quality score: ', {_PCT1}, '.', {_N}, 'Rendering looks correct. All requirements appear met.') END, NULL FROM rd",
            f"SELECT task_id, 2, 'review', concat('[REVIEW]: The rendered output has visual problems: ', {_KNOWN}, '. I need to fix the CSS layout and ensure all content is properly visible within the viewport.'), NULL, NULL FROM rd WHERE rv_iters > 1 AND q1 <> q2",
            f"SELECT task_id, 3, 'revise', {_web(f'CASE WHEN task_id % 2 = 0 THEN {chr(39)}rv(){chr(39)} ELSE {_DRAFT} END')}, NULL, NULL FROM rd WHERE rv_iters > 1 AND q1 <> q2",
            f"SELECT task_id, 4, 'execute', '[EXECUTE]', concat('Visual quality score: ', {_PCT2}, '.'), NULL FROM rd WHERE rv_iters > 1 AND q1 <> q2",
            f"SELECT task_id, 9, 'submit', concat('[SUBMIT]: Quality is ', {_PCT2}, CASE WHEN q2 >= 0.7 THEN '. Meets threshold.' ELSE '. Submitting best attempt.' END), NULL, q2 FROM rd",
        ],
        "q2", "q2 >= 0.7", _DESCR,
    ),
)
def _(spark, sf):
    return _steps(C.visual_traces(_results(spark, sf), _tasks(spark, sf), "slide"))


_SCRIPT = f"CASE WHEN task_id % 3 = 0 THEN 'ss()' ELSE concat('from moviepy import VideoFileClip', {_N}, {_N}, '# Task: ', descr, {_N}, 'clip = VideoFileClip(''clip.mp4'')', {_N}, '# TODO: Apply edits', {_N}, 'clip.write_videofile(''/tmp/output.mp4'')', {_N}) END"
_VKNOWN = f"CASE WHEN task_id % 5 <> 0 THEN {_ISSUE} ELSE 'script error' END"


@query(
    "video_traces",
    _steps_sql(
        [
            f"SELECT task_id, 0 AS o, 'generate' AS step_type, {_py(_SCRIPT)} AS output, NULL AS feedback, NULL AS reward FROM rd",
            f"SELECT task_id, 1, 'execute', '[EXECUTE]', CASE WHEN q1 = 0 THEN concat('EXECUTION FAILED:', {_N}, 'Script raised an error during video processing.', {_N}, 'Common issue: ', CASE WHEN task_id % 5 <> 0 THEN {_ISSUE} ELSE 'Runtime error in video processing' END) ELSE concat('Script executed. Keyframe quality: ', {_PCT1}, '.') END, NULL FROM rd",
            f"SELECT task_id, 2, 'review', CASE WHEN q1 = 0 THEN concat('[REVIEW]: The script has a runtime error. I need to fix the code — likely related to: ', {_VKNOWN}, '.') ELSE concat('[REVIEW]: The keyframes show issues: ', {_VKNOWN}, '. Adjusting the processing parameters.') END, NULL, NULL FROM rd WHERE rv_iters > 1",
            f"SELECT task_id, 3, 'revise', {_py(f'CASE WHEN task_id % 2 = 0 THEN {chr(39)}rv(){chr(39)} ELSE {_SCRIPT} END')}, NULL, NULL FROM rd WHERE rv_iters > 1",
            f"SELECT task_id, 4, 'execute', '[EXECUTE]', concat('Keyframe quality: ', {_PCT2}, '.'), NULL FROM rd WHERE rv_iters > 1",
            f"SELECT task_id, 9, 'submit', concat('[SUBMIT]: Quality ', {_PCT2}, '. Submitting.'), NULL, q2 FROM rd",
        ],
        "q2", "q2 >= 0.7", _DESCR,
    ),
)
def _(spark, sf):
    return _steps(C.video_traces(_results(spark, sf), _tasks(spark, sf)))


_REPORT = f"CASE WHEN task_id % 3 = 0 THEN 'ss()' ELSE concat('# Research Report', {_N}, {_N}, descr, {_N}, {_N}, '## r1', {_N}, '[Content for this section]', {_N}, {_N}, '## r2', {_N}, '[Content for this section]') END"


@query(
    "research_traces",
    _steps_sql(
        [
            f"SELECT task_id, 0 AS o, 'generate' AS step_type, concat('[GENERATE]:', {_N}, {_REPORT}) AS output, NULL AS feedback, NULL AS reward FROM rd",
            f"SELECT task_id, 1, 'execute', '[EXECUTE]: Running factual verification on all claims.', concat('Factual accuracy: ', {_PCT1}, CASE WHEN q1 >= 0.9 THEN '. All claims verified.' ELSE '. Some claims need correction — specific errors identified in the verification report.' END), NULL FROM rd",
            "SELECT task_id, 2, 'review', '[REVIEW]: Some factual claims were contradicted by verification. I need to correct the specific numbers, dates, and attributions that failed fact-checking.', NULL, NULL FROM rd WHERE rv_iters > 1 AND q2 > q1",
            f"SELECT task_id, 3, 'revise', concat('[GENERATE]:', {_N}, CASE WHEN task_id % 2 = 0 THEN 'rv()' ELSE {_REPORT} END), NULL, NULL FROM rd WHERE rv_iters > 1 AND q2 > q1",
            f"SELECT task_id, 4, 'execute', '[EXECUTE]', concat('Factual accuracy: ', {_PCT2}, '.'), NULL FROM rd WHERE rv_iters > 1 AND q2 > q1",
            f"SELECT task_id, 9, 'submit', concat('[SUBMIT]: Accuracy ', {_PCT2}, '. Submitting.'), NULL, q2 FROM rd",
        ],
        "q2", "q2 >= 0.8", _DESCR,
    ),
)
def _(spark, sf):
    return _steps(C.research_traces(_results(spark, sf), _tasks(spark, sf)))


_NSTEPS = "CASE WHEN ss_meets THEN 3 WHEN rv_meets THEN 6 ELSE 3 + 2 * greatest(least(rv_iters - 1, 2), 0) END"
_NFB = "CASE WHEN ss_meets THEN 1 WHEN rv_meets THEN 2 ELSE 1 + greatest(least(rv_iters - 1, 2), 0) END"
_SFT = f"""{RESULTS}, ns AS (SELECT *, {_NSTEPS} AS k, {_NFB} AS fb FROM res), sft AS (SELECT * FROM ns WHERE rv_meets OR (NOT ss_meets AND rv_iters > 1))"""


@query(
    "to_sft",
    f"""WITH {_SFT} SELECT task_id, CAST(1 + 2 * k + fb AS BIGINT) AS n_messages, CAST(k AS BIGINT) AS n_assistant, 'code with 5 steps' AS system, CAST(CASE WHEN rv_meets THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM sft""",
)
def _(spark, sf):
    s = C.to_sft(C.code_traces(_results(spark, sf), _tasks(spark, sf)), {"code": "code with {budget} steps"}, "any {task_type}")
    return s.select(
        "task_id", F.size("messages").cast("bigint").alias("n_messages"), F.size(F.filter("messages", lambda m: m["role"] == "assistant")).cast("bigint").alias("n_assistant"),
        F.get(F.col("messages"), F.lit(0))["content"].alias("system"), "reward",
    )


@query("sft_eligible", f"WITH {_SFT} SELECT task_id FROM sft")
def _(spark, sf):
    return N.sft_eligible(C.code_traces(_results(spark, sf), _tasks(spark, sf))).select("task_id")


@query(
    "to_reward_rows",
    f"""WITH {RESULTS}{_DESCR}, n AS (SELECT *, {_NSTEPS} AS k, {_NFB} AS fb FROM rd) SELECT task_id, md5(concat('You are an AI agent solving a task step by step.', {_N}, 'Budget: 5 steps.', {_N}, 'Task type: code', {_N}, {_N}, 'Task:', {_N}, descr, {_N}, {_N},
      'Solve this task. Use [EXECUTE] to test your solution, [REVIEW] to analyze feedback, and [SUBMIT] when done.', {_N}, 'Output complete code/content in every [GENERATE] response.')) AS prompt,
    CAST(fb AS BIGINT) AS n_feedback, CAST(CASE WHEN rv_meets THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM n""",
)
def _(spark, sf):
    r = C.to_reward_rows(C.code_traces(_results(spark, sf), _tasks(spark, sf)))
    return r.select("task_id", F.md5("prompt").alias("prompt"), (F.size(F.split("completion", r"\[FEEDBACK\]:")) - 1).cast("bigint").alias("n_feedback"), "reward")


@query(
    "dialect_share",
    f"WITH {_SFT} SELECT 'code' AS task_type, count(*) AS n, 1.0::DOUBLE AS share FROM sft",
)
def _(spark, sf):
    s = C.to_sft(C.code_traces(_results(spark, sf), _tasks(spark, sf)), {"code": "x"}, "y")
    return dialect_share(s)


@query(
    "corpus_issues",
    """SELECT conv_id AS task_id, turn AS pos, CAST(length(concat('[GENERATE] ', text)) AS BIGINT) AS n_chars FROM conversations
    WHERE role = 'assistant' AND length(concat('[GENERATE] ', text)) < 200""",
)
def _(spark, sf):
    mark = F.when(F.col("role") == "assistant", F.lit("[GENERATE] ")).otherwise("")
    m = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("task_id"), "turn", F.array(F.struct("role", F.concat(mark, "text").alias("content"))).alias("messages")
    )
    return N.corpus_issues(m.select(F.struct("task_id", "turn").alias("task_id"), "messages")).select(
        "task_id.task_id", F.col("task_id.turn").alias("pos"), F.col("n_chars").cast("bigint").alias("n_chars")
    )


# --- on-policy ---------------------------------------------------------------

ONPOLICY = """o AS (SELECT doc_id, lang, source, text, CAST(doc_id % 11 AS DOUBLE) / 10 AS rv, CAST(doc_id % 7 AS DOUBLE) / 10 AS ss FROM documents),
    u AS (SELECT *, 'reviewed' AS baseline, rv AS q FROM o WHERE rv >= 0.5 UNION ALL SELECT *, 'single_shot', ss FROM o WHERE ss >= 0.5 AND doc_id % 3 <> 0)"""


def _onpolicy(spark, sf):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    no_parts = F.lit(None).cast("array<struct<type:string,text:string,image:string>>")
    msg = lambda r, t: F.struct(F.lit(r).alias("role"), t.alias("content_text"), no_parts.alias("content_parts"))
    none_m = F.filter(F.array(msg("user", none)), lambda m: F.lit(False))

    def step(kind, out, asked, later):
        return F.struct(F.lit(kind).alias("step"), F.lit("sys").alias("system"), out.alias("full_output"), asked.alias("messages"), later.alias("messages_text"))

    gen = step("generate", F.concat(F.lit("<|think|>t<|/think|>"), "text"), F.array(msg("user", F.col("lang"))), none_m)
    rev = step("revise", F.lit("better"), none_m, F.array(msg("user", F.lit("old")), msg("user", F.lit("fix this"))))
    other = step("score", F.lit("-"), none_m, none_m)
    empty = F.filter(F.array(gen), lambda s: F.lit(False))
    return fx.table(spark, sf, "documents").select(
        i.alias("task_id"), F.col("source").alias("category"), none.alias("model"), ((i % 11).cast("double") / 10).alias("rv_quality"), ((i % 7).cast("double") / 10).alias("ss_quality"),
        F.array(gen, other, rev).alias("rv_interaction_trace"), F.when(i % 3 != 0, F.array(gen)).otherwise(empty).alias("ss_interaction_trace"),
    )


@query("unpivot_conditions", f"WITH {ONPOLICY} SELECT doc_id AS task_id, baseline, q AS quality FROM u")
def _(spark, sf):
    return N.unpivot_conditions(_onpolicy(spark, sf), 0.5).select("task_id", "baseline", "quality")


@query(
    "onpolicy_sft",
    f"""WITH {ONPOLICY} SELECT doc_id AS task_id, source AS task_type, q AS reward, 'onpolicy' AS source, 'unknown' AS model, baseline,
    md5(concat_ws('|', 'system:sys', concat('user:', lang), concat('assistant:<think>t</think>', text), CASE WHEN baseline = 'reviewed' THEN 'user:fix this' END, CASE WHEN baseline = 'reviewed' THEN 'assistant:better' END)) AS messages FROM u""",
)
def _(spark, sf):
    m = F.md5(F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["content"])), "|"))
    return C.onpolicy_sft(_onpolicy(spark, sf)).withColumn("messages", m)
