"""Registered text, JSON, budget and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialyst.functions import budget as B
from trialyst.functions import jsontext as X
from trialyst.functions import text as T
from trialyst.operators import reports as R
from trialyst.plans import fixtures as fx
from trialyst.plans.registry import query

WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


# Documents dressed as model output: fences, markers, comments and tool blocks.
FENCED = """fenced AS (SELECT doc_id, CASE doc_id % 4
      WHEN 0 THEN concat('Plan.', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'then', chr(10), '```python ', chr(10), 'x = ', CAST(doc_id AS VARCHAR), chr(10), '```')
      WHEN 1 THEN concat('Here:', chr(10), '```', chr(10), text, chr(10), '```')
      WHEN 2 THEN concat('  ', text, chr(10)) ELSE concat('```html', chr(10), text, '```', chr(10), 'done <final> ok </final>') END AS out FROM documents)"""


def _fenced(spark, sf):
    i, t = F.col("doc_id") % 4, F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.when(i == 0, F.concat(F.lit("Plan.\n```python\n"), t, F.lit("\n```\nthen\n```python \nx = "), F.col("doc_id").cast("string"), F.lit("\n```")))
        .when(i == 1, F.concat(F.lit("Here:\n```\n"), t, F.lit("\n```")))
        .when(i == 2, F.concat(F.lit("  "), t, F.lit("\n")))
        .otherwise(F.concat(F.lit("```html\n"), t, F.lit("```\ndone <final> ok </final>")))
        .alias("out"),
    )


def _digest(c):
    return F.md5(c)


@query(
    "extract_code",
    rf"""WITH {FENCED} SELECT doc_id, md5({_strip(f"CASE WHEN regexp_matches(out, '(?s)```python{WS}*\n(.*?)```') THEN regexp_extract(out, '(?s)```python{WS}*\n(.*?)```', 1) WHEN regexp_matches(out, '(?s)```{WS}*\n(.*?)```') THEN regexp_extract(out, '(?s)```{WS}*\n(.*?)```', 1) ELSE out END")}) AS code FROM fenced""",
)
def _(spark, sf):
    return _fenced(spark, sf).select("doc_id", _digest(T.extract_code("out")).alias("code"))


@query(
    "extract_last_code",
    rf"""WITH {FENCED}, m AS (SELECT doc_id, regexp_extract_all(out, '(?s)```python{WS}*\n(.*?)\n```', 1) AS m,
      regexp_extract_all(out, '(?s)```html{WS}*\n(.*?)```', 1) AS h FROM fenced)
    SELECT doc_id, {_strip("m[-1]")} AS code, md5({_strip("h[-1]")}) AS html FROM m""",
)
def _(spark, sf):
    return _fenced(spark, sf).select(
        "doc_id", T.extract_last_code("out", closing_newline=True).alias("code"), _digest(T.extract_last_code("out", "html")).alias("html")
    )


@query(
    "final_marker",
    f"WITH {FENCED} SELECT doc_id, regexp_matches(out, '(?i)<final>{WS}*OK{WS}*</final>') AS final FROM fenced",
)
def _(spark, sf):
    return _fenced(spark, sf).select("doc_id", T.has_final("out").alias("final"))


FUNCS = """funcs AS (SELECT doc_id, concat('import os', chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('def solve(x): return x  # ', text) WHEN doc_id % 3 = 1
      THEN concat('def solve(x, y):', chr(10), '    ', replace(text, chr(10), concat(chr(10), '    ')), chr(10), chr(10), '    return a', chr(10), 'print(1)', chr(10)) ELSE concat('def other(): pass', chr(10), text) END) AS src FROM documents)"""


@query(
    "extract_function",
    rf"""WITH {FUNCS} SELECT doc_id, md5(regexp_replace(CASE WHEN regexp_matches(src, '(def solve{WS}*\(.*?\n(?:(?:    .*|)\n)*)') THEN regexp_extract(src, '(def solve{WS}*\(.*?\n(?:(?:    .*|)\n)*)', 1)
      WHEN regexp_matches(src, '(def solve{WS}*\(.*?:.*)') THEN regexp_extract(src, '(def solve{WS}*\(.*?:.*)', 1) END, '{WS}+\z', '')) AS fn FROM funcs""",
)
def _(spark, sf):
    # given texts as a comment of one line and what follows it, as a body, and without the function
    i, text = F.col("doc_id") % 3, F.col("text")
    body = F.replace(text, F.lit("\n"), F.lit("\n    "))
    src = F.concat(
        F.lit("import os\n"),
        F.when(i == 0, F.concat(F.lit("def solve(x): return x  # "), text))
        .when(i == 1, F.concat(F.lit("def solve(x, y):\n    "), body, F.lit("\n\n    return a\nprint(1)\n")))
        .otherwise(F.concat(F.lit("def other(): pass\n"), text)),
    )
    return fx.table(spark, sf, "documents").select("doc_id", _digest(T.extract_function(src, "solve")).alias("fn"))


@query(
    "truncate_middle",
    """WITH d AS (SELECT doc_id, text, length(text) AS n, concat(chr(10), chr(10), '... [truncated ', CAST(length(text) - 1000 AS VARCHAR), ' chars] ...', chr(10), chr(10)) AS note FROM documents)
    SELECT doc_id, md5(CASE WHEN n <= 1000 THEN text ELSE concat(left(text, (1000 - length(note)) // 2), note, right(text, (1000 - length(note)) // 2)) END) AS cut FROM d""",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", _digest(T.truncate_middle("text", 1000)).alias("cut"))


@query(
    "trim_note",
    """SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE concat(left(text, 500), chr(10), chr(10), '… [truncated, ',
    format('{:,}', length(text) - 500), ' more characters]') END) AS cut FROM documents""",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", _digest(T.trim_note("text", 500)).alias("cut"))


@query(
    "keep_tail",
    rf"""WITH d AS (SELECT doc_id, text, regexp_split_to_array({_strip('text')}, '\r\n|\n|\r') AS ls FROM documents)
    SELECT doc_id, md5(right(text, 800)) AS tail, md5(array_to_string(ls[greatest(len(ls) - 24, 1):], chr(10))) AS last_lines FROM d""",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", _digest(T.keep_tail("text", 800)).alias("tail"), _digest(T.tail_lines("text", 25)).alias("last_lines")
    )


BUG_RE2 = r"(?:BUG|FIXME|TODO|XXX|bug|Bug|[Mm]issing|[Ii]ncorrect|[Ww]rong|[Oo]ff.?by|[Ss]hould be|\b[Ff]ix\b|[Bb]uggy)"
LEAKY = """leaky AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN concat('# BUG: off-by-one here', chr(10), 'x = 1', chr(10), chr(10), chr(10), chr(10), text)
      WHEN 1 THEN concat('y = f(x)   # wrong sign', chr(10), text) WHEN 2 THEN concat('z = 2  # plain note', chr(10), text) ELSE text END AS code FROM documents)"""
_SCRUB = (
    rf"regexp_replace(regexp_replace(regexp_replace(code, '(?m)^{WS}*#[^\n]*{BUG_RE2}[^\n]*$\n?', '', 'g'), "
    rf"'([^\s\x0b\x1c-\x1f\x{{85}}\pZ].*?){WS}*#[^\n]*{BUG_RE2}[^\n]*', '\1', 'g'), '\n\n\n+', '\n\n', 'g')"
).replace("'\\n\\n', 'g'", "concat(chr(10), chr(10)), 'g'")


def _leaky(spark, sf):
    i, t = F.col("doc_id") % 4, F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", "lang",
        F.when(i == 0, F.concat(F.lit("# BUG: off-by-one here\nx = 1\n\n\n\n"), t))
        .when(i == 1, F.concat(F.lit("y = f(x)   # wrong sign\n"), t))
        .when(i == 2, F.concat(F.lit("z = 2  # plain note\n"), t))
        .otherwise(t).alias("code"),
    )


@query("scrub_comments", f"WITH {LEAKY} SELECT doc_id, md5({_SCRUB}) AS code FROM leaky")
def _(spark, sf):
    return _leaky(spark, sf).select("doc_id", _digest(T.scrub("code")).alias("code"))


@query(
    "leak_rate",
    f"WITH {LEAKY} SELECT lang, count(*) AS n, CAST(count(*) FILTER (WHERE {_SCRUB} <> code) AS DOUBLE) / count(*) AS leak_rate FROM leaky GROUP BY 1",
)
def _(spark, sf):
    return R.leak_rate(_leaky(spark, sf), "code", ["lang"])


@query(
    "description_signature",
    f"SELECT doc_id, regexp_replace(lower(text), '{WS}+', ' ', 'g') AS sig FROM documents",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", T.desc_signature("text").alias("sig"))


@query(
    "convert_markers",
    """WITH d AS (SELECT doc_id, concat('<|think|>', text, '<|/think|><|startofthought|>a<|endofthought|>') AS t FROM documents),
    q AS (SELECT doc_id, replace(replace(replace(replace(t, '<|think|>', '<think>'), '<|/think|>', '</think>'), '<|startofthought|>', '<think>'), '<|endofthought|>', '</think>') AS tags FROM d)
    SELECT doc_id, md5(tags) AS tags, md5(replace(replace(tags, '<think>', '<|think|>'), '</think>', '<|/think|>')) AS markers FROM q""",
)
def _(spark, sf):
    t = F.concat(F.lit("<|think|>"), F.col("text"), F.lit("<|/think|><|startofthought|>a<|endofthought|>"))
    d = fx.table(spark, sf, "documents").select("doc_id", T.convert_markers(t).alias("tags"))
    return d.select("doc_id", _digest(F.col("tags")).alias("tags"), _digest(T.convert_markers("tags", "markers")).alias("markers"))


_ERRS = ["SyntaxError: x", "boom AssertionError", "TimeoutError", "NameError: y", "TypeError: z"]


@query(
    "classify_error",
    rf"""WITH d AS (SELECT doc_id, concat(text, chr(10), CASE doc_id % 7 WHEN 0 THEN '{_ERRS[0]}' WHEN 1 THEN '{_ERRS[1]}' WHEN 2 THEN '{_ERRS[2]}'
      WHEN 3 THEN '{_ERRS[3]}' WHEN 4 THEN '{_ERRS[4]}' WHEN 5 THEN concat('  ValueError: ', CAST(doc_id AS VARCHAR), '  ', chr(10), ' ') ELSE '' END) AS e FROM documents),
    l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(e, '\r\n|\n|\r'), lambda x: {_strip('x')}), lambda x: length(x) > 0) AS ls FROM d)
    SELECT doc_id, CASE WHEN contains(e, 'SyntaxError') THEN 'SyntaxError: code could not be parsed' WHEN contains(e, 'AssertionError') THEN 'AssertionError: one or more test assertions failed'
      WHEN contains(e, 'TimeoutError') THEN 'TimeoutError: code raised a timeout internally' WHEN contains(e, 'NameError') THEN 'NameError: undefined name referenced'
      WHEN contains(e, 'TypeError') THEN 'TypeError: wrong type or argument count' WHEN len(ls) > 0 THEN ls[-1] ELSE 'Unknown runtime error' END AS label FROM l""",
)
def _(spark, sf):
    i = F.col("doc_id") % 7
    end = F.when(i == 0, _ERRS[0]).when(i == 1, _ERRS[1]).when(i == 2, _ERRS[2]).when(i == 3, _ERRS[3]).when(i == 4, _ERRS[4])
    end = end.when(i == 5, F.concat(F.lit("  ValueError: "), F.col("doc_id").cast("string"), F.lit("  \n "))).otherwise("")
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n"), end).alias("e"))
    return d.select("doc_id", T.classify_error("e").alias("label"))


@query(
    "pass_verdicts",
    """WITH d AS (SELECT doc_id, upper(concat(text, CASE doc_id % 5 WHEN 0 THEN ' Verdict: pass' WHEN 1 THEN ' verdict -- we PASS this' WHEN 2 THEN ' verdict: revise, then pass'
      WHEN 3 THEN ' pass' ELSE ' verdict unclear for now and the rest of this is much too far away to count as a pass' END)) AS u FROM documents),
    s AS (SELECT *, instr(u, 'VERDICT') AS p FROM d)
    SELECT doc_id, contains(u, 'VERDICT: PASS') OR contains(u, 'VERDICT** PASS') OR contains(u, 'VERDICT**: PASS') OR (p > 0 AND contains(substr(u, p + 7, 60), 'PASS') AND NOT contains(substr(u, p + 7, 60), 'REVISE')) AS passed FROM s""",
)
def _(spark, sf):
    i = F.col("doc_id") % 5
    end = F.when(i == 0, " Verdict: pass").when(i == 1, " verdict -- we PASS this").when(i == 2, " verdict: revise, then pass").when(i == 3, " pass")
    end = end.otherwise(" verdict unclear for now and the rest of this is much too far away to count as a pass")
    return fx.table(spark, sf, "documents").select("doc_id", T.is_pass_verdict(F.concat("text", end)).alias("passed"))


@query(
    "display_names",
    """WITH n AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS name, concat('web_', replace(p_name, ' ', '_'), '_v2x') AS tid FROM part)
    SELECT p_partkey, CASE WHEN name <> '' THEN name ELSE concat(array_to_string(list_transform(string_split(replace(substr(tid, 5), '_', ' '), ' '),
      lambda w: CASE WHEN w = 'v2x' THEN 'V2X' ELSE concat(upper(w[1]), w[2:]) END), ' ')) END AS name FROM n""",
)
def _(spark, sf):
    tid = F.concat(F.lit("web_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_v2x"))
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("")
    none = F.lit(None).cast("string")
    return fx.table(spark, sf, "part").select("p_partkey", T.nice_name(tid, name, none, none).alias("name"))


@query(
    "seed_tags",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('fig_run', CAST(p_size AS VARCHAR)) WHEN 1 THEN concat('slides_run', CAST(p_size AS VARCHAR))
    WHEN 2 THEN concat('anim_run', CAST(p_size AS VARCHAR)) ELSE concat('web_b_run', CAST(p_size AS VARCHAR)) END AS tag FROM part""",
)
def _(spark, sf):
    k, n = F.col("p_size") % 4, F.col("p_size").cast("string")
    stem = F.when(k == 0, F.concat(F.lit("paperfig_geom_hard_run"), n)).when(k == 1, F.concat(F.lit("slides_hard2_geom_run"), n))
    stem = stem.when(k == 2, F.concat(F.lit("anim_clean_geom_run"), n)).otherwise(F.concat(F.lit("web_hard_geom_b_run"), n))
    return fx.table(spark, sf, "part").select("p_partkey", T.seed_tag(stem).alias("tag"))


@query(
    "flatten_content",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE concat(role, chr(10), text) END AS content FROM conversations""",
)
def _(spark, sf):
    def part(kind, text, image):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image"))

    none = F.lit(None).cast("string")
    parts = F.array(part("text", F.col("role"), none), part("image", none, F.lit("a.png")), part("text", F.col("text"), none))
    odd = F.col("turn") % 2 == 1
    c = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.when(~odd, F.col("text")).alias("t"), F.when(odd, parts).alias("p"))
    return c.select("conv_id", "turn", T.flatten_content("t", "p").alias("content"))


@query(
    "reasoning_prefix",
    rf"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE concat('<think>', chr(10), regexp_replace(left(text, 1500), '{WS}+\z', ''), chr(10), '</think>', chr(10), chr(10), 'done') END) AS t FROM documents""",
)
def _(spark, sf):
    r = F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("")
    return fx.table(spark, sf, "documents").select("doc_id", _digest(T.with_reasoning(F.lit("done"), r, 1500)).alias("t"))


@query(
    "shorten_fences",
    r"""WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\n') AS ls FROM documents)
    SELECT doc_id, md5(concat('see', chr(10), '```python', chr(10), array_to_string(ls[1:8], chr(10)), chr(10), '... [code truncated]', chr(10), '```', chr(10), 'end')) AS t FROM d""",
)
def _(spark, sf):
    t = F.concat(F.lit("see\n```python\n"), F.col("text"), F.lit("\n```\nend"))
    return fx.table(spark, sf, "documents").select("doc_id", _digest(T.shorten_fences(t)).alias("t"))


@query(
    "described_code",
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('Fix:', chr(10), '```python', chr(10), text, '```', chr(10), 'ok') ELSE text END AS t FROM documents)
    SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN regexp_extract(t, '(?s)```python\n(.*?)```', 1) END) AS code FROM d""",
)
def _(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Fix:\n```python\n"), F.col("text"), F.lit("```\nok"))).otherwise(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", _digest(T.described_code(t)).alias("code"))


# --- JSON --------------------------------------------------------------------

JUDGE = """j AS (SELECT doc_id, CAST(doc_id % 21 AS DOUBLE) / 10 AS q, doc_id % 2 = 0 AS m, doc_id % 5 AS k FROM documents)"""


def _answers(spark, sf):
    i = F.col("doc_id")
    said = F.regexp_replace("text", r'["\\\x00-\x1f]', " ")  # every answer holds the given text
    body = F.concat(
        F.lit('{"comment": "'), said, F.lit('} {", "quality_score": '), ((i % 21).cast("double") / 10).cast("string"), F.lit(', "overall_quality": '), ((i % 21).cast("double") / 10).cast("string"),
        F.lit(', "meets_requirements": '), (i % 2 == 0).cast("string"), F.lit("}"),
    )
    k = i % 5
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Well: "), body, F.lit(" as said.")))
    text = text.when(k == 3, F.concat(F.lit("no json "), F.col("text"))).otherwise(F.concat(F.lit('{"issues": ["'), said, F.lit('"]}')))
    return fx.table(spark, sf, "documents").select("doc_id", text.alias("answer"))


@query(
    "parse_judge",
    f"""WITH {JUDGE} SELECT doc_id, k <> 3 AS parsed, CASE WHEN k < 3 THEN q ELSE 0.5 END AS quality_score,
    CASE WHEN k < 3 THEN m ELSE false END AS meets_requirements FROM j""",
)
def _(spark, sf):
    return _answers(spark, sf).select("doc_id", X.parse_judge(F.col("answer")).alias("j")).select("doc_id", "j.*")


@query(
    "parse_visual_review",
    f"""WITH {JUDGE} SELECT doc_id, k <> 3 AS parsed, CASE WHEN k < 3 THEN greatest(0.0, least(1.0, q)) ELSE 0.5 END AS overall_quality FROM j""",
)
def _(spark, sf):
    return _answers(spark, sf).select("doc_id", X.parse_judge(F.col("answer"), "visual", clamp=True).alias("j")).select("doc_id", "j.*")


@query(
    "first_json",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('{"a": {"b": "}', replace(replace(text, '"', ''), chr(92), ''), '"}, "n": ', CAST(doc_id AS VARCHAR), '}') WHEN 1 THEN concat('{"n": ', CAST(doc_id AS VARCHAR), '}')
    ELSE concat('{"open": ', CAST(doc_id AS VARCHAR)) END AS obj FROM documents""",
)
def _(spark, sf):
    i, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    t = F.when(i == 0, F.concat(F.lit("<think>{hm}</think>\nSure. "), F.lit('{"a": {"b": "}'), F.regexp_replace("text", r'["\\]', ""), F.lit('"}, "n": '), n, F.lit("} trailing {")))
    t = t.when(i == 1, F.concat(F.lit('```json\n{"n": '), n, F.lit("}\n```"))).otherwise(F.concat(F.lit('so {"open": '), n))
    d = fx.table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return X.first_json(d, "t", "obj").select("doc_id", "obj")


CALLED = """m AS (SELECT conv_id, turn, text FROM conversations)"""


def _called(spark, sf):
    """All turns with a good block, a broken one and an argument string."""
    body = F.to_json(F.struct(F.lit("execute_code").alias("name"), F.struct(F.col("text").alias("code"), F.lit("assert 1").alias("test_code")).alias("arguments")))
    said = F.concat(F.col("turn").cast("string"), F.regexp_replace("text", r'["\\]', ""))
    broken = F.concat(F.lit('{"name": "execute_code", "arguments": {"code": "print("'), said, F.lit('")\\n\\\\n", "test_code": "t"}}'))
    text_args = F.to_json(F.struct(F.lit("run").alias("name"), F.lit('{"code": "c"}').alias("arguments")))

    def block(b):
        return F.concat(F.lit("\n<tool_call>\n"), b, F.lit("\n</tool_call>"))

    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("hi "), block(body), block(broken), block(text_args), F.lit(" bye ")).alias("out")
    )


@query(
    "tool_calls_strict",
    f"""WITH {CALLED} SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, 'execute_code' AS name, md5(text) AS code, 'assert 1' AS test_code FROM m
    UNION ALL SELECT conv_id, turn, CAST(2 AS BIGINT), 'run', md5('c'), NULL FROM m""",
)
def _(spark, sf):
    return X.tool_calls(_called(spark, sf), "out").select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "name", _digest(F.col("code")).alias("code"), "test_code"
    )


@query(
    "tool_calls_lenient",
    f"""WITH {CALLED} SELECT conv_id, turn, CAST(1 AS BIGINT) AS pos, concat('print("', CAST(turn AS VARCHAR), replace(replace(text, '"', ''), chr(92), ''), '")', chr(10), '\\n') AS code, 't' AS test_code FROM m""",
)
def _(spark, sf):
    calls = X.tool_calls(_called(spark, sf), "out", lenient=True)
    return calls.filter("recovered").select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "code", "test_code")


@query(
    "tool_calls_lateral",
    f"""WITH {CALLED} SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, 'execute_code' AS name, md5(text) AS code, false AS recovered FROM m
    UNION ALL SELECT conv_id, turn, 1, 'execute_code', md5(concat('print("', CAST(turn AS VARCHAR), replace(replace(text, '"', ''), chr(92), ''), '")', chr(10), '\\n')), true FROM m
    UNION ALL SELECT conv_id, turn, 2, 'run', md5('c'), false FROM m""",
)
def _(spark, sf):
    X.register_tool_calls(spark)
    _called(spark, sf).createOrReplaceTempView("tool_answers")
    return spark.sql(
        "SELECT conv_id, turn, CAST(t.pos AS BIGINT) AS pos, t.name, md5(t.code) AS code, t.recovered FROM tool_answers a, LATERAL tool_calls(a.out) t"
    )


@query(
    "open_tool_calls",
    f"""WITH {CALLED} SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, 'bash' AS name, md5(text) AS argument, true AS closed FROM m
    UNION ALL SELECT conv_id, turn, 1, 'read_file', md5('a.txt'), false FROM m
    UNION ALL SELECT conv_id, turn, 2, 'write_file', md5(concat(replace(replace(text, '"', ''), chr(92), ''), ' end')), false FROM m""",
)
def _(spark, sf):
    # a whole call, one without its closing tag, and one that breaks off inside the given text
    whole = F.to_json(F.struct(F.lit("bash").alias("name"), F.struct(F.col("text").alias("command")).alias("arguments")))
    cut = F.concat(F.lit('{"name": "write_file", "arguments": {"path": "b.txt", "content": "'), F.regexp_replace("text", r'["\\]', ""), F.lit(" end"))
    said = F.concat(F.lit("x <tool_call>"), whole, F.lit('</tool_call> y <tool_call> {"name": "read_file", "arguments": {"path": "a.txt"}} z <tool_call>'), cut)
    d = fx.table(spark, sf, "conversations").select("conv_id", "turn", said.alias("out"))
    key = F.when(F.col("name") == "bash", "command").when(F.col("name") == "read_file", "path").otherwise("content")
    argument = F.element_at(F.from_json("arguments", "map<string,string>"), key)
    return X.open_tool_calls(d, "out").select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "name", F.md5(argument).alias("argument"), "closed")


@query("strip_tool_calls", f"WITH {CALLED} SELECT conv_id, turn, concat('hi ', repeat(chr(10), 3), ' bye') AS t FROM m")
def _(spark, sf):
    return _called(spark, sf).select("conv_id", "turn", T.strip_tool_calls("out").alias("t"))


@query(
    "recovery_report",
    """WITH s AS (SELECT l_returnflag AS model, l_partkey AS task_id, l_quantity > 40 AS p0, l_quantity > 35 AS p1, l_linenumber > 5 AS t0, l_linenumber > 3 AS t1 FROM lineitem),
    g AS (SELECT model, task_id, count(*) AS s, count(*) FILTER (WHERE p0) AS p0, count(*) FILTER (WHERE p1) AS p1, count(*) FILTER (WHERE t0) AS t0,
      count(*) FILTER (WHERE t1) AS t1, count(*) FILTER (WHERE p1 AND NOT p0) AS fl FROM s GROUP BY 1, 2)
    SELECT g.model, CAST(sum(p0) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS mean_pass_before, CAST(sum(p1) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS mean_pass_after,
    CAST(sum(t0) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS mean_tool_before, CAST(sum(t1) AS DOUBLE) / CAST(sum(s) AS DOUBLE) AS mean_tool_after,
    CAST(count(*) FILTER (WHERE p0 > 0) AS DOUBLE) / count(*) AS any_pass_before, CAST(count(*) FILTER (WHERE p1 > 0) AS DOUBLE) / count(*) AS any_pass_after,
    CAST(count(*) FILTER (WHERE t0 > 0) AS DOUBLE) / count(*) AS any_tool_before, CAST(count(*) FILTER (WHERE t1 > 0) AS DOUBLE) / count(*) AS any_tool_after,
    CAST(sum(fl) AS BIGINT) AS flipped_samples, max(b.n) AS recovered_blocks, max(b.k) AS recovered_passed FROM g
    JOIN (SELECT l_returnflag AS model, count(*) AS n, count(*) FILTER (WHERE l_quantity > 35) AS k FROM lineitem WHERE l_linenumber IN (4, 5) GROUP BY 1) b ON g.model = b.model GROUP BY 1""",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    ids = [F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("task_id"),
           F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus").alias("sample")]
    before = li.select(*ids, (F.col("l_quantity") > 40).alias("passed"), (F.col("l_linenumber") > 5).alias("tool_called"))
    after = li.select(*ids, (F.col("l_quantity") > 35).alias("passed"), (F.col("l_linenumber") > 3).alias("tool_called"))
    blocks = li.filter(F.col("l_linenumber").isin(4, 5)).select(F.col("l_returnflag").alias("model"), (F.col("l_quantity") > 35).alias("block_passed"))
    return R.recovery_report(before, after, blocks)


# --- budgets -----------------------------------------------------------------


def _alloc_sql(shares: list[str]) -> str:
    return f"""WITH i AS (SELECT o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS budget, 1 + o_orderkey % 5 AS iteration, 5 AS total_iterations,
      CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 101 AS DOUBLE) / 100 END AS confidence FROM orders),
    r AS (SELECT *, {shares[0]} AS s0, {shares[1]} AS s1, {shares[2]} AS s2 FROM i),
    f AS (SELECT *, CAST(floor(s0 * CAST(budget AS DOUBLE)) AS BIGINT) AS f0, CAST(floor(s1 * CAST(budget AS DOUBLE)) AS BIGINT) AS f1, CAST(floor(s2 * CAST(budget AS DOUBLE)) AS BIGINT) AS f2 FROM r),
    m AS (SELECT *, s0 * CAST(budget AS DOUBLE) - f0 AS m0, s1 * CAST(budget AS DOUBLE) - f1 AS m1, s2 * CAST(budget AS DOUBLE) - f2 AS m2, budget - f0 - f1 - f2 AS short FROM f)
    SELECT run_id, budget, f0 + CASE WHEN CAST(m1 > m0 AS INT) + CAST(m2 > m0 AS INT) < short THEN 1 ELSE 0 END AS propose,
    f1 + CASE WHEN CAST(m0 >= m1 AS INT) + CAST(m2 > m1 AS INT) < short THEN 1 ELSE 0 END AS execute,
    f2 + CASE WHEN CAST(m0 >= m2 AS INT) + CAST(m1 >= m2 AS INT) < short THEN 1 ELSE 0 END AS review FROM m"""


_ADAPT = [f"CASE WHEN iteration = 1 THEN CAST({a} AS DOUBLE) WHEN iteration = total_iterations THEN CAST({b} AS DOUBLE) ELSE CAST({c} AS DOUBLE) END"
          for a, b, c in ((0.6, 0.2, 0.2), (0.2, 0.6, 0.4), (0.2, 0.2, 0.4))]
_CONF = [f"CASE WHEN confidence IS NULL THEN {_ADAPT[i]} WHEN confidence >= 0.85 THEN CAST({a} AS DOUBLE) WHEN confidence >= 0.5 THEN CAST({b} AS DOUBLE) ELSE CAST({c} AS DOUBLE) END"
         for i, (a, b, c) in enumerate(((0.1, 0.2, 0.3), (0.7, 0.5, 0.2), (0.2, 0.3, 0.5)))]

for _name, _shares in {
    "fixed": ["CAST(0.4 AS DOUBLE)", "CAST(0.3 AS DOUBLE)", "CAST(0.3 AS DOUBLE)"],
    "phase_adaptive": _ADAPT,
    "confidence_conditioned": _CONF,
}.items():

    @query(f"allocate_{_name}", _alloc_sql(_shares))
    def _(spark, sf, strategy=_name):
        k = F.col("o_orderkey")
        runs = fx.table(spark, sf, "orders").select(
            k.alias("run_id"), F.floor("o_totalprice").cast("bigint").alias("budget"), (k % 5 + 1).alias("iteration"),
            F.lit(5).alias("total_iterations"), F.when(k % 4 != 0, (F.col("o_custkey") % 101).cast("double") / 100).alias("confidence"),
        )
        return B.allocate(runs, strategy).select("run_id", "budget", "propose", "execute", "review")


@query(
    "call_caps",
    """SELECT o_orderkey AS run_id, least(8192, greatest(256, CAST(floor(CAST(o_custkey % 10 AS DOUBLE) / 10 * CAST(floor(o_totalprice) AS DOUBLE) / 5) AS BIGINT))) AS cap FROM orders""",
)
def _(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        B.call_cap((F.col("o_custkey") % 10).cast("double") / 10, F.floor("o_totalprice").cast("bigint"), F.lit(5)).alias("cap"),
    )


@query(
    "confidence_estimate",
    f"""WITH {fx.ITERS} SELECT run_id, iteration, round(CASE WHEN passed THEN 0.95 WHEN confidence > 0 THEN confidence
      ELSE least(0.3 + 0.1 * iteration, 0.8) END, 9) AS estimate FROM iters""",
)
def _(spark, sf):
    return fx.iters(spark, sf).select(
        "run_id", "iteration", F.round(B.confidence(F.col("iteration"), F.col("passed"), F.col("confidence")), 9).alias("estimate")
    )


@query(
    "rewards",
    """WITH c AS (SELECT l_orderkey AS run_id, count(*) FILTER (WHERE l_returnflag <> 'N') AS n, bool_or(l_quantity > 40) AS ok, bool_or(l_tax > 0.07) AS err FROM lineitem GROUP BY 1)
    SELECT run_id, CAST(CASE WHEN n = 0 THEN 0.0 WHEN err THEN 0.05 WHEN ok THEN 1.0 ELSE 0.1 END AS DOUBLE) AS v1,
    CAST(CASE WHEN n = 0 THEN 0.0 WHEN err THEN 0.05 WHEN ok THEN CASE WHEN n >= 2 THEN 1.5 ELSE 1.0 END ELSE 0.1 END AS DOUBLE) AS v2 FROM c""",
)
def _(spark, sf):
    c = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count_if(F.col("l_returnflag") != "N").alias("n"), F.max(F.col("l_quantity") > 40).alias("ok"), F.max(F.col("l_tax") > 0.07).alias("err")
    )
    a = (F.col("n"), F.col("ok"), F.col("err"))
    return c.select("run_id", B.reward(1, *a).alias("v1"), B.reward(2, *a).alias("v2"))


@query(
    "budget_plan",
    """SELECT o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS budget, greatest(1, CAST(floor(o_totalprice) AS BIGINT) // 40000) AS iterations,
    greatest(2, CAST(floor(o_totalprice) AS BIGINT) // 50000) AS samples FROM orders""",
)
def _(spark, sf):
    return B.budget_plan(fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.floor("o_totalprice").cast("bigint").alias("budget")))


# --- reports -----------------------------------------------------------------


@query(
    "review_text",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, concat('Issues found:', chr(10), '  1. [', CASE WHEN l_tax > 0.04 THEN 'CRITICAL' ELSE 'UNKNOWN' END, '] d', CAST(l_partkey AS VARCHAR),
      CASE WHEN l_linenumber > 3 THEN concat('  (near: L', CAST(l_linenumber AS VARCHAR), ')') ELSE '' END, chr(10), chr(10), 'Suggestions:', chr(10), '  1. a', chr(10), '  2. b',
      chr(10), chr(10), 'Reviewer confidence: ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '%') AS review FROM lineitem""",
)
def _(spark, sf):
    issue = F.array(
        F.struct(
            F.when(F.col("l_tax") > 0.04, "critical").alias("severity"), F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("description"),
            F.when(F.col("l_linenumber") > 3, F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))).alias("line_hint"),
        )
    )
    text = R.review_text(issue, F.array(F.lit("a"), F.lit("b")), F.col("l_quantity") / 100)
    return fx.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", text.alias("review"))


@query(
    "claim_text",
    """WITH c AS (SELECT user_id AS report_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, concat('c', CAST(event_id AS VARCHAR)) AS claim,
      CASE event_type WHEN 'view' THEN 'contradicted' WHEN 'error' THEN 'unverifiable' ELSE 'supported' END AS v FROM events),
    g AS (SELECT report_id, count(*) AS n, count(*) FILTER (WHERE v = 'supported') AS s,
      string_agg(concat('  ✗ "', claim, '"', chr(10), '    Evidence: ', 'e'), chr(10) ORDER BY rn) FILTER (WHERE v = 'contradicted') AS bad,
      string_agg(concat('  ? "', claim, '"'), chr(10) ORDER BY rn) FILTER (WHERE v = 'unverifiable') AS unk FROM c GROUP BY 1)
    SELECT report_id, concat_ws(chr(10), concat('Factual Accuracy: ', CAST(CAST(round_even(CAST(s AS DOUBLE) / n * 100, 0) AS BIGINT) AS VARCHAR), '% (', CAST(s AS VARCHAR), '/', CAST(n AS VARCHAR), ' claims supported)', chr(10)),
      CASE WHEN bad IS NOT NULL THEN concat('CONTRADICTED CLAIMS:', chr(10), bad) END, CASE WHEN unk IS NOT NULL THEN concat(chr(10), 'UNVERIFIABLE CLAIMS:', chr(10), unk) END,
      CASE WHEN s > 0 THEN concat(chr(10), 'SUPPORTED: ', CAST(s AS VARCHAR), ' claims verified') END) AS report FROM g""",
)
def _(spark, sf):
    kind = F.col("event_type")
    c = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("report_id"), F.col("event_id").alias("pos"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("claim"),
        F.when(kind == "view", "contradicted").when(kind == "error", "unverifiable").otherwise("supported").alias("verdict"), F.lit("e").alias("evidence"),
    )
    return R.claim_text(c)
