"""Text extraction, trimming and classification as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and phrases the results depend on
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NON_WS = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
BUG_WORDS = (
    r"(?:BUG|FIXME|TODO|XXX|bug|Bug|[Mm]issing|[Ii]ncorrect|[Ww]rong|"
    r"[Oo]ff.?by|[Ss]hould be|\b[Ff]ix\b|[Bb]uggy)"
)
ERROR_LABELS = [
    ("SyntaxError", "SyntaxError: code could not be parsed"),
    ("AssertionError", "AssertionError: one or more test assertions failed"),
    ("TimeoutError", "TimeoutError: code raised a timeout internally"),
    ("NameError", "NameError: undefined name referenced"),
    ("TypeError", "TypeError: wrong type or argument count"),
]
UNKNOWN_ERROR = "Unknown runtime error"
PASS_PHRASES = [
    "VERDICT: PASS",
    "VERDICT** PASS",
    "VERDICT**: PASS",
    "**VERDICT**: PASS",
    "**VERDICT:** PASS",
]
MARKERS_TO_TAGS = [
    ("<|think|>", "<think>"),
    ("<|/think|>", "</think>"),
    ("<|startofthought|>", "<think>"),
    ("<|endofthought|>", "</think>"),
]
TAGS_TO_MARKERS = [("<think>", "<|think|>"), ("</think>", "<|/think|>")]
TOOL_BLOCK = r"(?s)<tool_call>[\s]*(\{.*?\})[\s]*</tool_call>"
SEED_TAG_REPLACEMENTS = [
    ("_geom", ""),
    ("paperfig_hard", "fig"),
    ("slides_hard2", "slides"),
    ("anim_clean", "anim"),
    ("web_hard", "web"),
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_c(col), rf"^{WS}+|{WS}+\z", "")


def rstrip(col) -> Column:
    return F.regexp_replace(_c(col), rf"{WS}+\z", "")


def head(col, n: int | None) -> Column:
    return _c(col) if n is None else F.substring(_c(col), 1, n)


def keep_tail(col, n: int) -> Column:
    return F.right(_c(col), F.lit(n))


def tail_lines(col, n: int) -> Column:
    """The last n lines of the trimmed text."""
    lines = F.split(strip(col), "\r\n|\n|\r")
    start = F.greatest(F.size(lines) - n + 1, F.lit(1))
    return F.array_join(F.slice(lines, start, F.lit(n)), "\n")


def _fence(lang: str) -> str:
    return rf"(?s)```{lang}{WS}*\n(.*?)```"


def extract_code(col, lang: str = "python") -> Column:
    """First fence with the language tag, else first bare fence, else all text."""
    c = _c(col)
    tagged, bare = _fence(lang), _fence("")
    return strip(
        F.when(c.rlike(tagged), F.regexp_extract(c, tagged, 1))
        .when(c.rlike(bare), F.regexp_extract(c, bare, 1))
        .otherwise(c)
    )


def extract_last_code(col, lang: str = "python", closing_newline: bool = False) -> Column:
    """Content of the last tagged fence, null if there is none."""
    pattern = rf"(?s)```{lang}{WS}*\n(.*?)" + ("\n```" if closing_newline else "```")
    found = F.regexp_extract_all(_c(col), F.lit(pattern), 1)
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))


def extract_artifact(text, category) -> Column:
    """Last Python fence of code tasks, last HTML fence of all others."""
    return F.when(_c(category) == "code", extract_last_code(text, "python")).otherwise(
        extract_last_code(text, "html")
    )


def described_code(col) -> Column:
    """Body of the first Python fence in a description, null if there is none."""
    c, pattern = _c(col), r"(?s)```python\n(.*?)```"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def extract_function(col, name: str) -> Column:
    """A function by name: header and 4-space body, else its one-line form."""
    c = _c(col)
    block = rf"(?d)(def {name}{WS}*\(.*?\n(?:(?:    .*|)\n)*+)"
    line = rf"(?d)(def {name}{WS}*\(.*?:.*)"
    return rstrip(
        F.when(c.rlike(block), F.regexp_extract(c, block, 1)).when(c.rlike(line), F.regexp_extract(c, line, 1))
    )


def truncate_middle(col, limit: int) -> Column:
    """Cut out the middle so that the whole stays within the limit."""
    c = _c(col)
    size = F.length(c)
    note = F.concat(F.lit("\n\n... [truncated "), (size - limit).cast("string"), F.lit(" chars] ...\n\n"))
    half = F.floor((F.lit(limit) - F.length(note)) / 2).cast("int")
    return (
        F.when(size <= limit, c)
        .when(half > 0, F.concat(F.substring(c, F.lit(1), half), note, F.right(c, half)))
        .otherwise(head(c, limit))
    )


def trim_note(col, limit: int) -> Column:
    """Keep the head and say how many characters follow."""
    c = _c(col)
    rest = F.format_number(F.length(c) - limit, 0)
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(head(c, limit), F.lit("\n\n… [truncated, "), rest, F.lit(" more characters]"))
    )


def scrub(col) -> Column:
    """Remove comments that give a bug away, then squeeze blank lines.

    Both patterns are anchored at line starts and look for the first # only:
    a bug word after any later # also follows the first one. So each line is
    read once, however long it is.
    """
    whole_line = rf"(?mdU)^{WS}*+#[^\n]*{BUG_WORDS}[^\n]*$\n?"
    inline = rf"(?mdU)^(?=[^\n#]*+#)([^\n#]*{NON_WS}){WS}*+#[^\n]*{BUG_WORDS}[^\n]*"
    c = F.regexp_replace(_c(col), whole_line, "")
    c = F.regexp_replace(c, inline, "$1")
    return F.regexp_replace(c, "\n\n\n+", "\n\n")


def desc_signature(col, chars: int | None = None) -> Column:
    """Lower case, white space collapsed to single blanks; the whole text
    unless ``chars`` cuts it."""
    return head(F.regexp_replace(F.lower(_c(col)), rf"{WS}+", " "), chars)


def convert_markers(col, target: str = "tags") -> Column:
    """Reasoning markers from one spelling to the other."""
    c = _c(col)
    for old, new in MARKERS_TO_TAGS if target == "tags" else TAGS_TO_MARKERS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def classify_error(col) -> Column:
    """Label of the dominant error, else the last non-blank line."""
    c = _c(col)
    lines = F.filter(
        F.transform(F.split(c, "\r\n|\n|\r"), lambda x: strip(x)), lambda x: F.length(x) > 0
    )
    out = F.when(c.contains(ERROR_LABELS[0][0]), ERROR_LABELS[0][1])
    for mark, label in ERROR_LABELS[1:]:
        out = out.when(c.contains(mark), label)
    return out.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(UNKNOWN_ERROR)


def strip_tool_calls(col) -> Column:
    return strip(F.regexp_replace(_c(col), TOOL_BLOCK, ""))


def is_pass_verdict(col) -> Column:
    """Exact pass phrases, else PASS and no REVISE in the 60 characters after
    the first VERDICT."""
    up = F.upper(_c(col))
    hit = F.lit(False)
    for phrase in PASS_PHRASES:
        hit = hit | up.contains(phrase)
    at = F.instr(up, "VERDICT")
    after = F.substring(up, at + len("VERDICT"), F.lit(60))
    return hit | ((at > 0) & after.contains("PASS") & ~after.contains("REVISE"))


def has_final(col) -> Column:
    return _c(col).rlike(rf"(?i)<final>{WS}*OK{WS}*</final>")


def title_case(col) -> Column:
    """Capital after every non-letter, digits included."""
    parts = F.regexp_extract_all(_c(col), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(head(p, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def nice_name(task_id, name, paper, category) -> Column:
    """First given of name, paper and category, else the id made readable."""
    given = [F.nullif(_c(c), F.lit("")) for c in (name, paper, category)]
    rest = F.regexp_replace(_c(task_id), r"^[^_]*_", "")
    return F.coalesce(*given, title_case(F.replace(rest, F.lit("_"), F.lit(" "))))


def seed_tag(col) -> Column:
    c = _c(col)
    for old, new in SEED_TAG_REPLACEMENTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def flatten_content(text, parts) -> Column:
    """Message content as text: a string as it is, else its text parts by line."""
    texts = F.transform(F.filter(_c(parts), lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.coalesce(_c(text), F.array_join(texts, "\n"))


def with_reasoning(text, reasoning, cap: int | None = None) -> Column:
    """Put the reasoning, whole or capped, in a think block before the content."""
    r, t = _c(reasoning), _c(text)
    block = F.concat(F.lit("<think>\n"), rstrip(r if cap is None else head(r, cap)), F.lit("\n</think>\n\n"), t)
    return F.when(F.length(r) > 0, block).otherwise(t)


def shorten_fences(col, lines: int = 8) -> Column:
    """Keep the first lines of every Python or HTML fence inside a text."""
    line = r"(?:(?!```)[^\n])*+"
    short = rf"((?:{line}\n){{0,{lines - 1}}}?{line})\n?```"
    long = rf"((?:{line}\n){{{lines - 1}}}{line})\n(?s:.*?)```"
    return F.regexp_replace(
        _c(col), rf"```(python|html)\n(?:{short}|{long})", "```$1\n$2$3\n... [code truncated]\n```"
    )


def percent(col) -> Column:
    """A share as a whole percentage, ties to the even number."""
    return F.concat(F.bround(_c(col).cast("double") * 100, 0).cast("bigint").cast("string"), F.lit("%"))
