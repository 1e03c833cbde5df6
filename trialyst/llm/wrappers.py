"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream (block tags and texts) is a regular expression without any choice. Expressions of
the same host are aligned one after the other: equal tags match and are aligned inside; a tag that only
one side has becomes an optional group, neighbouring repeats of a group become one repeated group, and
texts that differ become a slot. What remains is the host's wrapper. The wrapper's content nodes are its
outermost article and main parts, or else the smallest node that holds all texts that differ between
pages (all texts, if none does); page parts that serve as menus,
headers, footers, sidebars, notices, adverts, forms or comments never count, also where they hold articles of their own. A page's text is what stands
in its content nodes, block by block.

Alignment is associative in effect, so each task folds its own pages, and the folds of a host meet in
two steps, salted first: a host of any size is never in one task page by page. Pages are read whole; the
wrapper table is stored, so that Spark sees its size before it chooses the join.

Null html counts as empty and has an empty text. A null or malformed url has the empty host. A page that has
none of its host's content nodes is its own wrapper. Repeated rows have a result each; other columns are left
out. Tags nested deeper than `DEPTH` are read as part of their parent; no text is lost by it.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import os.path
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialyst.llm.common import column, stored

DEPTH = 120
SALTS = 32
#: Wrappers that one task holds before it hands them on.
HELD = 256
#: Repeated groups of up to so many neighbours.
GROUP = 4

# Fixed values of HTML.
BLOCKS = frozenset(
    "html head body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset address details summary center hr dialog menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg iframe object select button canvas annotation annotation-xml".split())
CLOSES = {
    **{t: {"p"} for t in BLOCKS - {"html", "body", "head"}},
    "li": {"p", "li"},
    "dt": {"p", "dt", "dd"},
    "dd": {"p", "dt", "dd"},
    "tr": {"p", "td", "th", "tr"},
    "td": {"p", "td", "th"},
    "th": {"p", "td", "th"},
    "body": {"p", "head"},
}
#: Elements that an implied end tag doesn't reach beyond.
SCOPES = frozenset("html body main article section div table ul ol dl td th blockquote form aside nav header footer".split())
ASIDE_TAGS = frozenset("head nav footer aside form dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Classes and ids of parts that aren't main text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations trending comment "
    "comments commentlist disqus reply replies respond widget toolbar pagination pager copyright login search skip hidden".split()
)
#: Longer names of such parts, whole.
ASIDE_NAME = re.compile(
    r"(?:ads?|adsense|advert)[-_].+|(?:site|page|main|global|top|bottom|left|right|primary|secondary)[-_](?:nav|navbar|navigation|menu|footer|masthead|sidebar|banner|breadcrumbs?)"
    r"|(?:sponsor|sponsored|promo|promotion|banner|sidebar|nav|navbar|navigation|menu|breadcrumbs?|footer|cookies?|consent|gdpr|newsletter|subscribe|share|sharing|social|related|comments?|widget|toolbar|pagination|search|login)"
    r"[-_](?:[0-9]+|left|right|top|bottom|box|bar|banner|list|links|buttons?|icons?|form|area|block|notice|popup|modal|posts|articles|section)"
)
#: Parts that hold articles of others; only `main` within shows that they don't.
OTHERS = frozenset("related recommended recommendations trending comment comments commentlist disqus reply replies respond".split())
#: Beginnings and ends of compound names of parts inside an article that aren't its text, if they hold less than half of it.
MINOR_WORDS = frozenset(
    "comment comments reply replies ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe related recommended "
    "recommendations trending sidebar breadcrumb breadcrumbs popup".split()
)
MINOR_NAME = re.compile(r"ads?(?:box|slot|unit|wrap|wrapper|container|banner|block|space|zone)|more[-_](?:stories|posts|articles|news|reading)")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    """An element with blocks of text and elements in page order."""

    __slots__ = ("aside", "key", "kids", "minor", "named", "tag")

    def __init__(self, tag: str, key: str, aside: bool, named: str = "", minor: bool = False):
        self.tag, self.key, self.aside, self.named, self.minor = tag, key, aside, named, minor
        self.kids: list[Node | str] = []


def _named(tag: str, attributes: str) -> tuple[str, bool, str, bool]:
    """A key that equal parts of different pages share, whether the part isn't main text, the name that alone says so, and whether a
    name says so inside an article."""
    aside = tag in ASIDE_TAGS
    if not attributes.strip(" \t\n/"):
        return tag, aside, "", False
    named = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
    names = (named.get("class", "") + " " + named.get("id", "")).lower()
    words = re.findall(r"[a-z]+", names)
    by_name = ""
    if tag not in ("html", "body", "main"):
        aside = aside or "hidden" in named or named.get("aria-hidden") == "true"
        found = [x for x in names.split() if x in ASIDE_WORDS or ASIDE_NAME.fullmatch(x)]
        by_name = min(found, key=lambda x: x not in OTHERS, default="")
    role = named.get("role", "").lower()
    aside = aside or role in ASIDE_ROLES
    by_name = "" if aside else by_name
    aside = aside or by_name != ""
    key = ".".join([tag, *sorted(set(words))[:4], *([role] if role else [])])
    minor = not aside and any(MINOR_NAME.fullmatch(x) or len(y := re.split("[-_]+", x)) > 1 and (y[0] in MINOR_WORDS or y[-1] in MINOR_WORDS) for x in names.split())
    return key, aside, by_name, minor


def parse(html: str) -> Node:
    """The tree of block elements; inline tags vanish, unless they mark a part that isn't main text."""
    root = Node("", "", False)
    stack, said, at = [root], [], 0
    beyond: list[str] = []  # open tags deeper than DEPTH
    held: list[tuple[int, bool, list[Node]]] = []  # of articles and mains: asides around, whether an article, those that only a name marks
    minors: list[tuple[Node, Node]] = []  # with the article or main around

    def flush() -> None:
        text = " ".join(entities.unescape("".join(said)).split())
        said.clear()
        if text:
            stack[-1].kids.append(text)

    while True:
        m = TOKEN.search(html, at)
        said.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            if tag in beyond:
                while beyond.pop() != tag:
                    pass
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    flush()
                    del stack[i:]
                    beyond.clear()
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            said.append(" ")
            continue
        if tag == "br":
            said.append(" ")
        block = tag in BLOCKS
        key, aside, by_name, minor = _named(tag, m[3]) if block or m[3] else (tag, False, "", False)
        around = [n for n in stack if n.tag in ("article", "main")]
        minor = minor and bool(around)
        if not block and not aside and not minor:
            continue
        flush()
        if tag == "header":  # a page's header; an article's own holds its title
            aside = aside or not any(n.tag == "article" for n in stack)
        closes = CLOSES.get(tag, ())
        if beyond:
            if beyond[-1] in closes:
                beyond.pop()
            if tag not in VOID:
                beyond.append(tag)
            continue
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in closes:
                del stack[i:]
                break
            if stack[i].tag in SCOPES:
                break
        # td and tr may both end: a row ends the cell and the row before it
        if tag == "tr" and stack[-1].tag == "tr":
            stack.pop()
        if tag in VOID:
            continue
        if len(stack) > DEPTH:
            beyond.append(tag)
            continue
        node = Node(tag, key, aside, by_name, minor)
        if minor:
            minors.append((node, around[-1]))
        stack[-1].kids.append(node)
        stack.append(node)
        if tag in ("article", "main"):
            for n in stack:
                n.minor = False
            asides = [n for n in stack if n.aside]
            if all(n.named and (tag == "main" or re.split("[-_]", n.named)[0] not in OTHERS) for n in asides):
                held.append((len(asides), tag == "article", asides))
    flush()
    # A name doesn't make the holder of the page's text an aside: only if all articles stand in such, the outermost come out, mains first.
    least = min((h[:2] for h in held), default=None)
    for h in held:
        if h[:2] == least:
            for n in h[2]:
                n.aside = False
    for node, around in minors:
        node.aside = node.aside or node.minor and 2 * mass(node) < mass(around)
    return root


def mass(node: Node) -> int:
    """Characters of the text in a node, without parts that aren't main text."""
    return sum(len(k) if isinstance(k, str) else 0 if k.aside else mass(k) for k in node.kids)


# A wrapper item: k key, o optional, r repeated, n characters, s digest of a constant text ("" for a slot), c items;
# v in what only some pages have. The digest of repeats within a page is that of their digests.


def expression(node: Node) -> dict:
    """A page's own expression."""
    items = []
    for kid in node.kids:
        if isinstance(kid, str):
            items.append({"k": "#", "o": 0, "r": 0, "n": len(kid), "s": hashlib.blake2b(kid.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest(), "c": []})
        elif not kid.aside:
            items.append(expression(kid))
    return {"k": node.key, "o": 0, "r": 0, "n": 0, "s": "", "c": folded(items)}


def matched(a: dict, b: dict, within: bool = False) -> dict:
    """Two items of the same key as one; `within` a page repeats are no slots yet."""
    said = a["s"] if a["s"] == b["s"] else ""
    if within and a["s"] and b["s"]:
        said = hashlib.blake2b((a["s"] + b["s"]).encode(), digest_size=6).hexdigest()
    made = {"k": a["k"], "o": a["o"] | b["o"], "r": a["r"] | b["r"], "n": a["n"] + b["n"], "s": said, "c": aligned(a["c"], b["c"], within)}
    return made | {"v": 1} if "v" in a or "v" in b else made


def aligned(a: list[dict], b: list[dict], within: bool = False) -> list[dict]:
    """The shortest common order of two item lists; what only one has becomes optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["k"] == b[j]["k"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    alone = {"o": 1} if within else {"o": 1, "v": 1}
    while i < n or j < m:
        if i < n and j < m and a[i]["k"] == b[j]["k"]:
            out.append(matched(a[i], b[j], within))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i] | alone)
            i += 1
        else:
            out.append(b[j] | alone)
            j += 1
    return folded(out)


def folded(items: list[dict]) -> list[dict]:
    """Neighbouring repeats of one item or of a group of items as one repeated item."""
    for size in range(1, GROUP + 1):
        out: list[dict] = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * size and [x["k"] for x in out[-size:]] == [x["k"] for x in out[-2 * size : -size]]:
                last = out[-size:]
                del out[-size:]
                out[-size:] = [matched(x, y, True) | {"r": 1} for x, y in zip(out[-size:], last, strict=True)]
        items = out
    return items


def content_nodes(wrapper: dict) -> list[list[str]]:
    """For each content node, the keys from the wrapper's root down to it."""
    semantic: list[list[str]] = []
    varied: list[list[str]] = []
    said: list[list[str]] = []

    def mass(item: dict) -> int:
        return item["n"] if item["k"] == "#" else sum(mass(c) for c in item["c"])

    def walk(item: dict, path: list[str], inside: bool, some: bool) -> None:
        tag = item["k"].split(".")[0]
        if not inside and (tag in ("article", "main") or item["k"].endswith((".article", ".main"))) and mass(item):
            inside = True
            if path not in semantic:
                semantic.append(path)
        for c in item["c"]:
            apart = some or "v" in c
            if c["k"] != "#":
                walk(c, [*path, c["k"]], inside, apart)
            elif c["n"]:
                said.append(path)
                if apart or not c["s"]:
                    varied.append(path)

    walk(wrapper, [], False, False)
    if semantic:
        return semantic
    paths = varied or said
    # The smallest and the greatest path share what all share.
    return [os.path.commonprefix([min(paths), max(paths)])] if paths else [[]]


def blocks(node: Node) -> list[str]:
    out = []
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(kid)
        elif not kid.aside:
            out += blocks(kid)
    return out


def at_paths(root: Node, paths: list[list[str]]) -> list[Node]:
    """The nodes at these paths in page order, none inside another."""
    if [] in paths:
        return [root]
    found = []
    for kid in root.kids:
        if isinstance(kid, Node) and not kid.aside and (left := [p[1:] for p in paths if p[0] == kid.key]):
            found += at_paths(kid, left)
    return found


def main_text(html: str, paths: list[list[str]] | None) -> str:
    """Blocks of the content nodes, joined by line ends."""
    root = parse(html)
    nodes = at_paths(root, paths) if paths is not None else []
    if not any(blocks(n) for n in nodes):
        nodes = at_paths(root, content_nodes(expression(root)))
    return "\n".join(b for n in nodes for b in blocks(n))


def _wrapped(batches):
    """(host, html) into (host, wrapper): the fold of a task's pages."""
    held: dict[str, dict] = {}
    names = ["host", "wrapper"]
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = expression(parse(page.as_py()))
            held[host] = matched(held[host], own) if host in held else own
        if len(held) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()])], names=names)
            held = {}
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()])], names=names)


def _met(finish: bool):
    """Rows (host, salt, wrapper), sorted by host and salt, folded into one for each pair."""

    def run(batches):
        key, held = None, None
        out: list = []

        def done() -> None:
            if key is not None:
                out.append((key[0], json.dumps(content_nodes(held) if finish else held)))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()), pa.array([w for _, w in out], pa.string())], names=["host", "path" if finish else "wrapper"])
            out.clear()
            return made

        for batch in batches:
            for host, salt, wrapper in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = json.loads(wrapper)
                if (host, salt) == key:
                    held = matched(held, own)
                else:
                    done()
                    key, held = (host, salt), own
            yield batch_of()
        done()
        yield batch_of()

    return run


def content_paths(pages: DataFrame) -> DataFrame:
    """(host, paths as JSON) for every host of (host, html)."""
    parts = pages.select("host", "html").mapInArrow(_wrapped, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    first = salted.select("host", "salt", "wrapper").repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    met = first.mapInArrow(_met(False), "host string, wrapper string").withColumn("salt", F.lit(0).cast("bigint"))
    last = met.select("host", "salt", "wrapper").repartition("host").sortWithinPartitions("host", "wrapper")
    return last.mapInArrow(_met(True), "host string, path string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""
    own = pages.select(
        column(pages, id_col).alias(id_col),
        column(pages, url_col).alias(url_col),
        F.lower(F.coalesce(F.regexp_extract(column(pages, url_col), HOST, 1), F.lit(""))).alias("host"),
        F.coalesce(column(pages, html_col).cast("string"), F.lit("")).alias("html"),
    )
    paths = stored(content_paths(own), "content-paths")
    joined = own.join(paths.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left").select(id_col, url_col, "path", "html")

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), json.loads(p) if p else None) for page, p in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    shape = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string"
    return joined.mapInArrow(run, shape).withColumn("n_chars", F.length("text").cast("long"))
