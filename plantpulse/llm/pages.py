"""Main text of web pages by a style tree per site."""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.arrow import map_rows
from plantpulse.session import pin

# Element names and role words: fixed values.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOISE_TAGS = frozenset("head script style noscript template iframe svg math canvas object nav footer aside form button select textarea input menu dialog".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related share "
    "sharing social cookie cookies notice consent popup modal newsletter subscribe subscription comment comments reply replies discussion respond form "
    "login signup search footer header masthead copyright legal toolbar topbar pager pagination complementary contentinfo".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that a class word never makes noise.
FIRM_TAGS = frozenset(("html", "body", *MAIN_TAGS))
MAIN_WORDS = frozenset("article main content post entry story articlebody".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[a-z]+")
#: Names that tell what a page has, not what the element is.
STATE = re.compile(r"(?:^|\s)(?:has|with|without|no|is)[-_]\S*")
SPACE = re.compile(r"\s+")

#: A branch stays when its weighed importance is at least this.
MIN_IMPORTANCE = 0.5
#: Prior weights of role words: the importance of a branch that is named as noise is multiplied by the first, so that it stays
#: only where nearly everything in it differs from page to page; the second is added below names of main text.
DOUBT_WEIGHT = 0.52
LIKELY_BONUS = 0.25
#: Share of the content in a branch's importance; the rest is the presentation of its children.
CONTENT_WEIGHT = 0.9
#: Pages that must have a branch before its importance counts; with fewer it is 1.
MIN_PAGES = 3

NOISE, DOUBT, OPEN, LIKELY, MAIN = range(5)


def host_of(url):
    """Lower-case host of a URL without port and user; null or no host: empty."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _role(tag: str, attributes: str, inside: int) -> int:
    """Role of an element within an element of role `inside`.

    NOISE and MAIN are stated by elements: MAIN are article, main and the plain elements of their text. DOUBT and LIKELY are
    priors that names give: DOUBT an element named as noise, LIKELY one named as main text and all below it, and elements in
    main text that have a name or are mere boxes.
    """
    if inside == NOISE or tag in NOISE_TAGS or (tag == "header" and inside < LIKELY):
        return NOISE
    own = {}
    for m in ATTRIBUTE.finditer(attributes):
        own[m[1].lower()] = (m[2] or m[3] or m[4] or "").lower()
    if re.search(r"\shidden(?:[\s=/]|$)", attributes) or "display:none" in own.get("style", "").replace(" ", ""):
        return NOISE
    words = set(WORD.findall(STATE.sub(" ", f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}")))
    if words & NOISE_WORDS and tag not in FIRM_TAGS:
        return DOUBT
    if tag in MAIN_TAGS:
        return MAIN
    if inside >= LIKELY:
        # An inline element is part of the sentence around it.
        plain = tag in INLINE or (inside == MAIN and tag not in ("div", "section") and not own.get("class") and not own.get("id"))
        return MAIN if plain else LIKELY
    return LIKELY if words & MAIN_WORDS and tag not in ("html", "body") else OPEN


def _label(tag: str, attributes: str) -> str:
    named = [m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id")]
    return ".".join([tag, *sorted(re.sub(r"[^a-z]+", "-", x.lower()) for x in named)])[:60]


def parse(page: str) -> tuple[list[tuple[int, str, str, int, int]], dict[str, tuple[str, str, int]]]:
    """Pieces of text (block, path, text, role, safe) in page order, and per path (presentation, content, role) of the page.

    `safe` is the length of the path at which the main text begins: no branch above takes the piece away; 0 if none. Main text
    does not begin inside an element of doubt, but with `main`.

    A path is the names of the elements from below the root down, with their classes; a page's elements of one path are
    one node. The presentation of a node is the run of names of its children, its content the text below it.
    """
    # The last is -1 in an element of doubt outside of main text.
    stack: list[tuple[str, str, int, int]] = []
    pieces: list[tuple[int, str, str, int, int]] = []
    below: dict[str, list[str]] = defaultdict(list)
    children: dict[str, list[str]] = defaultdict(list)
    roles: dict[str, int] = {}
    block, at = 0, 0

    def text(raw: str) -> None:
        if not raw:
            return
        own = SPACE.sub(" ", html.unescape(raw))
        path, role, safe = stack[-1][1:] if stack else ("", OPEN, 0)
        pieces.append((block, path, own, role, max(safe, 0)))
        for _, p, *_ in stack:
            below[p].append(own)

    def close(upto: int) -> None:
        nonlocal block
        if any(name not in INLINE for name, *_ in stack[upto:]):
            block += 1
        del stack[upto:]

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            held = [i for i, (name, *_) in enumerate(stack) if name == tag]
            if held and (tag not in INLINE or all(name in INLINE for name, *_ in stack[held[-1] :])):
                close(held[-1])
            continue
        if tag in CLOSES_P and (held := [i for i, (name, *_) in enumerate(stack) if name == "p"]):
            close(held[-1])
        if tag in SAME_CLOSES:
            held = [i for i, (name, *_) in enumerate(stack) if name in SAME_CLOSES[tag]]
            outer = max((i for i, (name, *_) in enumerate(stack) if name in ("ul", "ol", "dl", "table", "select")), default=-1)
            if held and held[-1] > outer:
                close(next(i for i in held if i > outer))
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            block += 1
        inside_path, inside, safe = stack[-1][1:] if stack else ("", OPEN, 0)
        label = _label(tag, m[3])
        path = label if tag == "html" or inside_path in ("", "html") else f"{inside_path}/{label}"
        children[inside_path].append(label)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        role = _role(tag, m[3], inside)
        if safe == 0 or (safe < 0 and tag == "main"):
            safe = len(path) if role >= LIKELY else -1 if role == DOUBT else 0
        stack.append((tag, path, role, safe))
        roles[path] = min(roles.get(path, MAIN), role)
    text(page[at:])
    nodes = {}
    for path, role in roles.items():
        style = "".join(x for i, x in enumerate(children[path]) if i == 0 or children[path][i - 1] != x)
        nodes[path] = (style, "".join(below[path]), role)
    return pieces, nodes


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """`page_id, url, host, pieces, nodes, tree`: a page's text pieces outside of noise, its nodes with hashed presentation and
    content, and a hash of all its nodes."""
    types = dict(pages.dtypes)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"page_id": batch.column("page_id"), "url": batch.column("url"), "host": batch.column("host"), "pieces": [], "nodes": [], "tree": []}
        for page in batch.column("html").to_pylist():
            pieces, nodes = parse(page or "")
            out["pieces"].append([{"block": b, "path": p, "text": t, "safe": safe} for b, p, t, role, safe in pieces if role != NOISE])
            out["nodes"].append([{"path": p, "style": _hash(s), "content": _hash(c), "role": role} for p, (s, c, role) in nodes.items()])
            out["tree"].append(_hash(repr([tuple(x.values()) for x in out["nodes"][-1]])))
        return out

    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    return map_rows(rows, f"page_id {types['page_id']}, url string, host string, pieces array<struct<block:int,path:string,text:string,safe:int>>, "
                          "nodes array<struct<path:string,style:long,content:long,role:int>>, tree long", run)


def style_tree(parsed: DataFrame) -> DataFrame:
    """`host, path, n_pages, presentation, content, importance, role` of every node of every site's style tree.

    The nodes of a path over all different pages of a host are merged; pages with the same tree count once. The importance of presentation is the entropy of the
    different runs of children over the pages, that of content the entropy of the different texts, both in parts of the
    greatest possible entropy: 0 when all pages have the same, 1 when all differ or when there are fewer than MIN_PAGES.
    """
    nodes = parsed.select("host", "tree", "nodes").dropDuplicates(["host", "tree"]).select("host", F.inline("nodes"))
    kinds = F.array(F.struct(F.lit("style").alias("kind"), F.col("style").alias("value")), F.struct(F.lit("content").alias("kind"), F.col("content").alias("value")))
    values = nodes.select("host", "path", "role", F.inline(kinds))
    counts = values.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("role"))
    weighted = F.sum(F.col("n") * F.log("n"))
    per = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), weighted.alias("w"), F.min("role").alias("role"))
    entropy = F.when(F.col("m") < MIN_PAGES, F.lit(1.0)).otherwise((F.log("m") - F.col("w") / F.col("m")) / F.log("m"))
    per = per.withColumn("e", entropy).groupBy("host", "path").agg(
        F.max("m").alias("n_pages"), F.max(F.when(F.col("kind") == "style", F.col("e"))).alias("presentation"),
        F.max(F.when(F.col("kind") == "content", F.col("e"))).alias("content"), F.min("role").alias("role"))
    return per.withColumn("importance", CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation"))


def main_text(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` for every row of `pages`.

    Elements such as `nav`, `form` and `footer` are noise, and `article` and `main` with their plain elements are main text.
    Every other branch, at any depth, stays when its importance in the site's style tree is at least MIN_IMPORTANCE; names
    of classes and ids only weigh the importance, and decide alone where a site has fewer than MIN_PAGES pages with the branch.
    `html` and `body` never go. A branch that goes leaves the main text inside it. Blocks stand in page order, one per line. Null and
    empty pages, and pages without main text, give an empty text; null and strange URLs are a site of their own; equal
    pages of a site count once; an empty table gives an empty result; other columns are not looked at.
    """
    parsed = pin(parsed_pages(pages))
    weighed = (F.when(F.col("role") == DOUBT, F.when(F.col("n_pages") < MIN_PAGES, 0.0).otherwise(DOUBT_WEIGHT * F.col("importance")))
               .when(F.col("role") == LIKELY, F.col("importance") + LIKELY_BONUS).otherwise(F.col("importance")))
    judged = F.col("role").isin(DOUBT, OPEN, LIKELY) & ~F.col("path").rlike(r"(^|/)(html|body)(\.[^/]*)?$")
    low = style_tree(parsed).filter(judged & (weighed < MIN_IMPORTANCE))
    # Written first: its size is then known, so Spark moves the pages by host only when it is large.
    removed = pin(low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("removed")))
    rows = parsed.select("page_id", "url", "host", "pieces").join(removed, "host", "left").select("page_id", "url", "pieces", "removed")
    types = dict(pages.dtypes)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts = []
        for pieces, gone in zip(batch.column("pieces").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            blocks: dict[int, list[str]] = defaultdict(list)
            cut = tuple(gone or ())
            places = {(p["path"], p["safe"]) for p in pieces} if cut else ()
            out = {(p, safe) for p, safe in places if any(len(g) >= safe and (p == g or p.startswith(g + "/")) for g in cut)}
            for p in pieces:
                if (p["path"], p["safe"]) not in out:
                    blocks[p["block"]].append(p["text"])
            lines = [SPACE.sub(" ", "".join(b)).strip() for _, b in sorted(blocks.items())]
            texts.append("\n".join(x for x in lines if x))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(rows, f"page_id {types['page_id']}, url string, text string, n_chars long", run)
