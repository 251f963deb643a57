"""Operator 10: main text of web pages by a site style tree.

Every page is parsed into its block elements; the whole DOMs of a host are merged
on the path of block tags (with class and id). For every merged node two entropies
say how much it matters, as in the site style tree:

* content: 1 - mean over its features (block texts) of ln(pages with the feature) / ln(pages);
* presentation: entropy of its child-tag sequences over the pages, to base pages;

composite = (1 - g^l) * presentation + g^l * content, l being the number of
different sequences. Nodes that say the same on almost every page score near 0
and their branches are removed from each page.

A node's information is the sum over its texts of length times the text's term of
the content entropy. The host's region is the deepest inner node that holds more
than half of the whole tree's information: such nodes lie on one path. What a page
says outside the region is presentation (menus, adverts and footers whose words
differ from page to page, which no entropy gives away). A page without that node
keeps all of it.

Declared roles come on top: navigation, header outside the article, footer, aside,
form, or a class or id that is such a name (``ad``, ``sidebar``, ``comments``,
``notice``) have no information and go. If a page has an ``article`` or ``main``
element, that element decides the region. A heading ``h1`` outside the region stays.
A class or id is only a hint: an element that has one but holds more than half of
what could be the page's main text is judged by the style tree like any other.
``roles=False`` leaves all this to the tree, to measure what it does alone.

Sibling leaves of one path (all bare ``p`` of an article) are aligned by what they
say: a block's own importance is its term of the content entropy, 1 - ln(pages with
this text at this path) / ln(pages with the path), and a repeated block goes alone.

Copies of a page would make its article look repeated, so pages of a host with
the same sequence of blocks count once. Hosts with fewer than ``MIN_PAGES`` such
pages are merged into one tree of all small hosts, copies across hosts counted once
too; a node needs ``MIN_PAGES`` pages before it or a block of it can be removed.

The statistics pass carries hashes only, the second pass parses again with the
few removed nodes of the page's host: page texts are never stored. A removed block
is on more than m^0.9 of the m pages of its node, so a node of pages with L blocks
has fewer than L * m^0.1 of them. The removals of all hosts are broadcast if they
are small; else pages and removals meet by host and salt.

Defined results: null or empty html gives empty text; unclosed, misnested and
cut-off markup is repaired the usual way (a ``p`` ends at the next block); null
url has the empty host; repeated rows give repeated results; other columns are
ignored.
"""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravis.llm.common import land, table
from gravis.llm.registry import register

MIN_PAGES = 8
LEAST_IMPORTANCE = 0.1
GAMMA = 0.9
REGION = 0.5  # share of the information that a region exceeds; below a half there could be two
SALTS = 16  # parts of a host's pages where the removals are too many to broadcast
SMALL_DROPS = 100_000  # removed nodes and blocks that are broadcast: paths are cut at MAX_PATH characters
MAX_PATH = 200

# Fixed values of HTML: elements by their role.
RAW = "script|style|title|textarea|noscript|iframe|xmp|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
BLOCK = CLOSES_P | frozenset("body caption dd dt li tbody td tfoot th thead tr html".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th")}
SCOPE_END = frozenset("ul ol dl table body html article section div td".split())
NOISE_TAGS = frozenset("nav footer aside form head button select option svg object menu dialog template math canvas "
                       "audio video label fieldset".split())
NOISE_NAMES = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    r"comments?|commentary|replies|disqus|respond|notices?|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommend\w*|widget|pagination|pager|skip|search|toolbar|tags?", re.I)
MAIN_TAGS = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<raw>" + RAW + r")\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def blocks_of(page: str, roles: bool = True) -> list[tuple[str, bool, bool, str]]:
    """(path, inside main, declared not to be main text, text) of every block with
    text, in page order. Without ``roles`` nothing is declared."""
    out: list[tuple[str, bool, bool, str]] = []
    stack: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, 0)]  # tag, path, noise, main, named
    named = [0]  # per block: the outermost element with a noise name it lies in, counted from 1
    hint: list[int] = []
    text: list[str] = []
    unread = 0  # depth of the stack where a form control begins

    def flush() -> None:
        if text:
            t = " ".join("".join(text).split())
            text.clear()
            if t:
                _, path, noise, main, inside = stack[-1]
                out.append((path, main, noise, t))
                hint.append(inside)

    def pop_to(i: int) -> None:
        nonlocal unread
        del stack[i:]
        unread = unread if unread < i else 0

    for m in _TOKEN.finditer(page):
        chunk = m["text"]
        if chunk is not None:
            if not unread:
                text.append(html_lib.unescape(chunk) if "&" in chunk else chunk)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue  # comment, declaration, raw element or cut-off tag
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                text.append(" ")
                continue
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in BLOCK or at:
                flush() if tag in BLOCK else None
                if at and (tag in BLOCK or tag in NOISE_TAGS or at == len(stack) - 1 or not any(
                        s[0] in BLOCK for s in stack[at + 1:])):
                    pop_to(at)
            continue
        attr = m["attr"] if m["attr"] is not None else (m["attr2"] or "")
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        names = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(attr)} if "=" in attr else {}
        label = " ".join(v for k, v in names.items() if k != "role")
        noise = roles and (tag in NOISE_TAGS or names.get("role", "") in (
            "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog"))
        by_name = roles and any(NOISE_NAMES.fullmatch(x) or x.lower() == "header" and not stack[-1][3] for x in label.split())
        if tag not in BLOCK:
            if (noise or by_name) and not attr.rstrip().endswith("/"):  # other inline elements do not shape the tree
                stack.append((tag, stack[-1][1], stack[-1][2], stack[-1][3], stack[-1][4]))
                unread = unread or len(stack) - 1
            continue
        flush()
        if tag in CLOSES_P:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", "td", "li", "div", "article")), 0)
            if at and stack[at][0] == "p":
                pop_to(at)
        for other in SIBLING.get(tag, ()):
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == other or stack[i][0] in SCOPE_END), 0)
            if at and stack[at][0] == other:
                pop_to(at)
        _, path, in_noise, in_main, inside = stack[-1]
        main = in_main or roles and (tag in MAIN_TAGS or names.get("role") == "main")
        noise = (noise and tag not in MAIN_TAGS and tag not in ("body", "html")) or (roles and tag == "header" and not in_main)
        mark = tag + "".join(f".{x}" for x in sorted(label.split()))
        if tag in ("html", "body"):
            path = ""
        elif main and not in_main:
            path = "main"  # the tree below the main element is merged wherever it stands
        else:
            path = f"{path}>{mark}" if path else mark
            if len(path) > MAX_PATH:  # deep below: the path's hash stands for it
                path = f"#{_hash(path):x}"
        if not inside and by_name and tag not in MAIN_TAGS and tag not in ("body", "html"):
            named.append(0)
            inside = len(named) - 1
        stack.append((tag, path, in_noise or noise, main, inside))
    flush()
    in_main = any(b[1] and not b[2] for b in out)
    for (_, main, noise, t), x in zip(out, hint):
        if not noise and (main or not in_main):
            named[x] += len(t)
    total = sum(named)
    return [(path, main, noise or in_main and not main or bool(x) and 2 * named[x] <= total, t)
            for (path, main, noise, t), x in zip(out, hint)]


def parse(page: str) -> list[tuple[str, bool, str]]:
    """(path, inside main, text) of every block that is not declared noise, in page order."""
    return [(path, main, t) for path, main, declared, t in blocks_of(page) if not declared]


def _branches(path: str) -> list[str]:
    """Nodes a block belongs to, outermost first; the root is the empty path."""
    parts = path.split(">") if path else []
    return [">".join(parts[:n]) for n in range(len(parts) + 1)]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _features(page: str, roles: bool) -> list[tuple[str, int, int, bool, int]]:
    """(node, feature, key of the page's blocks, is presentation, information at most)
    of a page, distinct. For presentation the last is 1 if the node is an inner one."""
    blocks = blocks_of(page, roles)
    told = [t for _, _, declared, t in blocks if not declared]
    if not told:
        return []
    h = _hash
    key = h("\n".join(told))  # a block has no line break
    seen: dict[tuple[str, int], int] = {}
    shape: dict[str, list[str]] = {}
    for path, _, declared, t in blocks:
        f, size = h(t), 0 if declared else len(t)
        for node in _branches(path):
            seen[node, f] = max(size, seen.get((node, f), 0))
            below = (path[len(node) + 1:] if node else path).split(">", 1)[0] if len(path) > len(node) else "#"
            kids = shape.setdefault(node, [])
            if not kids or kids[-1] != below:
                kids.append(below)
    return [(node, f, key, False, size) for (node, f), size in seen.items()] + [
        (node, h("/".join(kids)), key, True, int(kids != ["#"])) for node, kids in shape.items()]


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


POOL = ""  # the tree of all small hosts; pages without a host are one of them


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES, roles: bool = True) -> DataFrame:
    """Merged nodes of ``pages`` (_host, _html): host (or ``POOL``), node, feature,
    n_pages, importance, information, inner. Feature is null for a node as a whole, else
    the hash of a text that at least half of ``min_pages`` pages have at the node."""
    def run(batches):
        for pdf in batches:
            rows = [(host, *f) for host, page in zip(pdf["_host"], pdf["_html"]) for f in _features(page or "", roles)]
            yield pd.DataFrame(rows, columns=["host", "node", "feature", "page_key", "style", "size"])
    found = pages.select("_host", "_html").mapInPandas(
        run, "host string, node string, feature long, page_key long, style boolean, size int")
    found = land(found.distinct())  # one page per sequence of blocks
    large = land(found.where((F.col("node") == "") & F.col("style") & (F.col("host") != POOL)).groupBy("host").agg(
        F.count("*").alias("pages")).where(F.col("pages") >= min_pages).select("host"))
    keyed = ["node", "style", "feature"]
    of_large = found.join(large, "host", "left_semi").groupBy("host", *keyed).agg(
        F.count("*").alias("c"), F.max("size").alias("size"))
    pooled = found.join(large, "host", "left_anti").groupBy(*keyed, "page_key").agg(F.max("size").alias("size")).groupBy(
        *keyed).agg(F.count("*").alias("c"), F.max("size").alias("size")).select(F.lit(POOL).alias("host"), *keyed, "c", "size")
    per_feature = land(of_large.unionByName(pooled))
    # every page with a node has exactly one presentation of it, so those counts add up to the pages
    style = F.col("style")
    per_node = per_feature.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("c"))).alias("m"),
        F.count(F.when(style, 1)).alias("l"),
        F.max(F.when(style, F.col("size"))).alias("inner"),
        F.sum(F.when(style, F.col("c") * F.log("c"))).alias("style_sum"),
        F.sum(F.when(~style, F.col("c") * F.log("c"))).alias("text_sum"),
        F.sum(F.when(~style, F.col("c") * F.col("size"))).alias("chars"),
        F.sum(F.when(~style, F.col("c") * F.col("size") * F.log("c"))).alias("chars_sum"),
        F.sum(F.when(~style, F.col("c"))).alias("texts"))
    many, ln_m = F.col("m") > 1, F.log(F.col("m").cast("double"))
    presentation = F.when(many, 1 - F.col("style_sum") / F.col("m") / ln_m).otherwise(1.0)
    content = F.when(many, 1 - F.col("text_sum") / F.col("texts") / ln_m).otherwise(1.0)
    information = F.when(many, F.col("chars") - F.col("chars_sum") / ln_m).otherwise(F.col("chars"))
    share = F.pow(F.lit(GAMMA), F.col("l"))
    nodes = per_node.select("host", "node", F.lit(None).cast("long").alias("feature"), F.col("m").alias("n_pages"),
                            ((1 - share) * presentation + share * content).alias("importance"),
                            information.alias("information"), (F.col("inner") == 1).alias("inner"))
    # a block's own term of the content entropy, for texts on more than a few pages
    own = per_feature.where(~style & (F.col("node") != "") & (F.col("c") > 1) & (2 * F.col("c") >= min_pages)).join(
        per_node.select("host", "node", "m"), ["host", "node"])
    return nodes.unionByName(own.select("host", "node", "feature", F.col("m").alias("n_pages"),
                                        (1 - F.log("c") / ln_m).alias("importance")), allowMissingColumns=True)


def removals(tree: DataFrame, least: float = LEAST_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host of the tree: its region (null if none but the root) and what goes (nodes, and node with block hash)."""
    low = (F.col("importance") < least) & (F.col("n_pages") >= min_pages) & ~F.col("node").isin("", "main")
    # a block of the root or of the main element can go, these nodes as a whole can not
    low = low | (F.col("feature").isNotNull() & (F.col("importance") < least) & (F.col("n_pages") >= min_pages))
    whole = F.col("feature").isNull()
    total = tree.where(whole & (F.col("node") == "")).select("host", (F.col("information") * REGION).alias("_half"))
    item = F.concat_ws("\t", "node", F.col("feature").cast("string"))
    depth = F.struct((F.size(F.split("node", ">"))).alias("d"), "node")
    # total lists every host once; nodes of a host spread over tasks until they are grouped
    return tree.where(low | (whole & F.col("inner") & (F.col("node") != "") & (F.col("n_pages") >= min_pages))).join(
        total, "host", "right").groupBy("host").agg(
        F.max(F.when(whole & F.col("inner") & (F.col("information") > F.col("_half")), depth))["node"].alias("_region"),
        F.collect_set(F.when(low, item)).alias("_drop"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least: float = LEAST_IMPORTANCE, min_pages: int = MIN_PAGES, roles: bool = True) -> DataFrame:
    """Per row: id, url, text, n_chars. ``roles=False`` ignores what tags, roles and names declare."""
    pages = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"),
                      host_of(F.col(url_col)).alias("_host"))
    drop = land(removals(style_tree(pages, min_pages, roles), least, min_pages))
    pool = drop.where(F.col("host") == POOL).first()  # one host's few removals
    pool = (pool["_region"], pool["_drop"]) if pool else (None, [])
    drop = drop.where(F.col("host") != POOL)
    if (drop.agg(F.sum(F.size("_drop") + 1)).first()[0] or 0) <= SMALL_DROPS:
        met = pages.join(F.broadcast(drop), pages["_host"] == drop["host"], "left")
    else:
        drop = drop.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.withColumn("_part", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)).cast("int"))
        met = pages.join(drop, (pages["_host"] == drop["host"]) & (F.col("_part") == F.col("_salt")), "left")
    met = met.select("_id", "_url", "_html", "host", "_region", "_drop")
    kind = df.schema[id_col].dataType.simpleString()

    def text_of(page: str, region: str | None, gone: set[str]) -> str:
        blocks = [(path, _branches(path), t) for path, _, declared, t in blocks_of(page, roles) if not declared]
        has = region is not None and not path_in_main(blocks) and any(region in nodes for _, nodes, _ in blocks)
        return " ".join(t for path, nodes, t in blocks
                        if not (has and region not in nodes and not (roles and path.endswith("h1")))
                        and not (gone and (any(n in gone for n in nodes) or f"{path}\t{_hash(t)}" in gone)))

    def path_in_main(blocks) -> bool:
        return any(nodes[1:2] == ["main"] for _, nodes, _ in blocks) and roles

    def run(batches):
        for pdf in batches:
            texts = []
            for page, host, region, items in zip(pdf["_html"], pdf["host"], pdf["_region"], pdf["_drop"]):
                if host is None:
                    region, items = pool
                texts.append(text_of(page or "", region, set(items)))
            yield pd.DataFrame({"_id": pdf["_id"], "_url": pdf["_url"], "text": texts, "n_chars": [len(t) for t in texts]})
    return met.mapInPandas(run, f"_id {kind}, _url string, text string, n_chars long").select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


@register("op10_site_style_tree")
def op10_site_style_tree(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
