"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: element nodes with the same path of tags and class names are
one node of the host's tree, whose styles are the child sequences seen under it and whose contents
are the texts seen in it. A node's presentation importance is the entropy of its styles over the
pages, its content importance is one minus the mean entropy with which its texts spread over the pages
(logarithms to the base of the number of pages, as in the published method). They are put together
with weight GAMMA for the contents. Leaf blocks whose node has an importance of less than LEAST on the
host are left out on each page; so a branch goes if all its blocks go. A node made of links on all
pages counts as unimportant outside the article, however its links change.

What one page shows by itself is the tree's prior: elements that HTML or their class, id or role name
as menu, header, footer, sidebar, notice, advert, form or comments have no importance, and article
and main elements are kept once they have been found, because entropy says nothing on few pages.
Where a page marks an article or main element, blocks outside of it are kept only if their node is
important by the host's pages and no prior is against it. A host is compared over its distinct pages;
with one page every importance is one.

Null or empty html gives empty text. Pages without a url, or without a host in it, stand alone.
Unclosed and crossed tags are closed as browsers do, as far as text blocks need it. Repeated rows give
repeated results and count once in the tree. An empty table gives an empty result.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import known_size, stage
from .common import arrow_map, pick, strings

GAMMA, LEAST, LINKED = 0.9, 0.2, 0.8
#: Pages below which a host's tree says nothing.
PAGES = 3

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
BARE = re.compile(r"(?:^|\s)hidden(?=\s|/|$)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no markup; what they hold is no text of the page either.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav aside footer form button select option datalist fieldset dialog menu svg math canvas audio video object map".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th
thead tr ul caption""".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption".split())
#: A start tag closes open elements of these kinds, up to the ones after the bar.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
           "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"),
           "tfoot": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"),
           "option": ("option", "select")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: Words of class, id and role that name something other than the article.
PRIOR = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar
navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent notice notices
gdpr alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social related
recommended recommendations comment comments disqus respond reply replies pagination pager widget widgets skip complementary
contentinfo advertorial dialog tracking paywall""".split())
KEPT = frozenset(("article", "main"))


def host(url: str | None) -> str | None:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else None


class Branch:
    """An open element."""

    __slots__ = ("tag", "path", "gone", "kept", "children", "block")

    def __init__(self, tag, path, gone, kept, block):
        self.tag, self.path, self.gone, self.kept, self.block, self.children = tag, path, gone, kept, block, []


def _read(attrs: str) -> tuple[list[str], bool]:
    """Class names without digits, and whether class, id, role or style speak against the element."""
    names, gone = [], bool(BARE.search(ATTRIBUTE.sub("", attrs)))
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            if key == "class":
                names = sorted({re.sub(r"\d+", "", n) for n in value.split()} - {""})
            words = [w.lower() for w in WORD.findall(value)]
            gone = gone or any(w in PRIOR for w in words) and not any(w in KEPT for w in words)
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value == "true":
            gone = True
    return names, gone


def _branch(tag: str, attrs: str, above: Branch) -> Branch:
    names, gone = _read(attrs) if attrs and not attrs.isspace() else ([], False)
    kept = above.kept or tag in KEPT
    if tag in ("html", "body", "article", "main"):
        gone = False
    gone = above.gone or gone or tag in DROPPED or tag == "header" and not above.kept
    block = tag in BLOCK
    path = f"{above.path}/{'.'.join([tag, *names])}" if block else above.path
    return Branch(tag, path, gone, kept, block)


def blocks(html: str):
    """(text blocks, styles): blocks are (path, text, inside an article, share of linked characters) in
    page order without those that the prior leaves out; styles are (path, child sequence)."""
    out, styles = [], []
    root = Branch("", "", False, False, True)
    stack, text, linked, links = [root], [], 0, 0

    def flush():
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                owner = next(b for b in reversed(stack) if b.block)
                out.append((owner.path or "/", joined, owner.kept, min(1.0, linked / len(joined))))
            text, linked = [], 0

    def close():
        nonlocal links
        b = stack.pop()
        if b.tag == "a":
            links -= 1
        if b.block and not b.gone:
            styles.append((b.path, " ".join(b.children)))

    def close_to(tags, stop) -> None:
        """Close up to the innermost element of `tags`, unless one of `stop` stands before it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                if any(b.block for b in stack[i:]):
                    flush()
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in stop:
                return

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].gone:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(piece)

    at, scan = 0, TAG.search
    while m := scan(html, at):
        add(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                text.append(" ")
            elif tag == "p":
                close_to(("p",), ("td", "th", "table"))
            elif tag not in ("html", "body"):
                close_to((tag,), ("td", "th", "table", "article", "main", "body") if tag not in BLOCK else ())
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
            continue
        if tag in CLOSES_P:
            close_to(("p",), ("td", "th", "table", "button"))
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close_to((stack[-1].tag,), ())
        if tag in IMPLIED:
            close_to(*IMPLIED[tag])
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in ("html", "body") and any(b.tag == tag for b in stack):
            continue
        if tag in ("body", "article", "main") and any(b.tag == "head" for b in stack):
            close_to(("head",), ())
        new = _branch(tag, m[3], stack[-1])
        if new.block or new.gone and not stack[-1].gone and tag in DROPPED:
            flush()
        if new.block and not new.gone:
            for b in reversed(stack):
                if b.block:
                    if not b.children or b.children[-1] != new.path.rpartition("/")[2]:
                        b.children.append(new.path.rpartition("/")[2])
                    break
        stack.append(new)
        if tag == "a":
            links += 1
    add(html[at:])
    flush()
    while len(stack) > 1:
        close()
    return out, styles


def _name(path: str) -> int:
    return xxh3_64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63)


def tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance, linked): the merged tree of every host of pages (url, html).
    A task adds up what its pages hold; repeats of a page count once."""
    schema = "host string, page bigint, node bigint, parent bigint, kind int, what bigint, n bigint, linked double"

    def run(batches):
        for b in batches:
            rows = []
            for url, html in zip(strings(b, "url"), strings(b, "html")):
                site = host(url)
                if site is None or not html:
                    continue
                found, styles = blocks(html)
                page = _name(html)
                counts = Counter((path, text) for path, text, _, _ in found)
                share = {}
                for path, text, _, linked in found:
                    share.setdefault(path, []).append(linked)
                for (path, text), n in counts.items():
                    s = share[path]
                    rows.append((site, page, _name(path), _name(path.rpartition("/")[0]), 0, _name(text), n, sum(s) / len(s)))
                for (path, style), n in Counter(styles).items():
                    rows.append((site, page, _name(path), 0, 1, _name(style), n, 0.0))
            cols = list(zip(*rows)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["host", "page", "node", "parent", "kind", "what", "n", "linked"])

    rows = stage(arrow_map(pick(pages, "url", "html"), run, schema).distinct())
    # entropy of a text over the pages: log N - (sum of n log n) / N, to the base of the number of pages
    features = (rows.groupBy("host", "node", "parent", "kind", "what")
                .agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn")))
    size = (rows.where("kind = 0").groupBy("host", "node", "page").agg(F.first("linked").alias("linked"))
            .groupBy("host", "node").agg(F.count("*").alias("pages"), F.avg("linked").alias("linked")))
    content = (features.where("kind = 0").groupBy("host", "node", "parent")
               .agg(F.avg(F.log("all") - F.col("nlogn") / F.col("all")).alias("spread")))
    look = (features.where("kind = 1").groupBy(F.col("host"), F.col("node").alias("parent"))
            .agg(F.sum("all").alias("seen"), F.sum(F.col("all") * F.log("all")).alias("alogn"))
            .select("host", "parent", (F.log("seen") - F.col("alogn") / F.col("seen")).alias("styles")))
    base = F.log(F.greatest("pages", F.lit(2)))
    value = (F.lit(GAMMA) * (1 - F.least(F.lit(1.0), F.col("spread") / base))
             + F.lit(1 - GAMMA) * F.least(F.lit(1.0), F.coalesce("styles", F.lit(1.0)) / base))
    return (content.join(size, ["host", "node"]).join(look, ["host", "parent"], "left")
            .select("host", "node", "pages", F.when(F.col("pages") < PAGES, 1.0).otherwise(value).alias("importance"), "linked"))


def noise(nodes: DataFrame) -> DataFrame:
    """(host, noisy, menus): per host the nodes below LEAST and those made of links. Only what repeats
    over pages gets there, so a host's lists are as long as its page templates."""
    low = F.col("importance") < LEAST
    menu = (F.col("linked") >= LINKED) & (F.col("pages") >= PAGES)
    return (nodes.where(low | menu).groupBy("host")
            .agg(F.collect_list(F.when(low, F.col("node"))).alias("noisy"), F.collect_list(F.when(menu, F.col("node"))).alias("menus")))


def main_text(found: list, noisy: set[int], menus: set[int]) -> str:
    """The blocks of a page that its host's tree keeps."""
    marked = any(kept for _, _, kept, _ in found)
    names = {path: _name(path) for path, _, _, _ in found}
    keep = [text for path, text, kept, linked in found
            if names[path] not in noisy and (kept or not marked and names[path] not in menus)]
    return "\n\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    pages = pick(pages, "page_id", "url", "html")
    of_host = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    lists = known_size(noise(tree(pages)))
    joined = (pages.join(lists.withColumnRenamed("host", "_host"), of_host == F.col("_host"), "left")
              .select("page_id", "url", "html", "noisy", "menus"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            made = [main_text(blocks(html)[0], {*(noisy or ())}, {*(menus or ())}) if html else ""
                    for html, noisy, menus in zip(*(strings(b, n) for n in ("html", "noisy", "menus")))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return arrow_map(joined, run, f"page_id {kind}, url string, text string, n_chars bigint")
