"""Main text of web pages by a site style tree (operator 5).

The DOMs of a host are merged into one tree. Its nodes are chains of block elements with their classes and ids,
apart for the inside of articles and for presentation. A node that shows text has an importance from 0 to 1,

    prior * (LAYOUT * presentation + (1 - LAYOUT) * content).

Presentation: the entropy, to base m, of the child sequences that its parent has on the m different pages that show it; a
container that all pages lay out alike counts 0. Content: 1 minus the mean entropy, to base m, of the node's texts over
these pages: a text that one page alone shows has entropy 0, one that all show 1. Prior: 1, or WEAK for presentation by its
markup, which are elements, roles and class names of menus, headers, footers, sidebars, notices, adverts, forms and
comments, with all below them; and for all outside the page's main content. A class name counts as such
only if every word of it is one of NOISE_WORDS or STRUCTURE: side-effects and comments-on-war are content.

Some markup decides by what it holds. The main content is what stands in article and main elements that have text; but where
several of them stand beside a longer story (more prose outside links and lists in one container outside them than in all
of them) they are cards, and what stands outside is the main content. A block whose class speaks of related texts or search
(LINKED_WORDS) is presentation only if half of its characters or more are in links or lists. The id of a heading is an anchor and says nothing. A form that has most of the
page's characters besides other presentation is the frame of the page and no presentation; labels of its fields are.

Branches of low importance are removed from each page; of a branch whose prior is 1 only the texts that are of low
importance themselves, so that what few pages show never goes with its node. A heading stays if the block after it does.
A branch on fewer than PAGES different pages has content and presentation 1. Inside articles the bounds are stricter.

Pages are different by their main content: the texts of the node that has most characters on the page. Mirrors that
differ only in title, menu or advert are one page. The contexts in which a text is shown are counted
by that too, less the text itself.

Counts are aggregated before they are joined; neither a host's pages nor its nodes are gathered in one task. A page drops
presentation at once, as WEAK is below every bound; its texts are looked up in the tree.

Defined cases: a null html is an empty one and gives the empty text. A null url is the host ''. Null ids and repeated
rows give their own rows. An unclosed element ends with its parent, a tag cut by the end of the page is dropped.
A line break element is white space. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import salted_join, stage, table

#: Prior of presentation, and the weight of presentation in an importance.
WEAK, LAYOUT = 0.2, 0.25
#: Least importance of a branch and the different pages that must show it; and the same inside an article.
LEAST, PAGES, LEAST_INSIDE, PAGES_INSIDE = 0.3, 4, 0.15, 12

#: Fixed values of HTML: elements that begin and end blocks, void elements, raw text, and elements that a tag closes.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Presentation without importance: elements, roles, and words of class names and ids.
NOISE = set("nav footer aside menu dialog head select button svg object audio video canvas fieldset label legend".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login search social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond reactions pagination pager toolbar widget widgets skip hidden".split())
#: Those of them that name presentation only where links are.
LINKED_WORDS = set("related recommended recommendations search".split())
#: Words that a class name of presentation may hold beside them.
STRUCTURE = set("area articles bar block bottom box button buttons column container form global group icon icons inner item items left link links list main module outer page panel posts primary right row secondary section site slot thread top unit wrap wrapper".split())
CONTENT = {"article", "main"}
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are no prose when the longest story outside of articles is looked for.
LISTED = HEADING | set("li dt dd td th option".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"']+)""")
_WORD = re.compile(r"[a-zA-Z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END_OF_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


#: Kinds of an element: content, a form, presentation if it holds links, presentation.
NONE, FORM, LINKS, CLEAR = range(4)


def _kind_of(name: str) -> int:
    """The kind that a class name or id gives; it must be one of presentation in all its words."""
    words = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", name))]
    noise = [w for w in words if w in NOISE_WORDS]
    if not noise or not all(w in NOISE_WORDS or w in STRUCTURE for w in words):
        return NONE
    return LINKS if LINKED_WORDS.issuperset(noise) else CLEAR


@lru_cache(maxsize=10_000)
def _style(tag: str, raw: str) -> tuple[str, int]:
    """Name of an element in the tree, and its kind."""
    noise = CLEAR if tag in NOISE else FORM if tag == "form" else NONE
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return tag, noise
    name = tag
    for m in _ATTRIBUTE.finditer(raw):
        key = (m[1] or m[5]).lower()
        value = next((v for v in m.group(2, 3, 4) if v is not None), "")
        if key in ("class", "id"):
            value = unescape(value)
            words = sorted(w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value)))
            name += f"{'.' if key == 'class' else '#'}{' '.join(words)}"
            if tag not in ("html", "body") and (key == "class" or tag not in HEADING):
                noise = max([noise, *map(_kind_of, value.split())])
        elif key == "role":
            role = value.strip().lower()
            noise = max(noise, CLEAR if role in NOISE_ROLES else FORM if role == "form" else NONE)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            noise = CLEAR
    # A form for a search, or a part of a line that is named so.
    return name, CLEAR if noise == LINKS and (tag == "form" or tag not in BLOCK) else noise


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class _Open:
    """An open element: its tag, node, clear presentation, number of its article and of its outermost form and box of links (0: none), inside a link, and the names of its children (of its block, if it is inline)."""

    __slots__ = ("tag", "node", "parent", "noise", "article", "form", "box", "link", "kids")

    def __init__(self, tag: str, node: int, parent: int, noise: bool, article: int, form: int, box: int, link: bool, kids: list[str]):
        self.tag, self.node, self.parent, self.noise, self.article, self.form, self.box, self.link, self.kids = tag, node, parent, noise, article, form, box, link, kids


class _Block(NamedTuple):
    """A text: its node, that one's parent, presentation, inside an article, in a heading; what decides on the main content; characters in links."""

    node: int
    parent: int
    noise: bool
    inside: bool
    heading: bool
    text: str
    article: int
    form: int
    box: int
    listed: bool
    linked: int


def _decided(found: list[_Block]) -> list[_Block]:
    """The blocks, with presentation by forms and boxes of links settled by what they hold."""
    clear = [b for b in found if not b.noise]
    if not any(b.form or b.box for b in clear):
        return found
    size, linked = Counter(), Counter()
    for b in clear:
        if b.box:
            size[b.box] += len(b.text)
            linked[b.box] += len(b.text) if b.listed and not b.heading else b.linked
    gone = {k for k, n in size.items() if 2 * linked[k] >= n}
    rest = [b for b in clear if b.box not in gone]
    forms = Counter()
    for b in rest:
        forms[b.form] += len(b.text)
    gone_forms = {k for k, n in forms.items() if k and 2 * n <= forms.total()}
    return [b._replace(noise=b.noise or b.box in gone or b.form in gone_forms) for b in found]


def _cards(found: list[_Block]) -> bool:
    """Whether the articles are cards beside a longer story."""
    clear = [b for b in found if not b.noise]
    if len({b.article for b in clear if b.article}) < 2:
        return False
    outside, inside = Counter(), 0
    for b in clear:
        own = len(b.text) - b.linked if not b.listed else 0
        if b.article:
            inside += own
        else:
            outside[b.parent] += own
    return max(outside.values(), default=0) > inside


def parse(html: str) -> tuple[list[_Block], dict[int, list[str]]]:
    """Every block in page order; and the child sequences of nodes."""
    out: list[_Block] = []
    layouts: dict[int, list[str]] = {0: []}
    stack = [_Open("", 0, 0, False, 0, 0, 0, False, layouts[0])]
    held: list[str] = []
    linked = opened = 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                top = stack[-1]
                block = next((e.tag for e in reversed(stack) if e.tag in BLOCK), "")
                out.append(_Block(top.node, top.parent, top.noise, top.article > 0, block in HEADING, text, top.article, top.form, top.box, block in LISTED, min(linked, len(text))))
            linked = 0

    def close(index: int):
        flush()
        del stack[index:]

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        begin = m.start() if m else size
        if begin > at:
            part = html[at:begin]
            held.append(unescape(part) if "&" in part else part)
            if stack[-1].link:
                linked += len(held[-1])
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in BLOCK or any(e.tag in BLOCK for e in stack[k:]) or stack[k].noise != stack[k - 1].noise or stack[k].form != stack[k - 1].form:
                        close(k)
                    else:
                        del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "article", "main", "section", "div", "nav", "aside", "footer", "header", "form", "body") and tag not in BLOCK:
                    break  # a stray end of an inline element closes nothing outside
            continue
        if tag in RAW:
            end = _END_OF_RAW[tag].search(html, at)
            at = (html.find(">", end.start()) + 1 or size) if end else size
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            # A block ends an open paragraph, and items end their like within their list.
            ends = CLOSED_BY.get(tag)
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].tag
                if open_tag == "p" or open_tag == "head" and tag != "head" or ends and open_tag in ends:
                    close(k)
                elif open_tag in BLOCK and not (ends and open_tag not in SCOPE[tag]):
                    break
            flush()
        raw = m[3] or m[6] or ""
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        above = stack[-1]
        name, kind = _style(tag, raw)
        opened += 1
        # A heading group inside an article belongs to it.
        own = kind == CLEAR or tag == "header" and not above.article
        noise, link = above.noise or own, above.link or tag == "a"
        article = above.article or (opened if tag in CONTENT and not own else 0)
        form, box = above.form or (opened if kind == FORM else 0), above.box or (opened if kind == LINKS else 0)
        if own and not above.noise or form != above.form or box != above.box:
            flush()
        if tag not in BLOCK:
            stack.append(_Open(tag, above.node, above.parent, noise, article, form, box, link, above.kids))
            continue
        above.kids.append(name)
        # Presentation and the inside of articles are branches of their own.
        node = _hash(f"{above.node}/{name}/{noise:d}{article > 0:d}")
        stack.append(_Open(tag, node, above.node, noise, article, form, box, link, layouts.setdefault(node, [])))
        stack[-1].kids.append("<")
    flush()
    return _decided(out), layouts


def blocks(html: str) -> list[tuple[int, bool, str]]:
    """(node, inside an article, text) of every block that is not presentation by its markup, in page order."""
    return [(b.node, b.inside, b.text) for b in parse(html)[0] if not b.noise]


_BLOCK = pa.struct([("node", pa.int64()), ("weak", pa.bool_()), ("inside", pa.bool_()), ("heading", pa.bool_()), ("layout", pa.int64()), ("feature", pa.int64()), ("context", pa.int64()), ("text", pa.string())])
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("rid", pa.int64()), ("host", pa.string()), ("page", pa.int64()), ("blocks", pa.list_(_BLOCK))])
PARSED = "page_id long, url string, rid long, host string, page long, blocks array<struct<node:bigint,weak:boolean,inside:boolean,heading:boolean,layout:bigint,feature:bigint,context:bigint,text:string>>"


def describe(html: str) -> tuple[int, list[tuple]]:
    """A page's main content as a hash, and its blocks in page order as rows for the tree."""
    found, layouts = parse(html)
    article, cards = any(b.inside and not b.noise for b in found), _cards(found)
    weak = [b.noise or article and b.inside == cards for b in found]
    size: Counter[int] = Counter()
    for b, w in zip(found, weak):
        if not w:
            size[b.node] += len(b.text)
    main = max(size, key=size.get, default=None)
    texts = [(b.text, _hash(b.text)) for b, w in zip(found, weak) if not w and b.node == main]
    whole = _hash(" ".join(str(h) for _, h in texts))
    shapes = {k: _hash("/".join(v)) for k, v in layouts.items()}
    rows = []
    for (node, parent, _, inside, heading, text, *_), w in zip(found, weak):
        feature = 0 if w else _hash(text)
        # What else the main content holds; for a text outside of it that is all of it.
        context = 0 if w else _hash(" ".join(str(h) for t, h in texts if t != text)) if node == main else whole
        rows.append((node if not w else _hash(f"{node}/weak"), w, inside and not w, heading, shapes[parent], feature, context, None if w else text))
    return whole, rows


def _describer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = []
            for page_id, url, html, rid in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "rid"))):
                page, found = describe(html or "")
                rows.append((page_id, url, rid, host_of(url), page, [dict(zip(_BLOCK.names, b)) for b in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARSED)], schema=_PARSED)


NODE = ["host", "node"]


def merged_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The host's nodes that show text (host, node, weak, inside, m, rows, texts, importance), and their texts (host, node, feature, k, rows)."""
    b = parsed.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.*")
    shown = b.groupBy(*NODE, "weak", "inside", "layout", "page").agg(F.count("*").alias("rows")).groupBy(*NODE, "weak", "inside", "layout").agg(F.count("*").alias("c"), F.sum("rows").alias("rows"))
    nodes = shown.groupBy(*NODE, "weak", "inside").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.ln("c")).alias("spread"), F.sum("rows").alias("rows"))
    own = b.where("not weak").groupBy(*NODE, "feature", "context").agg(F.count("*").alias("rows"))
    texts = stage(own.groupBy(*NODE, "feature").agg(F.count("*").alias("k"), F.sum("rows").alias("rows")), "op5-texts", compact=True)
    content = texts.groupBy(*NODE).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("e"), F.count("*").alias("texts"))
    enough = F.col("m") >= F.when(F.col("inside"), PAGES_INSIDE).otherwise(PAGES)
    presentation = F.when(enough, 1 - F.col("spread") / F.col("m") / F.ln("m")).otherwise(1.0)
    own_content = F.when(enough & ~F.col("weak"), 1 - F.col("e") / F.col("n") / F.ln("m")).otherwise(1.0)
    importance = F.when(F.col("weak"), WEAK).otherwise(1.0) * (LAYOUT * presentation + (1 - LAYOUT) * own_content)
    return nodes.join(content, NODE, "left").select(*NODE, "weak", "inside", "m", "rows", "texts", importance.alias("importance")), texts


def unimportant(parsed: DataFrame) -> DataFrame:
    """The texts of a node (host, node, feature, rows) to remove from a host's pages.

    Presentation is not among them: its prior alone is below every bound, so a page drops it without a look at the tree.
    """
    nodes, texts = merged_tree(parsed.withColumn("blocks", F.filter("blocks", lambda b: ~b["weak"])))
    least = F.when(F.col("inside"), LEAST_INSIDE).otherwise(LEAST)
    low = stage(nodes.where(F.col("importance") < least).select(*NODE, "m", "inside", "texts"), "op5-low", compact=True)
    return stage(salted_join(texts, low, NODE, "feature", "texts").where(1 - F.ln("k") / F.ln("m") < least).select(*NODE, "feature", "rows"), "op5-gone", compact=True)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_removed) for every row of pages (page_id, url, html).

    n_blocks: the blocks that are left; n_removed: those that went, presentation by markup included.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(F.col("page_id").cast("long"), "url", "html").alias("rid"))
    parsed = stage(pages.mapInArrow(_describer, PARSED), "op5-parsed")
    rows = parsed.select("rid", "host", F.posexplode("blocks").alias("at", "b")).where("not b.weak").select("rid", "host", "at", "b.node", "b.feature")
    hit = salted_join(rows, unimportant(parsed), [*NODE, "feature"], "rid", "rows")
    # Staged, so that the join below knows the size: the pages are shuffled only if many of them lose something.
    gone = stage(hit.groupBy(F.col("rid").alias("of")).agg(F.collect_set("at").alias("gone")), "op5-hit", compact=True)  # blocks of one page
    joined = parsed.join(gone, F.col("rid") == F.col("of"), "left")
    left = lambda i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)) & ~block(i)["weak"]
    block = lambda i: F.get("blocks", i)
    # A heading that the tree removes stays with the block after it.
    stays = lambda i: left(i) | ~block(i)["weak"] & block(i)["heading"] & (i + 1 < F.size("blocks")) & left(i + 1)
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("blocks"), F.lit(1)) - 1), lambda i: (i < F.size("blocks")) & stays(i))
    kept = joined.select("page_id", "url", F.size("blocks").alias("all"), F.transform(at, lambda i: block(i)["text"]).alias("texts"))
    text = F.array_join("texts", "\n")
    return kept.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("texts").cast("long").alias("n_blocks"), (F.col("all") - F.size("texts")).cast("long").alias("n_removed"))


def op5_site_style_tree(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
