"""Main text of web pages, with the templates of each site removed.

A page is cut into tags and texts once; every element gets the hash of its subtree (tag, class, id, role and text of everything in it).
Spark counts, per host, on how many pages each subtree stands; a subtree on at least MIN_PAGES pages and SHARE of the host's pages is
template and goes; so does a box (any element but running text and inline ones) on MANY_PAGES pages, however large the host. Pages of a host with the same content (their text before anything is known of templates) count as one page there, so copies
of a page don't make its text template. Inside the landmark that marks the content (article, main) its running text - paragraphs, headings,
lists, quotes, tables - is never template, however often it recurs, and neither is a wrapper that holds most of it. Elements that say what they are (nav, header, footer, aside, form, scripts, or a class, id
or role such as menu, sidebar, advert, cookie notice, comments) go in any case, as they may be another one on every page. A name never takes a landmark or what the landmark
stands in, unless it names comments or lists of other articles; nor running text inside a landmark; and a name that sorts the page (category-legal, tag-social) is none. If a
page has a landmark with text, its text is the result, with the heading (h1) before it if it has none of its own, else the rest of the body.

Per host at most (subtrees of a page / SHARE) subtrees can be template, and boxes of a page for each MANY_PAGES pages, so a host's list is small. The lists are sent to the tasks if their
counted size allows; else the pages meet them by host and a part of the host.

A null or empty page gives an empty text. Bytes that end inside a tag end the page there. A null url is a host of its own. Pages are judged
row by row, also when ids or urls repeat. Extra columns are ignored.
"""

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from civicledger.session import stored

from .textarrays import slices

MIN_PAGES = 5
SHARE = 0.25
#: pages that make a box template on a host of any size
MANY_PAGES = 1000
#: hashes that may be sent to all tasks; beyond it pages meet their host's list by a join dealt over SALTS parts of each host
SENT_HASHES = 1_000_000
SALTS = 64

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe noembed noframes xmp".split())
#: elements whose text is no content
_DROP = set("head script style noscript template iframe object svg math canvas audio video nav header footer aside form button select option input textarea label fieldset dialog menu map".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: running text that is content wherever it stands in a landmark
_PROSE = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption".split()) | _INLINE
_LANDMARK = set("article main".split())
#: open elements that the start of the key closes
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_BOUND = set("ul ol dl table td th div section article main aside nav header footer form body html blockquote figure".split())
#: words of class, id and role that name what is not content
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|footer|foot|header|masthead|toolbar|"
    r"cookies?|consent|notices?|notifications?|alerts?|popup|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|comment-list|"
    r"respond|disqus|replies|pagination|pager|search|skip|copyright|legal|disclaimer|complementary|contentinfo|navigation|dialog|alertdialog|form)(?:$|[\s_-])", re.I)
#: names of classes that sort a page or its kind and say nothing of a part's purpose
_SORTED = re.compile(r"(?:^|\s)(?:category|categories|cat|tags?|topic|type|post_type|format|status|section|lang)[-_]\S*", re.I)
#: names of parts that hold landmarks of their own which are not the page's content
_OTHERS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-list|respond|disqus|replies|related|recommend\w*|sidebar\w*|widget\w*|promo\w*|sponsor\w*|ads?|advert\w*)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*$|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Element:
    __slots__ = ("tag", "names", "children", "drop", "by_name", "inside")

    def __init__(self, tag, names="", drop=False, by_name=False, inside=False):
        self.tag, self.names, self.children, self.drop, self.by_name, self.inside = tag, names, [], drop, by_name, inside


def parse(page):
    """The tree of a page: elements and decoded texts."""
    root = Element("#")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(html.unescape(text))
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag in _BOUND or tag == "p" and stack[k].tag in _BOUND:
                    break
            continue
        if tag == "html":
            continue
        if tag not in _INLINE and tag not in _RAW:
            _close(stack, {"p"}, _BOUND)
        if tag in _CLOSES:
            _close(stack, _CLOSES[tag], {"ul", "ol", "dl", "table"} if tag != "body" else ())
        if tag in _LANDMARK:  # content never stands inside the site's own parts, unless those are named as comments and the like
            for k in range(1, len(stack)):
                if stack[k].tag in ("nav", "head", "header", "footer", "aside", "form"):
                    del stack[k:]
                    break
        names, drop, by_name = "", tag in _DROP, False
        if m[3]:
            found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(m[3])}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            purpose = _SORTED.sub(" ", names)
            if tag in _LANDMARK:
                by_name = tag != "main" and _OTHERS.search(purpose) is not None
            elif tag not in ("body", "html"):
                by_name = _NAMED.search(purpose) is not None and not (tag in _PROSE and stack[-1].inside)
            drop = drop or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        if tag in _LANDMARK and not by_name:  # what holds the content is not taken by its name
            for outer in reversed(stack):
                if outer.tag in _LANDMARK and not outer.by_name:
                    break  # what holds that one was looked at then
                if outer.by_name and not _OTHERS.search(_SORTED.sub(" ", outer.names)):
                    outer.drop = outer.by_name = False
        element = Element(tag, names, drop or by_name, by_name and not drop, stack[-1].inside or tag in _LANDMARK)
        stack[-1].children.append(element)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in _VOID and not m[3].rstrip().endswith("/") or tag in _LANDMARK:
            stack.append(element)
    return root


def _close(stack, tags, bounds):
    """Closes the innermost open element with one of the tags, if nothing of bounds stands between."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in bounds:
            return


def subtree_hashes(root):
    """{id of an element: hash of its subtree}, dropped ones not looked into; texts count without their white space's shape.

    The least bit tells boxes from running text and inline elements.
    """
    out, todo = {}, [(root, False)]
    while todo:
        e, ready = todo.pop()
        if e.drop:
            out[id(e)] = 0
        elif not ready:
            todo.append((e, True))
            todo.extend((c, False) for c in e.children if isinstance(c, Element))
        else:
            parts = [e.tag, e.names]
            for c in e.children:
                parts.append(" ".join(c.split()) if isinstance(c, str) else str(out[id(c)]))
            out[id(e)] = (xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)) & ~1 | (e.tag not in _PROSE)
    return out


def content_wrappers(root):
    """The ids of the elements in landmarks that hold more than half of their landmark's running text, or of all its text if none of it runs."""
    sizes, order, todo = {}, [], [(root, None, False)]
    while todo:
        e, landmark, runs = todo.pop()
        if e.tag in _LANDMARK:
            landmark, runs = e, False
        elif landmark and e.tag in _PROSE:
            runs = runs or e.tag not in _INLINE
        order.append((e, landmark))
        own = sum(len("".join(c.split())) for c in e.children if isinstance(c, str)) if landmark else 0
        sizes[id(e)] = [own if runs else 0, own]
        todo.extend((c, landmark, runs) for c in e.children if isinstance(c, Element) and not c.drop)
    for e, _ in reversed(order):  # children before their parents
        for c in e.children:
            if isinstance(c, Element) and not c.drop:
                for k in (0, 1):
                    sizes[id(e)][k] += sizes[id(c)][k]
    out = set()
    for e, landmark in order:
        if landmark and e is not landmark:
            k = 0 if sizes[id(landmark)][0] else 1
            if 2 * sizes[id(e)][k] > sizes[id(landmark)][k]:
                out.add(id(e))
    return out


def candidates(root):
    """Hashes of the subtrees that may be template, each once."""
    hashes, wrappers, found = subtree_hashes(root), content_wrappers(root), set()
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        for c in e.children:
            if isinstance(c, Element) and not c.drop:
                within = inside or c.tag in _LANDMARK
                if c.tag != "body" and c.tag not in _LANDMARK and not (inside and c.tag in _PROSE) and id(c) not in wrappers and _has_text(c):
                    found.add(hashes[id(c)])
                todo.append((c, within))
    return found


def _has_text(e):
    todo = [e]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Element):
                todo.append(c)
            elif not c.isspace():
                return True
    return False


def main_text(root, template=frozenset()):
    """The blocks' texts, joined by one blank each."""
    hashes, wrappers = (subtree_hashes(root), content_wrappers(root)) if template else (None, ())

    def blocks(start, only):
        """Texts of blocks below start; only: those in landmarks."""
        out, own = [], []
        todo = [(start, False, False)]
        while todo:
            e, inside, over = todo.pop()
            if isinstance(e, str):
                if inside or not only:
                    own.append(e)
                continue
            if over:
                out.append("".join(own))
                own.clear()
                continue
            if e.drop or hashes and hashes[id(e)] in template and e is not start and not (e.tag in _LANDMARK or inside and e.tag in _PROSE or id(e) in wrappers or e.tag == "body"):
                own.append(" ") if e.tag in _INLINE else todo.append((e, inside, True))
                continue
            inside = inside or e.tag in _LANDMARK
            if e.tag in ("br", "wbr", "hr", "img"):
                own.append("" if e.tag == "wbr" else " ")
                continue
            if e.tag not in _INLINE:
                out.append("".join(own))
                own.clear()
                todo.append((e, inside, True))
            todo.extend((c, inside, False) for c in reversed(e.children))
        out.append("".join(own))
        return " ".join(t for t in (" ".join(b.split()) for b in out) if t)

    content = blocks(root, True)
    if not content:
        return blocks(root, False)
    heading = _heading_before(root, lambda e: hashes is not None and hashes.get(id(e)) in template)
    return " ".join(t for t in (blocks(heading, False) if heading else "", content) if t)


def _heading_before(root, is_template):
    """The last h1 before the first landmark, unless a landmark has one itself."""
    last, seen, todo = None, False, [(root, False)]
    while todo:
        e, inside = todo.pop()
        if e.tag == "h1":
            if inside:
                return None
            if not seen:
                last = e
        inside = inside or e.tag in _LANDMARK
        seen = seen or inside
        todo.extend((c, inside) for c in reversed(e.children) if isinstance(c, Element) and not c.drop and (inside or not is_template(c)))
    return last


def host_of(url):
    """The host of a URL, lower-case, without a leading www. or the port; the empty string without one."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def site_templates(pages, page="html", url="url", min_pages=MIN_PAGES, share=SHARE, many_pages=MANY_PAGES):
    """(host, template): the hashes of each host's recurring subtrees."""

    def subtrees(batches):
        for part in slices(batches, page):
            content, subtrees = [], []
            for p in part.column(1).to_pylist():  # one tree at a time
                root = parse(p or "")
                content.append(xxhash.xxh3_64_intdigest(main_text(root)) - (1 << 63))
                subtrees.append([0, *sorted(candidates(root))])  # a page counts itself by the subtree 0
            yield pa.record_batch([part.column(0), pa.array(content, pa.int64()), pa.array(subtrees, pa.list_(pa.int64()))], names=["host", "content", "subtrees"])

    found = pages.select(host_of(F.col(url)).alias("host"), page).mapInArrow(subtrees, "host string, content bigint, subtrees array<bigint>")
    counts = (found.select("host", "content", F.explode("subtrees").alias("subtree")).distinct()
              .groupBy("host", "subtree").agg(F.count("*").alias("n")).where((F.col("subtree") == 0) | (F.col("n") >= min_pages)))
    counts = stored(counts, "subtree-counts")
    of_host = counts.where("subtree = 0").select("host", F.col("n").alias("host_pages"))
    many = (F.col("n") >= many_pages) & (F.col("subtree").bitwiseAND(F.lit(1)) == 1)
    return counts.where("subtree <> 0").join(of_host, "host").where((F.col("n") >= share * F.col("host_pages")) | many).groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract(pages, id_column="page_id", url="url", page="html", min_pages=MIN_PAGES, share=SHARE, many_pages=MANY_PAGES):
    """One row per row of pages: its id, url, text, n_chars."""
    templates = site_templates(pages, page, url, min_pages, share, many_pages)
    templates = stored(templates, "site-templates")
    rows = pages.select(F.col(id_column), F.col(url), F.col(page), host_of(F.col(url)).alias("site host"))
    if (templates.agg(F.sum(F.size("template"))).first()[0] or 0) <= SENT_HASHES:
        rows = rows.join(F.broadcast(templates), F.col("site host") == F.col("host"), "left")
    else:  # a host may have very many pages
        parts = templates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("page part", F.pmod(F.xxhash64(id_column, url), F.lit(SALTS)).cast("int"))
        rows = rows.join(parts, (F.col("site host") == F.col("host")) & (F.col("page part") == F.col("part")), "left")
    rows = rows.select(id_column, url, page, "template")
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_column, url))

    def texts(batches):
        for part in slices(batches, page):
            out = [main_text(parse(p or ""), frozenset(t or ())) for p, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.record_batch([*part.columns[:2], pa.array(out, pa.string()), pa.array(np.array([len(t) for t in out], dtype=np.int64))], names=[id_column, url, "text", "n_chars"])

    return rows.mapInArrow(texts, f"{kinds}, text string, n_chars bigint")
