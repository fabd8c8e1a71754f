"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements (by the path of tags and class names down to them) and its texts (by path and
words). A token's occurrence vector counts it on each page of its host. Tokens of one host with one vector form an
equivalence class; classes of at least CLASS tokens on at least PAGES pages, and on at least half of the host's,
are the template. They nest by path: a class whose tokens stand once on each page is the skeleton, the others repeat
within it. What is not a template token fills slots. The main region is the deepest skeleton element with MOST of the
host's slot text that is not boilerplate by name. An article (or main) element around the region, or the one within it,
is then taken whole; articles outside the region, and several that hold less than half of it, are not looked at.
Outside an article element, texts of the template itself (on nearly all of at least CONSTANT pages) are no slots and are
left out.

Vectors are not gathered anywhere: (host, token) rows are summed with map-side combination to the number of pages and
to two sums of hashes of (page, count), which are equal only for equal vectors, but for a chance of about 2**-60. So
a host with a third of all pages is spread like any other; templates are joined to pages, not pages grouped.

Pages of hosts without a template (fewer than PAGES pages, or pages unlike each other) are read by names alone.

Within the region, elements that are navigation, forms, scripts, adverts, notices, comments and so on by tag or by a
class, id or role of that name are left out, and groups of blocks by a word of a longer name ("related-posts"); headings
and paragraphs are not left out for a word of a longer name, nor groups in the main text for a word that often means else. Character references are decoded, white space within a block becomes one
space, and blocks are joined in page order by a line feed.

Defined cases: a null or empty html, or one without text, gives "" and 0; a page without a url has the host "";
broken markup is read as far as it goes (unclosed elements end with their parent, stray end tags are ignored);
repeated rows give repeated results, and equal pages count as one page of their host; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm import common

PAGES, CLASS, CONSTANT, MOST = 3, 3, 8, 0.8
#: HTML's void elements, raw-text elements, and elements that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIP = RAW | frozenset("nav aside footer form head button select svg object dialog menu canvas audio video input datalist".split())
#: Words of class, id and role that name what is no part of an article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead header comment comments reply replies disqus cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations trending pagination pager widget toolbar "
    "complementary contentinfo search skip".split()
)
#: Of these the ones that are as often part of another name: alone they name it, as a word of a longer name only outside the main text.
LOOSE = frozenset("banner masthead header alert notice notification social recommended widget toolbar skip search complementary promotion".split())
#: Elements that may hold several blocks: a word of a longer class name counts for these alone.
GROUP = frozenset("div section article main aside ul ol dl table figure details fieldset span".split())
HEADINGS = frozenset("html body h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("articlebody article-body post-content entry-content article-content post-body story-body main-content".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Node:
    __slots__ = ("chars", "key", "main", "path", "skip", "tag")

    def __init__(self, tag: str, path: str, skip: bool, main: bool):
        self.tag, self.path, self.skip, self.main = tag, path, skip, main


def _names(attributes: str) -> tuple[str, int, bool]:
    """Class names as written; how far they name boilerplate: 3 by a whole class, id or role, 2 by a word of one, 1 by a loose
    word, 0; and whether one names the main text."""
    label, out, main = "", 0, False
    for kind, *values in _NAMED.findall(attributes):
        value = "".join(values).lower()
        found = {w for w in _WORD.findall(value) if w in NAMES}
        out = max(out, 3 if any(x in NAMES for x in value.split()) else 2 if found - LOOSE else 1 if found else 0)
        main = main or any(w in ARTICLE for w in value.split()) or value == "main"
        if kind.lower() == "class":
            label = "." + ".".join(sorted(value.split()))
    return label, 0 if main else out, main


def events(page: str) -> Iterator[tuple[str, Node | None, str]]:
    """("open", node, ""), ("close", node, ""), ("text", parent, raw text) and ("break", parent, "") in page order."""
    stack: list[Node] = []
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            yield "text", stack[-1] if stack else None, page[at:end]
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(x.tag == tag for x in stack):
                while True:
                    node = stack.pop()
                    yield "close", node, ""
                    if node.tag == tag:
                        break
            continue
        if tag in BLOCK:
            # a block ends an open paragraph, an item the item before it
            closed = {"p"} | ({tag} if tag in ("li", "option", "tr", "td", "th", "dt", "dd") else set())
            inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in closed or stack[i].tag in BLOCK), None)
            if inner is not None and stack[inner].tag in closed and tag != "br":
                while len(stack) > inner:
                    yield "close", stack.pop(), ""
        if tag in VOID:
            if tag in BLOCK:
                yield "break", stack[-1] if stack else None, ""
            continue
        label, named, main = _names(m[3]) if m[3] else ("", 0, False)
        above = stack[-1] if stack else None
        within = any(x.main for x in stack)
        out = tag not in HEADINGS and (named == 3 or tag in GROUP and (named == 2 or named == 1 and not within))
        path = (above.path if above else "") + (f"/{tag}{label}" if tag in BLOCK or tag in SKIP else "")
        node = Node(tag, path, (above.skip if above else False) or tag in SKIP or out, main or tag in ("article", "main"))
        if tag == "header" and not within:
            node.skip = True
        if tag in RAW:
            close = _END[tag].search(page, at)
            at = close.start() if close else n
            node.skip = True
        stack.append(node)
        yield "open", node, ""
    while stack:
        yield "close", stack.pop(), ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def tokens(page: str) -> tuple[Counter, Counter]:
    """How often each token occurs, and the characters of text in each element that is not boilerplate."""
    count, chars, open_paths = Counter(), Counter(), []
    for kind, node, raw in events(page):
        if kind == "open":
            if node.tag in BLOCK or node.tag in SKIP:
                count[_hash(node.path)] += 1
            open_paths.append(node)
        elif kind == "close":
            open_paths.pop()
        elif kind == "text" and node is not None and (words := raw.split()):
            count[_hash(f"{node.path}\t{' '.join(words)}")] += 1
            if not node.skip:
                for path in {x.path for x in open_paths}:
                    chars[_hash(path)] += len(raw)
    return count, chars


def _meeting(seen: list, slots: list[Node], articles: list[Node]) -> list[Node]:
    """The articles around the slots and those within them; these only if there is one, or they hold half of the slots' text."""
    of = {id(x): "slot" for x in slots} | {id(x): "article" for x in articles}
    both = {id(x) for x in slots} & {id(x) for x in articles}
    above: list[Node] = []
    around, within, total, held = {}, {}, 0, 0
    for kind, node, raw in seen:
        marks = {of.get(id(x)) for x in above} | ({"slot"} if any(id(x) in both for x in above) else set())
        if kind == "open":
            if of.get(id(node)) == "article" and ("slot" in marks or id(node) in both):
                within[id(node)] = node
            elif of.get(id(node)) == "slot":
                around |= {id(x): x for x in above if of.get(id(x)) == "article"}
            above.append(node)
        elif kind == "close":
            above.pop()
        elif kind == "text" and "slot" in marks and not (node and node.skip):
            total += len(raw.strip())
            held += len(raw.strip()) if "article" in marks else 0
    if len(within) > 1 and held * 2 < total:
        within = {}
    return list((around | within).values())


def main_text(page: str | None, constant: frozenset[int] = frozenset(), region: int | None = None) -> str:
    """constant: text tokens of the template; region: its element that holds the main text. The region decides: articles
    outside it are not looked at. That no more and no less than an article is taken is checked after that."""
    if not page:
        return ""
    seen = list(events(page))
    opened = [node for kind, node, _ in seen if kind == "open"]
    strong = [x for x in opened if x.main and not x.skip]
    articles = [x for x in strong if x.tag == "article"] or strong
    slots = [x for x in opened if not x.skip and _hash(x.path) == region and x.tag in BLOCK] if region is not None else []
    if slots:
        articles = _meeting(seen, slots, articles)
    if articles:
        roots, constant = {id(x) for x in articles}, frozenset()  # an article is whole, whatever its host repeats
    else:
        roots = {id(x) for x in slots} or None
    inside, blocks, block = 0 if roots else 1, [], []

    def end() -> None:
        words = html.unescape("".join(block)).split()
        if words:
            blocks.append(" ".join(words))
        block.clear()

    for kind, node, raw in seen:
        if kind == "text":
            if inside and not (node and node.skip) and not (constant and node and _hash(f"{node.path}\t{' '.join(raw.split())}") in constant):
                block.append(raw)
        elif kind == "break" or node.tag in BLOCK:
            end()
        if roots and kind == "open" and id(node) in roots:
            inside += 1
        elif roots and kind == "close" and id(node) in roots:
            inside -= 1
    end()
    return "\n".join(blocks)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page and token; the token 0 stands for the page itself."""
    names = ["host", "token", "times", "chars", "a", "b"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            count, chars = tokens(page or "")
            where = _hash(host(url))
            own = xxhash.xxh64_intdigest(f"{url}\n{page}")
            count[0] = 1
            for t, n in count.items():
                h = xxhash.xxh64_intdigest(own.to_bytes(8, "little") + n.to_bytes(8, "little"))
                for column, v in zip(rows, (where, t, n, chars.get(t, 0), h & 0x7FFFFFFF, h >> 33), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=names)


def _distinct(pages: DataFrame) -> DataFrame:
    """url and html of one row for each content on a host: copies say nothing of a template. Only repeated contents are shuffled."""
    of = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?U)^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    named = pages.select("url", "html", of.alias("of"), F.md5(F.coalesce("html", F.lit(""))).alias("h"))
    repeated = common.written(named.groupBy("of", "h").count().filter("count > 1").select("of", "h"), "repeated-pages", True)
    if repeated.isEmpty():
        return pages.select("url", "html")
    once = named.join(repeated, ["of", "h"], "left_anti").select("url", "html")
    first = named.join(repeated, ["of", "h"], "left_semi").groupBy("of", "h").agg(F.min("url").alias("url"), F.first("html").alias("html"))
    return once.unionByName(first.select("url", "html"))


def templates(pages: DataFrame) -> DataFrame:
    """For each host with a template: host, constant (text tokens and elements on nearly all pages) and region."""
    rows = _distinct(pages).mapInArrow(_token_rows, "host long, token long, times long, chars long, a long, b long")
    seen = rows.groupBy("host", "token").agg(
        F.count("*").alias("on"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("times").alias("most"), F.sum("chars").alias("chars")
    ).filter(F.col("on") >= PAGES)
    whole = seen.filter("token = 0").select(F.col("host").alias("of"), F.col("on").alias("pages"))
    body = F.max("chars")
    seen = seen.filter("token <> 0").join(whole, F.col("host") == F.col("of")).filter(F.col("on") * 2 >= F.col("pages"))
    by_class = seen.groupBy("host", "pages", "on", "a", "b").agg(F.collect_list(F.struct("token", "most", "chars")).alias("tokens")).filter(F.size("tokens") >= CLASS)
    each = by_class.select("host", "pages", "on", F.explode("tokens").alias("x")).select("host", "pages", "on", "x.*")
    total = each.groupBy("host").agg(body.alias("total"))
    each = each.join(total, "host")
    constant = (F.col("pages") >= CONSTANT) & (F.col("on") * 10 >= F.col("pages") * 9)
    skeleton = (F.col("most") == 1) & (F.col("on") == F.col("pages")) & (F.col("chars") >= F.col("total") * MOST) & (F.col("total") > 0)
    # the deepest element with most of the text is the one with the least of it
    return each.groupBy("host").agg(
        F.collect_set(F.when(constant, F.col("token"))).alias("constant"),
        F.min_by("token", F.when(skeleton, F.struct("chars", "token"))).alias("region"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_hash(host(u)) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "host"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, frozenset] = {}
            out = []
            for page, constant, region in zip(batch.column("html").to_pylist(), batch.column("constant").to_pylist(), batch.column("region").to_pylist(), strict=True):
                key = tuple(constant or ())
                out.append(main_text(page, known.setdefault(key, frozenset(key)), region))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # a table of its own size: broadcast if that is small, else a join whose large hosts can be split
    known = common.written(templates(pages), "templates", True)
    rows = pages.select("page_id", "url", "html").mapInArrow(hosts, f"page_id {kind}, url string, html string, host long")
    return rows.join(known, "host", "left").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
