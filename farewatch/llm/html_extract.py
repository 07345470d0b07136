"""Main text of web pages by equivalence-class template deduction.

Per host, the tokens of its pages (element paths with their class and id, and the text blocks
outside explicit article elements) have occurrence vectors: how often they occur on each page.
Tokens with the same vector form a class; classes of several tokens that stand on most of the
host's pages are its template. The vectors are compared by commutative hashes, so a host's pages
are never gathered: tokens are summed by (host, token), then grouped by vector. A class holds on
a page where its tokens come in the class's order; the template tokens of a page nest by element,
and what lies between them are the slots.

Extraction per page: blocks in explicit content elements (article, main) are taken, unless there are
none or the slots outside them hold more text; then all blocks in the slots are taken, those of the
template left out (texts in content elements are never template). Menus, headers, footers, sidebars, notices, adverts,
forms and reader comments are recognised by element, role, class or id and left out either way, as
are scripts, styles, comments and hidden elements. A class or id counts as a whole, by all its parts
(``cookie-notice`` is a notice, ``no-sidebar`` is none), and on containers only. An element that is
taken for a form or the like but holds the page's article element, with more text than all the rest,
is pardoned; reader comments, related articles and hidden elements are not.

Pages are scanned once from left to right in time linear in their length, whatever they hold: a tag
ends at the next ``>`` outside quotes; once there is none, tags end at the next ``>`` of any kind, and
without one the rest is text. Element paths are chained hashes, so depth costs nothing.

A host's template has at most about twice the tokens of a page (each stands on half the pages or
more), so it is one small row; pages are joined with it on the host, which Spark broadcasts after
measuring it or splits where a host is hot.

Defined results: null or empty html gives the empty text; a null url belongs to the host ''; tags
and references cut off at the end of a page are dropped or kept as text as browsers do; repeated
pages are extracted alike; hosts with fewer than ``MIN_PAGES`` pages have no template; an empty
table gives an empty table; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

MIN_PAGES = 3           # a template needs that many pages
MIN_SHARE = 0.5         # ... and stands on that share of the host's pages
MIN_CLASS = 2           # tokens of a class
BLOCK_JOIN = "\n\n"

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template textarea svg math iframe object canvas audio video head title".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot
th thead tr ul""".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "option": {"option"}}
CONTENT = frozenset({"article", "main"})
ASIDE_ELEMENTS = frozenset("nav footer aside form button select menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements adsense adsbygoogle sponsor sponsored sponsors promo promos
promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup
login sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar
toolbar share sharing social related recommended recommendations comment comments commentlist disqus respond replies discussion search
skip copyright""".split())
# parts of a name that say nothing by themselves
FILLERS = frozenset("""area bar block bottom box button buttons center col column container content footer form group head header holder inner
item items left links list main outer panel right row section site slot text title top unit wrap wrapper""".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies discussion".split())
NEVER_PARDONED = COMMENT_WORDS | frozenset("related recommended recommendations".split())
NAMED = frozenset("div section span ul ol dl ins fieldset details figure table".split())     # elements a class or id can put aside

ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def attributes(source: str) -> dict:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


HARD, SOFT = 2, 1           # never the article; not the article unless it holds it


def is_aside(tag: str, attr: dict, in_content: bool) -> int:
    """Whether an element holds something other than the article: ``HARD``, ``SOFT`` or 0."""
    if tag in ASIDE_ELEMENTS or (tag == "header" and not in_content):
        return SOFT if tag == "form" else HARD
    if not attr:
        return 0
    if attr.get("role", "").lower() in ASIDE_ROLES or "hidden" in attr or attr.get("aria-hidden", "").lower() == "true":
        return HARD
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attr.get("style", "").lower()):
        return HARD
    names = f"{attr.get('class', '')} {attr.get('id', '')}".split()
    if tag in ("body", "html", "article", "main"):
        return HARD if any(_speaks(n, COMMENT_WORDS) for n in names) else 0
    if tag not in NAMED:
        return 0
    if any(_speaks(n, NEVER_PARDONED) for n in names):
        return HARD
    return SOFT if any(_speaks(n, ASIDE_WORDS) or (not in_content and n.lower() == "header") for n in names) else 0


def _speaks(name: str, words: frozenset) -> bool:
    """Whether a class or id, as a whole, says one of ``words``: each part is one or says nothing."""
    parts = [p.lower() for p in WORD.findall(name)]
    return any(p in words for p in parts) and all(p in words or p in FILLERS for p in parts)


class Block:
    __slots__ = ("aside", "content", "links", "path", "text", "token")

    def __init__(self, text, path, content, aside, links, token):
        self.text, self.path, self.content, self.aside, self.links, self.token = text, path, content, aside, links, token


TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_MARK = re.compile(r"""[>"']""")


def tags(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, closing, attributes) of the tags from left to right; name None: a comment or
    declaration. Linear: every failed look ahead is made once."""
    last, quoted = source.rfind(">"), {q: source.rfind(q) for q in "\"'"}
    at, loose = source.find("<"), False
    while 0 <= at:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, None, False, ""
        elif at > last:
            return
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1
            yield at, end, None, False, ""
        else:
            closing = source.startswith("</", at)
            name = TAG_NAME.match(source, at + 1 + closing)
            if not name:
                at = source.find("<", at + 1)
                continue
            end = 0 if loose else _tag_end(source, name.end(), quoted)
            if not end:
                loose, end = True, source.find(">", name.end()) + 1
            yield at, end, name[0].lower(), closing, source[name.end():end - 1]
        at = source.find("<", end)


def _tag_end(source: str, at: int, quoted: dict) -> int:
    """The place after the next ``>`` outside quotes, or 0; a quote without a partner is ordinary."""
    while m := TAG_MARK.search(source, at):
        if m[0] == ">":
            return m.end()
        at = source.find(m[0], m.end()) + 1 if m.start() < quoted[m[0]] else m.end()
    return 0


class Page:
    """Text blocks in page order, element paths in page order (path, place), and the elements that
    are not the article: (enclosing one or -1, hard or soft, holds an article element)."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.paths: list[tuple[int, int]] = []
        self.asides: list[list] = []

    def open_asides(self, pardoned: bool) -> list[bool]:
        """Per aside whether its text counts: only soft ones that hold an article may, pardoned."""
        out: list[bool] = []
        for parent, kind, holds in self.asides:
            out.append(pardoned and kind == SOFT and holds and (parent < 0 or out[parent]))
        return out


def parse(source: str | None) -> Page:
    page = Page()
    blocks, paths, asides = page.blocks, page.paths, page.asides
    stack: list[tuple] = []             # name, path, content depth, aside (or -1), inline
    opened: Counter = Counter()         # elements on the stack, by name
    parts: list[str] = []
    linked = [0, 0]                     # characters of the block, and those inside links
    root = ("", 0, 0, -1, False)

    def flush():
        text = " ".join(_html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            top = stack[-1] if stack else root
            blocks.append(Block(text, top[1], top[2] > 0, top[3], linked[1] >= 0.9 * max(linked[0], 1), len(paths)))
        linked[0] = linked[1] = 0

    def add(text):
        if stack and stack[-1][4]:
            return                      # right inside an inline element that is not the article
        parts.append(text)
        linked[0] += len(text)
        linked[1] += len(text) * (anchors > 0)

    def close(name):
        if not opened[name]:
            return
        k = len(stack) - 1
        while stack[k][0] != name:
            k -= 1
        if any(x[0] in BLOCKS for x in stack[k:]):
            flush()
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]
    source = source or ""
    at, anchors = 0, 0
    absent: set[str] = set()            # elements whose end was looked for in vain
    for start, end, name, closing, attr_source in tags(source):
        if start < at:
            continue
        if start > at:
            add(source[at:start])
        at = end
        if name is None:
            continue
        if closing:
            if name == "a":
                anchors = max(0, anchors - 1)
            if name == "br":
                parts.append(" ")
            elif name == "p" and not opened["p"]:
                flush()
            else:
                close(name)
            continue
        if name in SKIP and not attr_source.rstrip().endswith("/"):
            at = _skip(source, name, at, absent)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            anchors += 1
        if name in BLOCKS:
            flush()
            if name in CLOSES_P:
                close("p")
            while stack and stack[-1][0] in SELF_CLOSING.get(name, ()):
                opened[stack.pop()[0]] -= 1
        if name in VOID or attr_source.rstrip().endswith("/") and name not in BLOCKS:
            continue
        attr = attributes(attr_source)
        _, path, content, aside, _ = parent = stack[-1] if stack else root
        main = name in CONTENT or attr.get("role", "").lower() == "main" or attr.get("itemprop", "") == "articleBody"
        content += main
        kind = is_aside(name, attr, content > 0)
        if main and not kind:
            k = aside
            while k >= 0 and not asides[k][2]:
                asides[k][2] = True
                k = asides[k][0]
        if kind:
            asides.append([aside, kind, False])
            aside = len(asides) - 1
        if name in BLOCKS:
            mark = ".".join(sorted(attr.get("class", "").split())) + (f"#{attr['id']}" if "id" in attr else "")
            path = _hash(f"{path}/{name}{'.' + mark if mark else ''}")
            if not parent[2]:
                paths.append((path, len(blocks)))
        elif not kind:
            continue
        stack.append((name, path, content, aside, name not in BLOCKS))
        opened[name] += 1
    if at < len(source):
        rest = source[at:]
        cut = rest.rfind("<")
        if cut >= 0 and ">" not in rest[cut:] and re.match(r"<[a-zA-Z/!?]", rest[cut:cut + 2]):
            rest = rest[:cut]
        add(rest)
    flush()
    return page


def _skip(source: str, name: str, at: int, absent: set[str]) -> int:
    """Where reading goes on after the start of an element whose inside is no text."""
    end = None if name in absent else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
    if not end:
        absent.add(name)
    if name != "head":
        return end.end() if end else len(source)
    # a head without an end stops at the body
    body = None if "body" in absent else re.compile(r"<body\b", re.I).search(source, at)
    if not body:
        absent.add("body")
    return min((x for x in (end.end() if end else None, body.start() if body else None) if x is not None), default=at)


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) ^ zlib.adler32(data[::-1])


def page_tokens(page: Page) -> tuple[list[int], list[int]]:
    """Token hashes of a page in page order (element paths, and texts outside explicit content),
    and the block each text token stands for (-1 for elements)."""
    at = [(place, 0, p, -1) for p, place in page.paths]
    at += [(k, 1, _hash(f"{b.path}\0{b.text}"), k) for k, b in enumerate(page.blocks) if not b.content]
    at.sort(key=lambda x: (x[0], x[1]))
    return [h for _, _, h, _ in at], [k for _, _, _, k in at]


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html"),
                        F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, classes): a host's template tokens in order, with the class of each."""
    rows = with_host(pages).select("host", F.xxhash64("page_id", "url").alias("page"), "html")
    schema = pa.schema([("host", pa.string()), ("token", pa.int64()), ("page", pa.int64()), ("n", pa.int32()), ("place", pa.float64())])

    def tokens(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            hosts, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for host, page, source in zip(hosts, ids, b.column(2).to_pylist(), strict=True):
                found, _ = page_tokens(parse(source))
                first: dict = {}
                count: dict = {}
                for k, t in enumerate(found):
                    first.setdefault(t, k)
                    count[t] = count.get(t, 0) + 1
                for t, n in count.items():
                    for col, v in zip(out, (host, t, page, n, first[t] / len(found)), strict=True):
                        col.append(v)
                for col, v in zip(out, (host, 0, page, 1, 0.0), strict=True):      # token 0: the page itself
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
    seen = rows.mapInArrow(tokens, "host string, token long, page long, n int, place double")
    h = F.xxhash64("page", "n")
    # the occurrence vector, as commutative sums; partial sums are made before the shuffle
    vectors = seen.groupBy("host", "token").agg(
        F.bit_xor(h).alias("v1"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("v2"), F.count(F.lit(1)).alias("support"),
        F.avg("place").alias("place"))
    vectors = materialise(vectors, "html-vectors")
    hosts = vectors.where("token = 0").select(F.col("host").alias("h"), F.col("support").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    often = (vectors.where("token <> 0").join(hosts, F.col("host") == F.col("h"))
             .where(F.col("support") >= F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("pages") * MIN_SHARE))))
    klass = F.xxhash64("v1", "v2", "support")
    often = often.select("host", "token", "place", klass.alias("class"))
    sizes = often.groupBy(F.col("host").alias("h"), F.col("class").alias("c")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= MIN_CLASS)
    valid = often.join(sizes, (F.col("host") == F.col("h")) & (F.col("class") == F.col("c"))).select("host", "token", "class", "place")
    # at most tokens-per-page / MIN_SHARE rows a host
    rows = F.array_sort(F.collect_list(F.struct("place", "token", "class")))
    return valid.groupBy("host").agg(rows.alias("r")).select(
        "host", F.col("r.token").alias("tokens"), F.col("r.class").alias("classes"))


def template_blocks(found: list[int], block_of: list[int], tokens: list[int], classes: list[int]) -> set[int]:
    """Blocks of a page that belong to its host's template: text tokens of the classes whose
    tokens come in the class's order on this page."""
    place: dict = {}
    for k, t in enumerate(found):
        place.setdefault(t, k)
    order: dict = {}
    for t, c in zip(tokens, classes, strict=True):
        order.setdefault(c, []).append(t)
    out: set[int] = set()
    for members in order.values():
        at = [place.get(t, -1) for t in members]
        if -1 in at or any(x >= y for x, y in zip(at, at[1:], strict=False)):
            continue
        inside = set(members)
        out |= {block_of[k] for k, t in enumerate(found) if t in inside and block_of[k] >= 0}
    return out


def extract(source: str | None, tokens: list[int] | None = None, classes: list[int] | None = None) -> list[str]:
    """Main-text blocks of one page, given its host's template."""
    page = parse(source)
    blocks = page.blocks
    own = [b for b in blocks if b.content and b.aside < 0]
    free = page.open_asides(True)
    if any(free):
        # the article stands in something that is taken for a form or the like: is it most of the text?
        held = [b for b in blocks if b.content and (b.aside < 0 or free[b.aside])]
        if sum(len(b.text) for b in held) > 2 * sum(len(b.text) for b in blocks if b.aside < 0):
            return [b.text for b in held]
    if own and not tokens:
        return [b.text for b in own]
    fixed = template_blocks(*page_tokens(page), tokens, classes) if tokens else set()
    left = [b for k, b in enumerate(blocks) if b.aside < 0 and k not in fixed]
    if own and sum(len(b.text) for b in left if not b.content and not b.links) <= sum(len(b.text) for b in own):
        return [b.text for b in own]
    return [b.text for b in left if b.content or not b.links] or [b.text for b in left]


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.list_(pa.string())), ("host", pa.string())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, blocks, host) of every page."""
    known = materialise(templates(pages), "html-templates").withColumnRenamed("host", "h")
    rows = (with_host(pages).join(known, F.col("host") == F.col("h"), "left")
            .select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", "tokens", "classes"))

    def run(batches):
        for b in batches:
            html, tokens, classes = b.column(2).to_pylist(), b.column(4), b.column(5)
            found = [extract(s, tokens[k].as_py(), classes[k].as_py()) for k, s in enumerate(html)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string())), b.column(3)], schema=OUT)
    return rows.mapInArrow(run, "page_id long, url string, blocks array<string>, host string")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(read_table(spark, sf_dir, "pages"))
    text = F.array_join("blocks", BLOCK_JOIN)
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
