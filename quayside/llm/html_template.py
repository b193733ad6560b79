"""Main text of web pages by equivalence-class template deduction (operator 2).

Pages are token streams of tags (with class, id and role) and whole text
blocks. A token's occurrence vector holds its count in every page of a host;
tokens with equal vectors are an equivalence class. Vectors are never built:
per (host, token) the hashes of (page, count) are summed, so equal sums mean
equal vectors and hot hosts are pre-aggregated. Copies of a page on a host
count once. A class needs enough pages and enough tokens. Then each page tells
which tokens break their class: those out of the class's order (by mean
position), and those that lie alone in a slot of a class with more pages, so
that a class which spans several slots falls into the parts that nest. Classes
that keep enough tokens are valid and form the host's template: repeated text
blocks are its fixed text, and what stands between its tokens are slots.
Hosts with few pages share a pooled template.

A page's article is the text of its slots without the fixed text, in menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts and
styles (fixed tag and word lists) never. `article` or `main` choose the slots
where a page has them; elsewhere it is the innermost template element that
holds every slot with a share of the text. A page that the template would
leave empty keeps its fixed text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import count, pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 3, 0.5, 3
#: A token stays in its class if at most so many of its pages break it.
MOST_BROKEN = 0.1
#: A slot with this share of a page's free text belongs to the article.
LEAST_SLOT = 0.05
#: Templates up to so many tokens in all go to every task, larger ones are joined.
BROADCAST_TOKENS = 4_000_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>")
#: A tag whose quotes don't close within so many characters ends at the next `>`.
LONGEST_TAG = 1 << 14
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_BLANK = re.compile(r"\s+")
# fixed element and word lists
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SKIPPED = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "option", "svg", "object", "dialog", "canvas", "audio", "video", "math"} | RAW
SKIPPED_WORDS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "rail", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "banner", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "login", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "commentlist", "disqus", "replies", "respond",
    "related", "recommended", "share", "sharing", "social", "widget", "widgets", "toolbar", "search", "pagination", "pager", "complementary", "contentinfo",
}
HEADER_WORDS = {"header", "masthead", "topbar"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CONTENT = ("article", "main")


class Element:
    """at, end: places of its tags. content: in article or main; skipped: in
    what is no article."""

    __slots__ = ("name", "token", "content", "skipped", "parent", "at", "end", "depth")

    def __init__(self, name, token, content, skipped, parent, at):
        self.name, self.token, self.content, self.skipped, self.parent, self.at, self.end = name, token, content, skipped, parent, at, 0
        self.depth = parent.depth + 1 if parent else 0


def _markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of a closing tag, name, attributes) of tags; of
    comments and declarations the name is empty. What opens a tag that never
    ends reaches to the end of the page."""
    at, last = page.find("<"), page.rfind(">")
    while at >= 0:
        after = page[at + 1 : at + 3]
        if page.startswith("<!--", at):
            end = page.find("-->", at)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", "", ""
        elif not re.match("/?[a-zA-Z]|[!?]", after):
            end = at + 1  # a character of the text
        elif at > last:
            end = len(page)
            yield at, end, "", "", ""
        elif after[0] in "!?" or not (m := _TAG.match(page, at, min(len(page), at + LONGEST_TAG))):
            end = page.find(">", at) + 1
            m = None if after[0] in "!?" else re.match(r"<(/?)([a-zA-Z][^\s/>]*)", page[at : min(end, at + 80)])
            yield at, end, *((m.group(1), m.group(2), "") if m else ("", "", ""))
        else:
            end = m.end()
            yield at, end, *m.groups()
        at = page.find("<", end)


def _token(text: str) -> int:
    """Even for a tag, odd for a text block."""
    return xxhash.xxh64_intdigest(text) & ((1 << 63) - 2) | (text[0] == "#")


def parse(page: str) -> tuple[list[Element], list[tuple[Element | None, str, int]]]:
    """Elements in order of opening, and the text blocks with the element each
    stands in and its place in the page. Lenient: what is never closed ends
    with its parent."""
    elements: list[Element] = []
    stack: list[Element] = []
    blocks: list[tuple[Element | None, str, int]] = []
    held: list[str] = []
    at = 0
    place = count(1)

    def flush() -> None:
        if held:
            text = _BLANK.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append((stack[-1] if stack else None, text, next(place)))

    named: Counter[str] = Counter()  # open elements

    def close() -> Element:
        named[stack[-1].name] -= 1
        return stack.pop()

    for start, end, closing, name, given in _markup(page):
        if start < at:
            continue
        held.append(page[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if name in INLINE and not (name == "br"):
            inline = {a.lower() for a, _ in _ATTRIBUTE.findall(given)}
            if not inline & {"hidden", "class", "id"} or closing:
                if not (closing and any(e.name == name for e in stack[-3:])):
                    continue
        if name == "br":
            held.append(" ")
            continue
        if closing:
            if named[name]:
                if name not in INLINE:
                    flush()
                elif stack[-1].skipped:
                    flush()
                while stack:
                    e = close()
                    if e.name == name:
                        e.end = next(place)
                        break
            else:
                flush()
            continue
        attributes = {a.lower(): v.strip("\"'").lower() for a, v in _ATTRIBUTE.findall(given)}
        words = set(re.findall(r"[a-z]+", " ".join(attributes.get(a, "") for a in ("class", "id", "role"))))
        if name in INLINE:
            if not (words & SKIPPED_WORDS or "hidden" in attributes):
                continue
        flush()
        while stack and stack[-1].name in CLOSED_BY.get(name, ()):
            close()
        if name in CLOSED_BY["p"] or name not in INLINE and name != "p":
            while stack and stack[-1].name in INLINE:
                close()
            if stack and stack[-1].name == "p" and name not in INLINE:
                close()
        parent = stack[-1] if stack else None
        content = bool(parent and parent.content) or name in CONTENT or attributes.get("role") == "main"
        skipped = bool(parent and parent.skipped) or name in SKIPPED or bool(words & SKIPPED_WORDS) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        if not (parent and parent.content):
            skipped = skipped or name == "header" or bool(words & HEADER_WORDS)
        e = Element(name, _token(f"<{name} {attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}>"), content, skipped, parent, next(place))
        elements.append(e)
        if name in VOID or given.endswith("/"):
            continue
        if name in RAW:
            ends = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            e.end = next(place) if ends else 0
            at = ends.end() if ends else len(page)
            continue
        stack.append(e)
        named[name] += 1
    held.append(page[at:])
    flush()
    return elements, blocks


def tokens(page: str) -> dict[int, list[int]]:
    """Token -> [count, place of the first]: opening tags, closing tags, and
    whole text blocks."""
    counts: dict[int, list[int]] = {}
    elements, blocks = parse(page)
    found = [(e.at, e.token) for e in elements] + [(e.end, _token(f"/{e.token}")) for e in elements if e.end] + [(at, _token(f"#{text}")) for _, text, at in blocks]
    for at, t in sorted(found):
        counts.setdefault(t, [0, at])[0] += 1
    return counts


def main_text(page: str, template: frozenset[int]) -> str:
    """Every step is one pass over the elements, parents first, or the blocks."""
    elements, blocks = parse(page)
    tops = {id(e) for e in elements if e.content and not (e.parent and e.parent.content) and not e.skipped}
    below: set[int] = set()  # in a chosen element that is no article, with no article between
    inner: set[int] = set()
    for e in elements:
        up = e.parent
        if up and up.name != "article" and (id(up) in below or id(up) in tops):
            below.add(id(e))
            if e.name == "article" and not e.skipped:
                inner.add(id(e))
    if inner:
        tops = {id(e) for e in elements if id(e) in tops and e.name == "article"} | inner
    open_ = [(e, t) for e, t, _ in blocks if not (e and e.skipped)]
    if tops:
        inside = _below(elements, tops)
        open_ = [(e, t) for e, t in open_ if id(e) in inside]
    free = [(e, t) for e, t in open_ if _token(f"#{t}") not in template] or open_
    if not tops:
        # a tag that comes again in the page is part of a slot's content
        times = Counter(e.token for e in elements)
        slot: dict[int, Element | None] = {id(None): None}  # the template element that an element stands in
        for e in elements:
            slot[id(e)] = e if e.token in template and times[e.token] == 1 else slot[id(e.parent)]
        chars: Counter[int] = Counter()
        for e, t in free:
            chars[id(slot[id(e)])] += len(t)
        large = list({id(slot[id(e)]): slot[id(e)] for e, _ in free if chars[id(slot[id(e)])] >= LEAST_SLOT * chars.total()}.values())
        region = large[0] if large else None
        for other in large[1:]:  # 1 / LEAST_SLOT at most
            while region is not other and region and other:
                if region.depth >= other.depth:
                    region = slot[id(region.parent)]
                else:
                    other = slot[id(other.parent)]
            region = region and other
        if region:
            inside = _below(elements, {id(region)})
            free = [(e, t) for e, t in free if id(e) in inside]
    return "\n".join(t for _, t in free)


def _below(elements: list[Element], roots: set[int]) -> set[int]:
    """The roots and all that stands in them."""
    found: set[int] = set()
    for e in elements:
        if id(e) in roots or e.parent and id(e.parent) in found:
            found.add(id(e))
    return found


def _counted(batches):
    for b in batches:
        out = []
        pages = b.column(1).cast(pa.string())
        for i in range(b.num_rows):
            host, counts = b.column(0)[i].as_py(), tokens(pages[i].as_py() or "")
            content = xxhash.xxh64_intdigest(repr(sorted((t, n) for t, (n, _) in counts.items())))
            of = {n: xxhash.xxh64_intdigest(f"{host}\x00{content}:{n}") for n in {n for n, _ in counts.values()}}
            vector = [of[n] for n, _ in counts.values()]
            out.append((host, content & ((1 << 63) - 1), list(counts), [at for _, at in counts.values()], [v & 0xFFFFFFFF for v in vector], [v >> 32 for v in vector]))
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.list_(pa.int64())) for c in columns[2:]]], ["host", "content", "token", "at", "v1", "v2"])


def in_order(places: list[int]) -> set[int]:
    """Indexes of a longest ascending subsequence."""
    if all(a < b for a, b in pairwise(places)):
        return set(range(len(places)))
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for i, x in enumerate(places):
        j = bisect_left(tails, x)
        tails[j : j + 1], ends[j : j + 1] = [x], [i]
        before.append(ends[j - 1] if j else -1)
    held, i = set(), ends[-1]
    while i >= 0:
        held.add(i)
        i = before[i]
    return held


def broken(classes: list[list[int]], at: dict[int, int]) -> list[int]:
    """Tokens of a page that break their class. classes: each in its order,
    those of more pages first."""
    out, outer = [], []
    for own in classes:
        if own[0] not in at:
            continue
        places = [at[t] for t in own]
        kept = in_order(places)
        # a token's slot in each outer class; before and after it are one
        slots = [tuple(bisect_left(o, x) % len(o) for o in outer) for x in places]
        size = Counter(slots[i] for i in kept)
        kept = {i for i in kept if size[slots[i]] >= LEAST_TOKENS}
        out += [t for i, t in enumerate(own) if i not in kept]
        if len(kept) >= LEAST_TOKENS:
            outer.append(sorted(places[i] for i in kept))
    return out


def _broken(batches):
    """(key, token, n) from (key, token, at, classes)."""
    for b in batches:
        known: dict[str, list[list[int]]] = {}
        found: Counter[tuple[str, int]] = Counter()
        for i in range(b.num_rows):
            key = b.column(0)[i].as_py()
            if key not in known:
                known[key] = [[t["token"] for t in sorted(c["tokens"], key=lambda t: (t["place"], t["token"]))] for c in sorted(b.column(3)[i].as_py() or [], key=lambda c: (-c["support"], -len(c["tokens"]), c["v1"], c["v2"]))]
            for t in broken(known[key], dict(zip(b.column(1)[i].as_py(), b.column(2)[i].as_py()))):
                found[key, t] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([t for _, t in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["key", "token", "n"])


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, pages, tokens) from pages (host, html): the tokens of each host's
    valid classes; pages are distinct ones. The row with a null host is the
    pooled template of hosts with fewer than LEAST_PAGES pages. Its tags need
    no share of all those pages, which are of many layouts; its fixed text
    does, as an article that many hosts carry is no template."""
    rows = materialize(pages.select("host", "html").mapInArrow(_counted, "host string, content long, token array<long>, at array<long>, v1 array<long>, v2 array<long>").withColumn("row", F.monotonically_increasing_id()), "tokens")
    copies = materialize(rows.groupBy("host", "content").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").drop("n"), "copies")
    distinct = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_TOKENS else copies, ["host", "content"], "left").where("first is null or row = first")
    hosts = materialize(distinct.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    small = hosts.where(F.col("pages") < LEAST_PAGES).agg(F.sum("pages").alias("all")).first()["all"] or 0
    # a key is "h" and the host, or empty for the pool
    keyed = distinct.join(hosts.where(F.col("pages") >= LEAST_PAGES), "host", "left").withColumn("key", F.when(F.col("pages").isNotNull(), F.concat(F.lit("h"), F.col("host"))).otherwise(F.lit("")))
    held = keyed.select("key", F.coalesce("pages", F.lit(small)).alias("pages"), F.explode(F.arrays_zip("token", "at", "v1", "v2")).alias("t")).select("key", "pages", "t.*")
    vectors = held.groupBy("key", "token").agg(F.max("pages").alias("pages"), F.count("*").alias("support"), F.sum("at").alias("at"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
    pooled_tag = (F.col("key") == "") & (F.pmod("token", F.lit(2)) == 0)
    frequent = vectors.where((F.col("support") >= LEAST_PAGES) & (pooled_tag | (F.col("support") >= F.col("pages") * LEAST_SHARE)))
    member = F.struct((F.col("at") / F.col("support")).alias("place"), "token")
    classes = materialize(frequent.groupBy("key", "v1", "v2").agg(F.max("pages").alias("pages"), F.max("support").alias("support"), F.collect_list(member).alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS), "classes")
    nested = classes.groupBy("key").agg(F.collect_list(F.struct("support", "v1", "v2", "tokens")).alias("classes"))
    size = classes.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    seen = keyed.select("key", "token", "at").join(F.broadcast(nested) if size <= BROADCAST_TOKENS else nested, "key")
    faults = seen.mapInArrow(_broken, "key string, token long, n long").groupBy("key", "token").agg(F.sum("n").alias("n"))
    whole = classes.select("key", "v1", "v2", "pages", "support", F.explode("tokens.token").alias("token")).join(faults, ["key", "token"], "left").where("n is null or n <= support * %f" % MOST_BROKEN)
    valid = whole.groupBy("key", "v1", "v2").agg(F.max("pages").alias("pages"), F.collect_set("token").alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    return valid.groupBy("key").agg(F.max("pages").alias("pages"), F.flatten(F.collect_list("tokens")).alias("tokens")).select(F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("host"), "pages", "tokens")


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages.

    Null html counts as empty and gives an empty text; a null or odd url is of
    the host "". Repeated rows give repeated rows; for the template equal pages of a host are one. An empty table gives no rows; other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1), F.lit("")))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    templates = materialize(deduce_templates(own), "templates")
    pooled = frozenset(t for r in templates.where("host is null").select("tokens").collect() for t in r["tokens"])
    named = templates.where("host is not null").select("host", "tokens")
    size = named.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    met = own.join(F.broadcast(named) if size <= BROADCAST_TOKENS else named, "host", "left")

    def run(batches):
        for b in batches:
            known: dict[str, frozenset[int]] = {}
            texts = []
            for i in range(b.num_rows):
                host = b.column(1)[i].as_py()
                if host not in known:
                    own_tokens = b.column(3)[i].as_py()
                    known[host] = pooled if own_tokens is None else frozenset(own_tokens)
                texts.append(main_text(b.column(2)[i].as_py() or "", known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    key = met.select(F.struct("page_id", "url").alias("key"), "host", "html", "tokens")
    kind = key.schema["key"].dataType.simpleString()
    return key.mapInArrow(run, f"key {kind}, text string").select("key.page_id", "key.url", "text", F.length("text").cast("long").alias("n_chars"))
