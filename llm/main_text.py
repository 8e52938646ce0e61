"""Main text of web pages.

Method: site template removal. Every block element's subtree (name, attributes, text
and children) is hashed; Spark counts for each host on how many pages each subtree
stands; subtrees that recur on at least ``MIN_SHARE`` of the host's pages, and on
``MIN_PAGES`` pages that differ, are template and deleted, unless they hold all of a page's text
outside links: that page keeps them. Repeated rows and copied pages thus keep their text. The
article itself (``article`` or ``main``) is
no template: texts are copied whole between pages of a host, and copies of an article
are not to vanish. Elements whose name, role, class or id says what they are (menus,
headers, footers, sidebars, notices, adverts, forms, comments) are deleted also where a
host has too few pages to count. Names also stand on wrappers, so a form or a named
element stays if it holds an article or most of the text of its article or page (most of
what stands outside links); what names itself as comments, adverts or consent never stays
for its text. Articles that are comments by their own or an outer element's name are
comments. The text of what is left, of the articles if there are any, is the result: one
line for each block.

Only hashes are shuffled, never pages. The template table goes to all tasks when it has
at most ``INLINE`` rows; a longer one is joined to the pages' own hashes instead, with
the same result.

Pages are parsed twice, to count and to extract: parsed trees are larger than the pages.

Defined cases: null and empty html gives the empty text; a null or malformed url is the
host with the empty name; repeated rows are pages of their own and count as pages; null
ids are kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import saved, ship
from llm.html_tree import BLOCK, RAW, Node, parse, subtree_hashes

MIN_PAGES = 5
MIN_SHARE = 0.003
INLINE = 1_000_000

#: Elements without main text, roles and class or id words of page furniture.
DROP = frozenset("""head script style noscript template svg math iframe object embed canvas audio video map select option button input textarea
nav header footer aside form dialog menu search xmp noembed noframes title""".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing social related recommended breadcrumb breadcrumbs
pagination pager menu nav navbar navigation sidebar footer header comment comments disqus reply replies respond widget toolbar""".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
BOXES = frozenset("ad ads advert adverts advertisement advertisements advertising cookie cookies consent gdpr newsletter subscribe subscription signup".split())
#: Words after which a name says what is around an element, and last words that say how something else is set.
AROUND = frozenset("no not non with without has have hide show".split())
STATES = frozenset("open opened closed enabled disabled allowed on off".split())
MAIN = ("article", "main")
MOST = 0.5
TEXT, WRAP, BOX, COMMENT, HARD = range(5)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def template_parts(root: Node) -> list[tuple[Node, int]]:
    """Block elements that may be template, with their hashes: those that neither are,
    hold nor stand inside an article."""
    holds: set[int] = set()
    for n in root.walk():
        if n.tag in MAIN:
            while n is not None and id(n) not in holds:
                holds.add(id(n))
                n = n.parent
    out = []
    todo = [root]
    while todo:
        n = todo.pop()
        for c in reversed(n.children):
            if isinstance(c, str) or c.tag in MAIN or c.tag in RAW or c.tag == "head":
                continue
            if id(c) in holds or c.tag in ("html", "body") or c.tag not in BLOCK:
                todo.append(c)
            else:
                hashes = subtree_hashes(c)
                out += [(x, hashes[id(x)]) for x in c.walk() if x.tag in BLOCK]
    return out


def _kind(n: Node) -> int:
    """What an element says of itself: ``TEXT`` nothing, ``WRAP`` furniture or a wrapper of
    the text, ``BOX`` and ``COMMENT`` boxes and comments, ``HARD`` furniture in any case."""
    if n.tag in DROP and n.tag != "form":
        return HARD
    if not n.attrs or n.tag in ("html", "body", "main"):
        return WRAP if n.tag == "form" else TEXT
    a = n.attributes()
    role = a.get("role", "").lower()
    if n.tag != "article" and ("hidden" in a or role in ROLES and role != "form"):
        return HARD
    out = WRAP if n.tag == "form" or role == "form" else TEXT
    for token in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        words = [w for w in _SPLIT.split(token) if w]
        words = words[:next((i for i, w in enumerate(words) if w in AROUND), len(words))]
        if not NAMES.isdisjoint(words):
            state = words[-1] in STATES
            out = max(out, WRAP if state else COMMENT if not COMMENTS.isdisjoint(words) else BOX if not BOXES.isdisjoint(words) else WRAP)
    return out if n.tag != "article" or out == COMMENT else TEXT


def _weights(top: Node, gone: set[int]) -> dict[int, int]:
    """id(element) -> its characters outside links, boxes, comments and deleted elements."""
    out: dict[int, int] = {}
    for n in reversed(list(top.walk())):
        out[id(n)] = sum(len("".join(c.split())) if isinstance(c, str) else 0 if c.tag == "a" or c.tag in RAW or id(c) in gone or _kind(c) >= BOX else out[id(c)]
                         for c in n.children)
    return out


def _holders(root: Node) -> tuple[set[int], set[int]]:
    """Elements that are or hold a ``main``; those that are or hold a ``main`` or an article
    that is no comment by its own name."""
    mains: set[int] = set()
    articles: set[int] = set()
    for x in root.walk():
        if x.tag in MAIN and (x.tag == "main" or _kind(x) != COMMENT):
            for holds in (mains, articles) if x.tag == "main" else (articles,):
                n = x
                while n is not None and id(n) not in holds:
                    holds.add(id(n))
                    n = n.parent
    return mains, articles


def _tops(root: Node, gone: set[int], mains: set[int]) -> list[Node]:
    """The page's articles. One that is a comment by name counts only where it is the
    single one and has more text than all the rest of the page."""
    tops, late = [], []
    todo = [(root, False)]
    while todo:
        n, comment = todo.pop()
        kind = _kind(n) if n is not root else TEXT
        if id(n) in gone or kind == HARD:
            continue
        comment = comment or kind == COMMENT and id(n) not in mains
        if n.tag in MAIN:
            (late if comment else tops).append(n)
        else:
            todo += [(c, comment) for c in reversed(n.children) if not isinstance(c, str)]
    if not tops and len(late) == 1:
        weights = _weights(root, gone)
        return late if weights[id(late[0])] > weights[id(root)] else []
    return tops


def text_of(root: Node, gone: set[int]) -> str:
    """The lines of the articles (of the whole page if it has none) without deleted elements."""
    weights: dict[int, int] = {}
    mains, articles = _holders(root)

    def furniture(n: Node, top: Node) -> bool:
        kind = _kind(n)
        if kind == TEXT or kind == HARD:
            return kind == HARD
        if id(n) in (mains if kind == COMMENT else articles):
            return False
        if kind != WRAP:
            return True
        if id(top) not in weights:
            weights.update(_weights(top, gone))
        return weights[id(n)] <= MOST * weights[id(top)]

    lines: list[str] = []
    run: list[str] = []

    def flush():
        line = " ".join("".join(run).split())
        if line:
            lines.append(line)
        run.clear()

    for top in _tops(root, gone, mains) or [root]:
        todo = [top]
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                run.append(entities.unescape(n))
            elif n.tag == "br":
                run.append(" ")
            elif id(n) in gone or n.tag in RAW or n is not top and furniture(n, top):
                continue
            elif n.tag in BLOCK or n is top:
                flush()
                todo.append(None)
                todo += reversed(n.children)
            else:
                todo += reversed(n.children)
        flush()
    return "\n".join(lines)


def _site_hash(host: str, h: int) -> int:
    return (h ^ (hash_of(host) * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF


def hash_of(host: str) -> int:
    import hashlib
    return int.from_bytes(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rows(batches):
    for b in batches:
        for at in range(0, b.num_rows, 64):
            yield zip(*[c.to_pylist() for c in b.slice(at, 64).columns])


def _parts(min_pages: int):
    """(host, hash, pages, body) of each page's block elements, once a page; hash null: the page itself.
    Counted within the task first, so that a host with a third of all pages sends few rows: a part
    comes with at most ``min_pages`` of the page bodies it stands in, enough to tell whether that many differ."""
    def run(batches):
        pages: dict[int, int] = {}
        found: dict[tuple[int, int], list] = {}

        def out():
            rows = [(_signed(h), None, n, 0) for h, n in pages.items()]
            rows += [(_signed(h), _signed(s), n if i == 0 else 0, _signed(b)) for (h, s), (n, bodies) in found.items() for i, b in enumerate(sorted(bodies))]
            pages.clear()
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["host", "part", "n", "body"])

        for rows in _rows(batches):
            for url, html in rows:
                name = host_of(url)
                host = hash_of(name)
                body = hash_of(html or "")
                pages[host] = pages.get(host, 0) + 1
                for s in {_site_hash(name, h) for _, h in template_parts(parse(html or ""))}:
                    seen = found.setdefault((host, s), [0, set()])
                    seen[0] += 1
                    if len(seen[1]) < min_pages:
                        seen[1].add(body)
            if len(found) >= 200_000:
                yield out()
        yield out()
    return run


def _extract(template):
    """Pages (page_id, url, html, own recurring hashes or null) -> page_id, url, text, n_chars."""

    def run(batches):
        known = None if template is None else template.value
        for rows in _rows(batches):
            out = []
            for page_id, url, html, own in rows:
                root = parse(html or "")
                name = host_of(url)
                parts = template_parts(root)
                if known is None:
                    recurring = set(own or ())
                elif len(known) and parts:
                    h = np.array([_signed(_site_hash(name, h)) for _, h in parts], dtype=np.int64)
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    recurring = set(h[known[at] == h].tolist())
                else:
                    recurring = set()
                gone = {id(n) for n, h in parts if _signed(_site_hash(name, h)) in recurring} if recurring else set()
                if gone and not _weights(root, gone)[id(root)]:
                    gone = set()  # the page has no other text
                text = text_of(root, gone)
                out.append((page_id, url, text, len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "text", "n_chars"])
    return run


def _page_parts(batches):
    """(row, part) of each page's block elements."""
    for rows in _rows(batches):
        a, b = [], []
        for row, url, html in rows:
            name = host_of(url)
            s = {_signed(_site_hash(name, h)) for _, h in template_parts(parse(html or ""))}
            a += [row] * len(s)
            b += s
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["row", "part"])


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, inline: int = INLINE,
              id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page; see the module text."""
    spark = pages.sparkSession
    ship(spark)
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    bodies = (df.select("url", "html").mapInArrow(_parts(max(1, min_pages)), "host long, part long, n long, body long")
              .groupBy("host", "part", "body").agg(F.sum("n").alias("n")))
    counts = saved(bodies.groupBy("host", "part").agg(F.sum("n").alias("n"), F.count("*").alias("differ"))
                   .where(F.col("part").isNull() | (F.col("differ") >= min_pages)), "parts")
    hosts = counts.where("part is null").select("host", F.col("n").alias("pages"))
    template = counts.where("part is not null").join(hosts, "host").where(F.col("n") >= min_share * F.col("pages")).select("part").distinct()
    if template.limit(inline + 1).count() <= inline:
        known = np.sort(template.toPandas()["part"].to_numpy(dtype=np.int64))
        rows, table = df.withColumn("own", F.lit(None).cast("array<bigint>")), spark.sparkContext.broadcast(known)
    else:
        # too many to send to every task: each page gets its own recurring parts by joins
        df = saved(df.withColumn("row", F.monotonically_increasing_id()), "pages")
        own = (df.select("row", "url", "html").mapInArrow(_page_parts, "row long, part long").join(template, "part")
               .groupBy("row").agg(F.collect_list("part").alias("own")))
        rows, table = df.join(own, "row", "left").drop("row"), None
    return rows.select("page_id", "url", "html", "own").mapInArrow(_extract(table), "page_id long, url string, text string, n_chars long")
