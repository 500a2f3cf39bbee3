"""Main text of web pages by deducing the template that pages of a host share.

1. Every element of a repaired page (``markup``) has a role, its path of labels; its start and its end are two tokens
   of this role. Over the pages of a host a role's numbers of occurrences are its occurrence vector. Roles with one
   vector are an equivalence class: its fingerprint is the sum over pages of a hash of the page and the number, so
   vectors are never gathered and a host with a third of all pages is merged from partial sums.
2. A class is valid if it is large (three tokens or more) and frequent (on half of the host's pages). As a role holds
   the roles around it, and elements of a repaired page have an end, tokens of valid classes are in order and nest: a
   class whose elements stand once in an element of another one nests in the slot there. What nests is the template.
3. What a template element holds outside of the template elements in it is its slot. A slot is furniture if its
   text is the same on all pages (unless most text is, as in copies), if most of it are links, or if tag or names around it
   say so; names are a hint
   beside the counts, and a template without any names works alike. The main slot is the largest other one over all
   pages. The region is the least element around it that stands once a page, or one further out that adds a heading
   or more than ``REST`` of the region's text in slots that are no furniture. A part of the region that does not
   change from page to page is furniture too, if it is less than ``REST`` of it.
4. A page's text is that of the element of the region's role, but for its furniture. Where a page has the role more than
   once, it is the least element around all of them. Hosts of fewer than ``FEW`` pages, and pages without their
   host's region, take the template of all pages together; where that fits neither, the page's article or
   main if it holds all headings and next to all text, and else what its body holds outside of furniture.

A name in class, id or role marks furniture if one of its parts is a word of it and the others say only where
or what kind of box it is: ``site-footer``, but not ``has-sidebar`` or ``share-price``. By such names html, body,
main and article are never furniture, nor is an element with most of the page's text, unless an article, a
main or an h1 stands outside of it.

Character references are decoded, white space inside a block is one space, blocks are joined by one line
feed in page order. A null or empty page gives an empty text, a null url is a host of its own. Repeated
rows give rows of their own; a template counts pages of the same url and html once, whatever their ids, so that they leave all texts as they are. Extra columns are dropped. An empty table gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.llm.markup import HEADINGS, Page, mixed
from coderill.llm.tables import materialise

FEW = 3
#: Pages that text must be the same on to be furniture, share of link text that makes a slot a menu.
SAME = 5
LINKS = 0.6
#: Share of a region's text that slots outside of it may hold, and that unchanging parts of it may be.
REST = 0.2
#: Share of the pages that have a role once a page, and of the text that a page's article or main holds.
HELD = 0.99
#: Numbers in templates that are broadcast at most (8 bytes each); more are joined by shuffle, dealt by hash within a host.
BROADCAST_NUMBERS = 4_000_000
#: Hashes of pages that stand several times, broadcast at most; more are joined by shuffle.
BROADCAST_REPEATS = 1_000_000
_SALTS = 32


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SUMS = ("pages", "times", "v1", "v2", "chars", "links", "named", "headings")
COUNTS = "host string, path long, parent long, low long, high long, " + ", ".join(f"{c} long" for c in _SUMS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task's pages by host and role, and of all hosts together under a null host."""
    sums: dict[tuple[str | None, int], list[int]] = {}

    def rows() -> pa.RecordBatch:
        out = [(who, path, *v) for (who, path), v in sums.items()]
        sums.clear()
        kinds = (pa.string(), *[pa.int64()] * (4 + len(_SUMS)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in COUNTS.split(", ")])

    for batch in batches:
        for host, number, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
            page = Page(source or "")
            tally: dict[int, list[int]] = {}
            for e, path in enumerate(page.paths):
                one = tally.setdefault(path, [page.paths[page.parents[e]] if e else 0, 0, 0, 0, 0, 0, 0])
                chars = page.chars(e)
                one[1] += 1
                one[2] += chars
                one[3] += page.links(e)
                one[4] += page.furniture[e]
                one[5] += page.tags[e] in HEADINGS and chars > 0
                one[6] += page.fingerprint(e)
            for path, (parent, n, chars, links, named, headings, text) in tally.items():
                vector = mixed(number & (1 << 64) - 1, n)
                v1, v2 = vector >> 33, vector & 0x7FFFFFFF
                text = (text ^ text >> 62) & (1 << 62) - 1
                path = _signed(path)
                for who in (host, None):
                    held = sums.get((who, path))
                    if held is None:
                        sums[who, path] = [_signed(parent), text, text, 1, n, v1, v2, chars, links, named, headings]
                        continue
                    if text < held[1]:
                        held[1] = text
                    elif text > held[2]:
                        held[2] = text
                    for k, x in enumerate((1, n, v1, v2, chars, links, named, headings), 3):
                        held[k] += x
            if len(sums) > 100_000:
                yield rows()
    if sums:
        yield rows()


class Role:
    """A frequent role of a host's pages."""

    __slots__ = ("path", "parent", "low", "high", "vector", "inner", "slot", "outside", "furniture", *(c for c in _SUMS if c not in ("v1", "v2")))

    def __init__(self, row: dict):
        self.path, self.parent, self.low, self.high = row["path"], row["parent"], row["low"], row["high"]
        self.vector = row["v1"], row["v2"]
        for c in ("pages", "times", "chars", "links", "named", "headings"):
            setattr(self, c, row[c])
        self.inner: list[Role] = []
        self.slot = 0
        self.furniture = False


def deduced(rows: list[dict], n_pages: int) -> tuple[int | None, list[int]]:
    """The role of the region and the roles of furniture in a template, from the frequent roles of a host."""
    roles = {r["path"]: Role(r) for r in rows}
    classes: dict[tuple[int, int], list[Role]] = defaultdict(list)
    for role in roles.values():
        classes[role.vector].append(role)
    # each role has a start and an end, so two of them are a large class; the page itself holds the template
    template = {r.path: r for same in classes.values() if len(same) >= 2 for r in same} | {r.path: r for r in roles.values() if r.parent == 0}
    top = next((r for r in template.values() if r.parent == 0), None)
    if top is None or not top.chars:
        return None, []

    def around(role: Role) -> Role | None:
        parent = role.parent
        while parent and parent not in template:
            parent = roles[parent].parent if parent in roles else 0
        return template.get(parent)

    order: list[Role] = []  # from the outside in
    for role in template.values():
        if role is not top and (outer := around(role)) is not None:
            outer.inner.append(role)
    stack = [top]
    while stack:
        order.append(stack.pop())
        stack += order[-1].inner
    for role in order:
        role.slot = role.chars - sum(r.chars for r in role.inner)
        role.furniture = role is not top and bool(role.chars) and (2 * role.named > role.times or role.links >= LINKS * role.chars)

    def total(role: Role, of, without: Role | None = None) -> int:
        """A sum over the role and those in it, without furniture and all that is in it."""
        out, stack = 0, [role]
        while stack:
            r = stack.pop()
            if r is without or r.furniture and r is not role:
                continue
            out += of(r)
            stack += r.inner
        return out

    same = [r for r in order if r.pages >= SAME and r.low == r.high and r.chars and not r.furniture]
    unchanging = {r.path for r in same}
    if 2 * total(top, lambda r: r.slot * (r.path in unchanging)) > total(top, lambda r: r.slot):
        same = []  # copies of a page, or nearly
    for role in same:
        role.furniture = True
    open_roles, stack = [], [top]
    while stack:
        role = stack.pop()
        if not role.furniture:
            open_roles.append(role)
            stack += role.inner
    holder = {r.path: outer for outer in order for r in outer.inner}
    once = lambda r: HELD * r.times <= r.pages and r.pages >= HELD * n_pages
    region = max(open_roles, key=lambda r: (r.slot, -r.path))
    while region is not top and not once(region):
        region = holder[region.path]
    own_headings = lambda r: r.headings
    outer = region
    while outer is not top:
        outer = holder[outer.path]
        if once(outer) and (total(outer, own_headings, region) or total(outer, lambda r: r.slot, region) > REST * total(region, lambda r: r.slot)):
            region = outer
    inside, stack = [], list(region.inner)
    while stack:
        role = stack.pop()
        if role.furniture:
            inside.append(role)
        else:
            stack += role.inner
    same = [r for r in inside if r.path in unchanging]
    if sum(r.chars for r in same) > REST * region.chars:
        inside = [r for r in inside if r.path not in unchanging]
    return region.path, sorted(r.path for r in inside)


def distinct(pages: DataFrame) -> DataFrame:
    """(host, number, html): a row for each url and html, numbered by a hash of both; only hashes of pages that stand alone are shuffled."""
    numbered = pages.select("host", F.xxhash64("url", "html").alias("number"), F.xxhash64("html", "url", F.lit(1)).alias("check"), "html")
    key = ["number", "check"]
    several = materialise(numbered.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key))
    n = several.count()
    if n:
        several = F.broadcast(several) if n <= BROADCAST_REPEATS else several
        # copies of a page on a task are one row before the shuffle
        once = numbered.join(several, key, "left_semi").groupBy(*key).agg(F.first("host").alias("host"), F.first("html").alias("html"))
        numbered = numbered.join(several, key, "left_anti").unionByName(once)
    return numbered.select("host", "number", "html")


def templates(pages: DataFrame) -> DataFrame:
    """(host, region, furniture): of each host of ``FEW`` pages or more, and under a null host of all pages."""
    parts = distinct(pages).mapInArrow(_counts, COUNTS)
    sums = [F.sum(c).alias(c) for c in _SUMS]
    roles = materialise(parts.groupBy("host", "path").agg(F.first("parent").alias("parent"), F.min("low").alias("low"), F.max("high").alias("high"), *sums))
    whole = roles.filter("parent = 0").select(F.col("host").alias("of"), F.col("pages").alias("n_pages"))
    # so a group has at most twice as many rows as a page of the host has roles
    frequent = roles.join(whole, roles["host"].eqNullSafe(whole["of"])).filter(f"2 * pages >= n_pages AND (host IS NULL OR n_pages >= {FEW})").drop("of")

    def deduce(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        region, furniture = deduced(rows, rows[0]["n_pages"])
        return pa.table({"host": pa.array([rows[0]["host"]], pa.string()), "region": pa.array([region], pa.int64()), "furniture": pa.array([furniture], pa.list_(pa.int64()))})

    return frequent.groupBy("host").applyInArrow(deduce, "host string, region long, furniture array<long>").filter("region IS NOT NULL")


def _region(page: Page, region: int | None) -> int | None:
    """The element of a region's role, or the least one around several; none if there is none outside of furniture."""
    found = page.outermost(0, lambda e: _signed(page.paths[e]) == region or page.furniture[e]) if region is not None else []
    found = [e for e in found if _signed(page.paths[e]) == region and not page.furniture[e]]
    if not found and region == _signed(page.paths[0]):
        return 0
    return page.around(found) if found else None


def _tagged(page: Page) -> int:
    """The article or main that holds all headings and next to all text outside of furniture, else the body or the page."""
    gone = page.outermost(0, lambda e: page.furniture[e] or page.tags[e] in ("article", "main"))
    mains, gone = [e for e in gone if not page.furniture[e]], [e for e in gone if page.furniture[e]]
    outer = page.outermost(0, lambda e: page.furniture[e])
    text = lambda e: page.chars(e) - sum(page.chars(f) for f in outer if page.starts[e] < page.starts[f] < page.ends[e])
    for tag in ("article", "main"):
        found = [e for e in mains if page.tags[e] == tag]
        if found:
            e = page.around(found)
            heads = [h for h, t in enumerate(page.tags) if t in HEADINGS and not any(page.starts[f] <= page.starts[h] < page.ends[f] for f in outer)]
            if text(e) >= HELD * text(0) and all(page.starts[e] <= page.starts[h] < page.ends[e] for h in heads):
                return e
    bodies = [e for e, t in enumerate(page.tags) if t == "body"]
    return page.around(bodies) if bodies else 0


def main_text(source: str | None, own: tuple[int | None, frozenset[int]] = (None, frozenset()), common: tuple[int | None, frozenset[int]] = (None, frozenset())) -> str:
    """Text of a page by the template of its host, else by that of all pages, else by its tags alone."""
    page = Page(source or "")
    for region, furniture in (own, common):
        inside = _region(page, region)
        if inside is not None and (page.chars(inside) or not page.chars(0)):
            return page.text(inside, page.outermost(inside, lambda e: page.furniture[e] or _signed(page.paths[e]) in furniture))
    inside = _tagged(page)
    whole = page.tags[inside] not in ("article", "main")
    return page.text(inside, page.outermost(inside, lambda e: page.furniture[e] or whole and page.tags[e] == "header" and not _holds_most(page, e)))


def _holds_most(page: Page, e: int) -> bool:
    return 2 * page.chars(e) > page.chars(0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``."""
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    hosted = plain.withColumn("host", host_of(F.col("url")))
    found = materialise(templates(hosted))
    pooled = found.filter("host IS NULL").first()  # a row of as many numbers as a page has roles
    common = (pooled["region"], frozenset(pooled["furniture"])) if pooled else (None, frozenset())
    own = found.filter("host IS NOT NULL").select(F.col("host").alias("__host"), "region", "furniture")
    numbers = own.agg(F.sum(F.size("furniture") + 8)).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        joined = hosted.join(F.broadcast(own), F.col("host") == F.col("__host"), "left")
    else:  # a host of many pages is dealt to several tasks
        salt = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(_SALTS))
        salted = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = hosted.withColumn("salt", salt).join(salted, (F.col("host") == F.col("__host")) & (F.col("salt") == F.col("__salt")), "left")
    joined = joined.select("page_id", "url", "html", "region", "furniture")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions, furniture = (batch.column(k).to_pylist() for k in (3, 4))
            texts = [main_text(h.as_py(), (r, frozenset(f or ())), common) for h, r, f in zip(batch.column(2), regions, furniture)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = joined.schema["page_id"].dataType.simpleString()
    out = joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
