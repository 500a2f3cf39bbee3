"""A page as a repaired tree of elements, made in one pass over its source.

The tokenizer knows quoted attribute values and takes linear time on any input: a tag, comment or script that
does not end runs to the end of the page. Elements without an end tag end where HTML lets them end, else with
the element around them, so that every element has a start and an end.

An element's role is its path: a hash of its label (tag, class and role) and of the path around it.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left

_VALUES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"?|'[^']*+'?|[^\s>"'][^\s>]*+)?+)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)(?=[\s/>]){_VALUES}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+){_VALUES}(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*))""")

#: Elements of HTML that end a block of text, and those without an end tag.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Elements that a start tag ends, if they are open since the last of the elements that keep them.
_ENDS_P = "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
_ENDS = dict.fromkeys(_ENDS_P.split(), ("p",)) | {
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",), "a": ("a",),
    "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tbody": ("thead", "tbody", "tr", "p"), "tfoot": ("tbody", "tr", "p"),
}
_KEEPS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "a": ("td", "th")}
_KEEPS_CELL = ("table",)
_KEEPS_P = ("td", "th", "caption", "button", "object", "li", "dd", "dt")

#: Elements whose content is no text of the page, and those and the words of class, id or role that mark page furniture.
_HIDDEN = frozenset("template noscript svg object select".split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted related remark replies "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_KEPT_TAGS = frozenset("html body main article".split())
#: Words beside one of furniture in a name that say where or what kind of box it is.
BOX_WORDS = frozenset(
    "a and area article articles bar block blocks bottom bottombar box btn button buttons center col column container content div fixed float form "
    "global group header holder icon icons inline inner item items js layout left line link links list local main mobile module of outer page panel "
    "post posts primary region right row secondary section site slot small sticky stories story the title top unit wrap wrapper zone".split()
)

_MASK = (1 << 64) - 1


def mixed(x: int, y: int) -> int:
    """64 bits of two numbers."""
    x = (x ^ y * 0x9E3779B97F4A7C15) & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _is_furniture(name: str) -> bool:
    parts = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in FURNITURE_WORDS for w in parts) and all(w in FURNITURE_WORDS or w in BOX_WORDS for w in parts)


_labels: dict[tuple[str, str], tuple[int, bool]] = {}


def _label(tag: str, attributes: str) -> tuple[int, bool]:
    """Hash of tag, class and role, and whether tag or names are those of furniture."""
    low = attributes.lower()
    if "=" not in low or not ("class" in low or "role" in low or "id" in low):
        attributes = ""
    key = tag, attributes
    if key not in _labels:
        names, marks = [], tag
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "role") and value:
                marks += f".{' '.join(sorted(value.split()))}"
            if name in ("class", "id", "role"):
                names += value.lower().split()
        furniture = tag in FURNITURE_TAGS or tag not in _KEPT_TAGS and any(map(_is_furniture, names))
        if len(_labels) > 20_000:
            _labels.clear()
        if len(attributes) > 500:
            return zlib.crc32(marks.encode("utf-8", "replace")), furniture
        _labels[key] = zlib.crc32(marks.encode("utf-8", "replace")), furniture
    return _labels[key]


class Page:
    """Elements in order of their starts, with the page itself as the first.

    Of each: ``tags``, ``paths``, ``parents``, the cuts in the source where it starts and ends (``starts``, ``ends``), and
    whether it is ``furniture``. Cuts are stretches of the source that are no text: (from, to, ends a block). Sums up to each cut
    are characters that are no white space (``upto``), those of links (``linked``) and a fingerprint of the text (``prints``).
    """

    def __init__(self, source: str):
        self.source = source
        self.cuts: list[tuple[int, int, bool]] = [(0, 0, True)]
        self.tags, self.paths, self.parents, self.starts, self.ends, self.furniture = [""], [1], [-1], [0], [0], [False]
        self.upto, self.linked, self.prints = [0], [0], [0]
        self.hidden: list[int] = []  # elements of _HIDDEN with an end tag
        self._stack, self._open, self._links = [0], {}, 0
        at = 0
        for m in _TOKEN.finditer(source):
            a, b = m.span()
            tag = m[3]
            tag = tag.lower() if tag is not None else None
            if tag is None:
                self._cut(at, a, b, False)
            elif m[2]:
                self._cut(at, a, b, tag in BLOCKS)
                if mine := self._open.get(tag):
                    if tag in _HIDDEN:
                        self.hidden.append(mine[-1])
                    self._close(mine[-1])
            else:
                self._cut(at, a, b, tag in BLOCKS)
                self._start(tag, source[m.end(3) : b])
            at = b
        self._cut(at, len(source), len(source), True)
        self._close(0)
        self._keep_most()

    def _cut(self, at: int, a: int, b: int, breaks: bool) -> None:
        words = self.source[at:a].split() if a > at else ()
        n = sum(map(len, words))
        self.cuts.append((a, b, breaks))
        self.upto.append(self.upto[-1] + n)
        self.linked.append(self.linked[-1] + (n if self._links else 0))
        self.prints.append(self.prints[-1] + zlib.crc32(" ".join(words).encode("utf-8", "replace")) if n else self.prints[-1])

    def _start(self, tag: str, attributes: str) -> None:
        for other in _ENDS.get(tag, ()):
            if (mine := self._open.get(other)) and mine[-1] > self._barrier(tag, other):
                self._close(mine[-1])
        label, furniture = _label(tag, attributes)
        here, around = len(self.tags), self._stack[-1]
        self.tags.append(tag)
        self.paths.append(mixed(self.paths[around], label))
        self.parents.append(around)
        self.starts.append(len(self.cuts) - 1)
        self.ends.append(len(self.cuts) - 1)
        self.furniture.append(furniture)
        if tag not in VOID:
            self._stack.append(here)
            self._open.setdefault(tag, []).append(here)
            self._links += tag == "a"

    def _barrier(self, tag: str, other: str) -> int:
        keeps = _KEEPS_P if other == "p" and tag not in _KEEPS else _KEEPS_CELL if other in ("tr", "td", "th", "thead", "tbody") else _KEEPS.get(other, _KEEPS.get(tag, ()))
        return max((self._open[k][-1] for k in keeps if self._open.get(k)), default=-1)

    def _close(self, element: int) -> None:
        """The element and those open inside of it end at the last cut."""
        here = len(self.cuts) - 1
        while self._stack and self._stack[-1] >= element:
            gone = self._stack.pop()
            self.ends[gone] = here
            if gone:
                self._open[self.tags[gone]].pop()
                self._links -= self.tags[gone] == "a"

    def _keep_most(self) -> None:
        """No form, and no furniture by name, that holds most of the text, and the article, main and h1 if there are any."""
        for e in self.hidden:
            self.furniture[e] = False
        named = [e for e, f in enumerate(self.furniture) if f and (self.tags[e] == "form" or self.tags[e] not in FURNITURE_TAGS)]
        if named:
            text = self.chars(0) - sum(self.chars(e) for e, t in enumerate(self.tags) if t == "head")
            mains = [e for e, t in enumerate(self.tags) if t in ("article", "main", "h1")]
            edges = [(self.starts[e], self.ends[e]) for e in mains]
            low, high = min((a for a, _ in edges), default=0), max((b for _, b in edges), default=0)
            for e in named:
                if 2 * self.chars(e) > text and (not mains or self.starts[e] <= low and high <= self.ends[e] or self._inside_one(e, mains)):
                    self.furniture[e] = False
        for e, t in enumerate(self.tags):
            if t == "head":
                self.furniture[e] = True
        for e in self.hidden:
            self.furniture[e] = True

    def _inside_one(self, e: int, mains: list[int]) -> bool:
        """Whether each article, main or h1 is in the element, or around it."""
        a, b = self.starts[e], self.ends[e]
        return all(a <= self.starts[m] and self.ends[m] <= b or self.starts[m] <= a and b <= self.ends[m] for m in mains)

    def chars(self, e: int) -> int:
        """Characters of an element that are neither tags nor scripts nor white space."""
        return self.upto[self.ends[e]] - self.upto[self.starts[e]]

    def links(self, e: int) -> int:
        return self.linked[self.ends[e]] - self.linked[self.starts[e]]

    def fingerprint(self, e: int) -> int:
        return self.prints[self.ends[e]] - self.prints[self.starts[e]]

    def around(self, found: list[int]) -> int:
        """The least element that holds all of some."""
        e, last = found[0], max(self.ends[f] for f in found)
        while self.ends[e] < last:
            e = self.parents[e]
        return e

    def outermost(self, inside: int, wanted) -> list[int]:
        """Elements within one that are wanted, without those in another of them."""
        out, until = [], -1
        for e in range(inside + 1, bisect_left(self.starts, self.ends[inside], lo=inside + 1)):
            if self.starts[e] >= until and wanted(e):
                out.append(e)
                until = max(self.ends[e], self.starts[e] + 1)
        return out

    def text(self, inside: int, without: list[int]) -> str:
        """Text of an element but for some elements in it, in order of their starts."""
        gone = {self.starts[e]: self.ends[e] for e in without}
        blocks: list[str] = []
        now: list[str] = []
        k, last = self.starts[inside], self.ends[inside]
        while k < last:
            if (to := gone.get(k, k)) > k:
                breaks, k = any(c[2] for c in (self.cuts[k], self.cuts[to])), to
                if breaks and now:
                    blocks.append("".join(now))
                    now = []
                continue
            now.append(self.source[self.cuts[k][1] : self.cuts[k + 1][0]])
            k += 1
            if self.cuts[k][2]:
                blocks.append("".join(now))
                now = []
        blocks.append("".join(now))
        clean = (" ".join((html.unescape(b) if "&" in b else b).split()) for b in blocks)
        return "\n".join(b for b in clean if b)
