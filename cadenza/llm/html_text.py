"""HTML to the text that a reader sees, laid out in lines.

A tree builder puts in the end tags that HTML lets authors leave out; a renderer walks the tree without
recursion, leaves out what isn't shown and writes blocks on lines of their own, lists with markers and nested
indents, and tables in columns of equal width.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Elements without content, and elements whose content is never shown (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title iframe object canvas audio video datalist frameset noframes rp applet".split())
#: Inside pictures and formulas: what is never shown (fixed values).
UNSEEN_FOREIGN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
#: Elements that are blocks, those of them that stand off by an empty line, and those that end an open paragraph.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre table blockquote figure hr listing".split())
BLOCKS = APART | frozenset("html body div section article header footer nav main aside address li dt dd form fieldset legend figcaption details summary center dir hgroup search option optgroup caption textarea".split())
ENDS_P = (BLOCKS - frozenset("html body option optgroup caption textarea legend".split())) | {"xmp"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag: the open elements that it ends, and those beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Start tags that leave an open head open; any other ends it (fixed values).
IN_HEAD = frozenset("head title meta link base basefont bgsound script style noscript noframes template".split())
#: An end tag doesn't reach an element outside these.
WALLS = frozenset("td th table caption".split())
SPACE = re.compile("[ \t\n\r\f]+")
#: Values of the property display (fixed values); others are no declarations.
DISPLAYS = frozenset(
    "none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group"
    " table-footer-group table-column table-column-group table-caption list-item contents flow-root run-in ruby initial inherit unset revert".split()
)
#: Those that begin and end lines, and those that don't (fixed values); others leave it to the tag.
BLOCK_DISPLAYS = frozenset("block flex grid table table-row table-caption table-row-group table-header-group table-footer-group list-item flow-root".split())
INLINE_DISPLAYS = frozenset("inline inline-block inline-flex inline-grid inline-table contents ruby run-in".split())
#: Inputs that show their value as a label (fixed values).
LABELLED = frozenset("submit button reset".split())
#: The screen that conditions of media queries are held against.
SCREEN = {"width": 1280.0, "height": 800.0}
FEATURES = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "pointer": "fine"}
FEATURE = re.compile(r"\(\s*(?:(min|max)-)?([a-z-]+)\s*(?::\s*([^)]*?)\s*)?\)")
_SIMPLE = r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)((?:\[[\w-]+(?:=(?:\"[^\"\s]*\"|'[^'\s]*'|[\w-]+))?\])*)"
COMPOUND = re.compile(_SIMPLE + r"((?::not\([^()\s]+\))*)")
NOT = re.compile(r":not\(([^()\s]+)\)")
BRACES = re.compile("[{}]")
PART, ATTRIBUTE = re.compile(r"[.#][\w-]+"), re.compile(r"\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")
#: Default of the parameter ``blowup``: a column is as wide as its widest cell, unless the table would take over so many
#: times the room of the column's text (and of as many characters a row): then as the widest cell that keeps to that;
#: longer ones push the rest of their line only. The same goes for empty fields. No text is lost; it bounds padding.
BLOWUP, MOST_SPAN = 64, 1000


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds a tree of nodes and texts; never fails, whatever the input."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for in vain
        self.styles: list[str] = []

    def _cut(self, k: int) -> None:
        """End the open elements from number k on."""
        for node in self.open[k:]:
            self.count[node.tag] -= 1
        del self.open[k:]

    def _end(self, tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        """End the outermost open element of ``tags`` inside ``walls``, with all in it."""
        if not any(self.count[t] for t in tags):
            return
        found = None
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                found = k
            if tag in walls:
                break
        if found:
            self._cut(found)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD and self.count["head"] and self.open[-1].tag == "head":
            self._end({"head"}, set())
        if tag in ENDS_P:
            self._end({"p"}, WALLS | {"button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in ENDS:
            self._end(*ENDS[tag])
        elif tag in BLOCKS and any(n.tag == "head" for n in self.open[1:3]):
            self._end({"head"}, set())
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        self._push(tag, dict(attrs))
        if tag in VOID:
            self._cut(len(self.open) - 1)

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        depth = len(self.open)
        self.handle_starttag(tag, attrs)  # a slash at the end of a start tag means nothing, but in pictures and formulas
        if (self.count["svg"] or self.count["math"]) and len(self.open) > depth:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in ("body", "html"):
            return  # what follows is still content
        if not any(self.count[t] for t in (HEADINGS if tag in HEADINGS else (tag,))):
            return
        walls = {"table"} if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else set() if tag == "table" else WALLS
        for k in range(len(self.open) - 1, 0, -1):
            own = self.open[k].tag
            if own == tag or (tag in HEADINGS and own in HEADINGS):
                self._cut(k)
                return
            if own in walls:
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            if on_screen(self.open[-1].attrs.get("media")):
                self.styles.append(data)
        elif self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


def condition_met(least_most: str, name: str, value: str) -> bool:
    """Whether SCREEN meets a media feature; unknown ones aren't met."""
    if name in SCREEN:
        m = re.fullmatch(r"(\d*\.?\d+)\s*(px|em|rem)?", value)
        if not value:
            return True
        if not m:
            return False
        size = float(m[1]) * (1 if m[2] in (None, "px") else 16)
        return SCREEN[name] >= size if least_most == "min" else SCREEN[name] <= size if least_most == "max" else SCREEN[name] == size
    return not least_most and name in FEATURES and value in ("", FEATURES[name])


def on_screen(media: str | None) -> bool:
    """Whether media queries, of a style element or an at-rule, include SCREEN."""
    queries = (media or "").lower().split(",")
    if not "".join(queries).strip():
        return True
    for query in queries:
        words = FEATURE.sub(" ", query).split()
        negated = words[:1] == ["not"]
        kinds = [w for w in words if w not in ("not", "only", "and")]
        if not query.strip() or len(kinds) > 1:
            continue
        met = kinds in ([], ["all"], ["screen"]) and all(condition_met(*(x or "" for x in m)) for m in FEATURE.findall(query)) and "(" not in FEATURE.sub(" ", query)
        if met != negated:
            return True
    return False


def declarations(body: str) -> dict[str, tuple[str, bool]]:
    """display and visibility as a block of declarations sets them: (value, whether it is important)."""
    found: dict[str, tuple[str, bool]] = {}
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("!important") or value.replace(" ", "").endswith("!important")
        if important:
            value = value.rpartition("!")[0].strip()
        if value in (DISPLAYS if name == "display" else ("visible", "hidden", "collapse", "inherit", "initial", "unset", "revert") if name == "visibility" else ()):
            if important or not found.get(name, ("", False))[1]:
                found[name] = (value, important)
    return found


def style_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a sheet without comments, in order. Of at-rules only media queries that SCREEN meets are
    read."""
    at, end = 0, len(css)
    while at < end:
        opens, stops = css.find("{", at), css.find(";", at)
        if opens < 0:
            return
        prelude = css[at:opens].strip()
        if prelude.startswith("@") and 0 <= stops < opens:  # a statement such as an import
            at = stops + 1
            continue
        if not prelude.startswith("@"):
            closes = css.find("}", opens)
            closes = end if closes < 0 else closes
            yield prelude, css[opens + 1 : closes]
            at = closes + 1
            continue
        depth, closes = 1, opens + 1
        for m in BRACES.finditer(css, opens + 1):
            depth += 1 if m[0] == "{" else -1
            closes = m.end()
            if not depth:
                break
        else:
            closes = end
        if prelude[:6].lower() == "@media" and on_screen(prelude[6:]):
            yield from style_rules(css[opens + 1 : closes - (not depth)])
        at = closes


class Compound:
    """A part of a selector: a tag, classes, an id and attributes that one element must have, and others it must not."""

    __slots__ = ("attributes", "classes", "id", "nots", "tag")

    def __init__(self, m: re.Match):
        parts = PART.findall(m[2])
        self.tag = "" if m[1] in (None, "*") else m[1].lower()
        self.classes = frozenset(x[1:] for x in parts if x[0] == ".")
        self.id = frozenset(x[1:] for x in parts if x[0] == "#")
        self.attributes = [(k.lower(), v) for k, v in ATTRIBUTE.findall(m[3])]
        self.nots = [Compound(x) for x in map(COMPOUND.fullmatch, NOT.findall(m[4])) if x]

    def weight(self) -> tuple[int, int, int]:
        own = len(self.id), len(self.classes) + len(self.attributes), int(bool(self.tag))
        return tuple(map(sum, zip(own, *(x.weight() for x in self.nots))))

    def fits(self, node: Node) -> bool:
        a = node.attrs
        if (self.tag and self.tag != node.tag) or (self.id and self.id != {a.get("id")}) or (self.classes and not self.classes <= set((a.get("class") or "").split())):
            return False
        return all(k in a and (not v or v == a[k]) for k, v in self.attributes) and not any(x.fits(node) for x in self.nots)


def parse_selector(selector: str) -> list[tuple[Compound, str]] | None:
    """Compounds from the right, each with what joins it to the one before (a space or >); none if it isn't of
    tags, classes, ids, plain attributes and :not() of one of these."""
    parts, joint = [], " "
    for token in selector.replace(">", " > ").split():
        if token == ">":
            joint = ">"
        elif (m := COMPOUND.fullmatch(token)) and token and all(map(COMPOUND.fullmatch, NOT.findall(m[4]))):
            parts.append((Compound(m), joint))
            joint = " "
        else:
            return None
    return parts[::-1] or None


def fits_path(parts: list[tuple[Compound, str]], k: int, path: list[Node], top: int) -> bool:
    """Whether the element ``path[top]`` and its ancestors fit the selector's compounds from number k on."""
    if not parts[k][0].fits(path[top]):
        return False
    if k + 1 == len(parts):
        return True
    if parts[k][1] == ">":
        return top > 0 and fits_path(parts, k + 1, path, top - 1)
    return any(fits_path(parts, k + 1, path, x) for x in range(top - 1, -1, -1))


class Styles:
    """What style sheets say of display and visibility, looked up by an element's id, classes and tag."""

    def __init__(self, sheets: list[str]):
        self.index: dict[str, list] = {}
        self.plain: dict[tuple, dict[str, tuple]] = {}  # what rules without ancestors or attributes say, by look of the element
        for order, (selectors, body) in enumerate(style_rules(re.sub(r"/\*.*?\*/", "", "\n".join(sheets), flags=re.S))):
            said = declarations(body)
            for selector in selectors.split(",") if said else []:
                if parts := parse_selector(selector):
                    last = parts[0][0]
                    weight = tuple(map(sum, zip(*(c.weight() for c, _ in parts))))
                    key = "#" + min(last.id) if last.id else "." + min(last.classes) if last.classes else last.tag
                    alone = len(parts) == 1 and not last.attributes and not any(x.attributes for x in last.nots)
                    self.index.setdefault(key, []).append((parts, alone, {k: ((important, 0, weight, order), value) for k, (value, important) in said.items()}))

    def _found(self, node: Node) -> tuple[list, list]:
        a = node.attrs
        keys = {"", node.tag, f"#{a.get('id')}", *(f".{c}" for c in (a.get("class") or "").split())}
        found = [r for k in keys for r in self.index.get(k, ())]
        return [r for r in found if r[1]], [r for r in found if not r[1]]

    def of(self, path: list[Node]) -> dict[str, str]:
        """What is set for the last element of a path from the root."""
        node = path[-1]
        a = node.attrs
        best: dict[str, tuple] = {}

        def say(said: dict[str, tuple]) -> None:
            for k, x in said.items():
                if k not in best or x > best[k]:
                    best[k] = x

        if self.index:
            look = (node.tag, a.get("id"), a.get("class"))
            if look not in self.plain:
                alone, others = self._found(node)
                for parts, _, said in alone:
                    if parts[0][0].fits(node):
                        say(said)
                self.plain[look] = (dict(best), others)
            known, others = self.plain[look]
            best = dict(known)
            for parts, _, said in others:
                if any(k not in best or x > best[k] for k, x in said.items()) and fits_path(parts, 0, path, len(path) - 1):
                    say(said)
        if a and (style := a.get("style")):
            say({k: ((important, 1, (), 0), value) for k, (value, important) in declarations(style).items()})
        return {k: value for k, (_, value) in best.items()}


def appearance(path: list[Node], styles: Styles, visible: bool, foreign: int) -> tuple[bool, bool, str]:
    """Whether the last element of a path is laid out, whether its own text is visible, and the display that is set for it
    (initial, too, if none is)."""
    node = path[-1]
    a = node.attrs
    if node.tag in UNSEEN or (foreign and node.tag in UNSEEN_FOREIGN):
        return False, False, "none"
    said = styles.of(path) if styles.index or "style" in a else {}
    display = said.get("display", "initial")
    if display == "none" or (display in ("initial", "revert") and "display" not in said or display == "revert") and ("hidden" in a or (node.tag == "dialog" and "open" not in a)):
        return False, False, "none"
    value = said.get("visibility", "inherit")
    return True, visible if value in ("inherit", "unset", "revert") else value in ("visible", "initial"), "inline" if display in ("initial", "unset") and "display" in said else display


class Flow:
    """Lines of text under way."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.indent, self.marker = False, 0, "", ""

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *rest = data.split("\n")
            self._put(first)
            for x in rest:
                self.end_line(True)
                self._put(x)
            return
        parts = SPACE.split(data)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        words = " ".join(p for p in parts if p)
        if words:
            self._put((" " if self.space and self.line else "") + words)
            self.space = len(parts) > 1 and not parts[-1]

    def _put(self, data: str) -> None:
        if not data:
            return
        if not self.line:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.indent + self.marker)
            self.indent, self.marker = self.indent + " " * len(self.marker), ""
        self.line.append(data)

    def end_line(self, always: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).replace("\xa0", " ").rstrip())
            self.line = []
        elif always and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def block_lines(self, lines: list[str]) -> None:
        """Finished lines, as they are but for the indent."""
        self.end_line()
        for x in lines:
            self._put(x or "\xa0")
            self.end_line()

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def shown_width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table_lines(rows: list[list[tuple[list[str], int, int]]], blowup: int = BLOWUP) -> list[str]:
    """Rows of (lines, columns spanned, rows spanned) in columns (``blowup``: see BLOWUP)."""
    grid: list[list[tuple[int, int, list[str]]]] = []  # per row: first column, the one after the last, lines
    taken: list[list[int]] = []  # [first column, the one after the last, row after the last], by first column
    for r, row in enumerate(rows):
        taken = [x for x in taken if x[2] > r]
        at, k, placed, more = 0, 0, [], []
        for lines, columns, below in row:
            while k < len(taken) and taken[k][0] <= at:
                at, k = max(at, taken[k][1]), k + 1
            placed.append((at, at + columns, lines))
            until = min(r + below, len(rows))
            if until > r + 1:
                more.append([at, at + columns, until])
            at += columns
        if more:
            merged: list[list[int]] = []
            for x in sorted(taken + more):
                if merged and merged[-1][1] >= x[0] and merged[-1][2] == x[2]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(x)
            taken = merged
        grid.append(placed)
    # columns in which no cell begins have no room of their own
    starts = sorted({a for placed in grid for a, _, _ in placed})
    number = {a: i for i, a in enumerate(starts)}
    cells = [[(number[a], bisect_left(starts, b), lines) for a, b, lines in placed] for placed in grid]
    width = column_widths(cells, len(starts), blowup)
    room = [0, *accumulate(width)]
    sparse = len(starts) * len(rows) > blowup * (sum(map(len, cells)) + len(rows))
    out = []
    for placed in cells:
        filled = [a for a, _, lines in placed if any(lines)]
        if not filled:
            continue
        last = max(filled)
        for k in range(max(len(lines) for _, _, lines in placed)):
            line, c = [], 0
            for a, b, lines in placed:
                if a > last:
                    break
                if a > c and not sparse:
                    line += [" " * width[x] for x in range(c, a)]
                text = lines[k] if k < len(lines) else ""
                line.append(text + " " * (room[min(b, last + 1)] - room[a] + 3 * (min(b, last + 1) - a - 1) - shown_width(text)))
                c = b
            out.append(" | ".join(line).rstrip())
    return out


def column_widths(cells: list[list[tuple[int, int, list[str]]]], columns: int, blowup: int) -> list[int]:
    """Each column's width, from the cells that span it alone; a cell that spans several and has no room in them widens
    the last (see BLOWUP)."""
    found: list[list[int]] = [[] for _ in range(columns)]
    wide = []
    for placed in cells:
        for a, b, lines in placed:
            w = max(map(shown_width, lines), default=0)
            if b == a + 1:
                found[a].append(w)
            elif b > a:
                wide.append((b, a, w))
    fits = lambda w, own: w * len(cells) <= blowup * (own + len(cells))
    width = [next((w for w in sorted(own, reverse=True) if fits(w, sum(own))), 0) for own in found]
    wide.sort()
    room, k = [0], 0  # of the columns before each, which no later cell widens
    for c in range(columns):
        own = sum(found[c])
        while k < len(wide) and wide[k][0] == c + 1:
            _, a, w = wide[k]
            need = w - (room[c] - room[a]) - 3 * (c - a)
            if need > width[c] and fits(need, own + w):
                width[c] = need
            k += 1
        room.append(room[c] + width[c])
    return width


def number_of(text: str | None, none: int, most: int) -> int:
    try:
        return min(int((text or "").strip()), most)
    except ValueError:
        return none


def list_number(n: int, kind: str | None) -> str:
    """A number as an ordered list of a ``type`` writes it."""
    if kind in ("a", "A") and n > 0:
        letters = ""
        while n:
            n, k = divmod(n - 1, 26)
            letters = chr(ord(kind) + k) + letters
        return letters
    if kind in ("i", "I") and 0 < n < 4000:
        digits = ""
        for k, (one, five, ten) in enumerate(("ivx", "xlc", "cdm", "m  ")):
            d = n // 10**k % 10
            digits = (one * d if d < 4 else one + five if d == 4 else five + one * (d - 5) if d < 9 else one + ten) + digits
        return digits if kind == "i" else digits.upper()
    return str(n)


def opened_list(node: Node) -> list:
    """[is it ordered, its first number, the step, its type]."""
    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    down = node.tag == "ol" and "reversed" in node.attrs
    return [node.tag == "ol", number_of(node.attrs.get("start"), items if down else 1, 10**9), -1 if down else 1, node.attrs.get("type")]


def render(root: Node, styles: list[str], blowup: int = BLOWUP) -> str:
    """The visible text of a tree."""
    sheet = Styles(styles)
    flow, flows = Flow(), []
    tables: list[list] = []  # open tables: their rows
    lists: list[list] = []  # open lists: is it ordered, the next number, the step, the type
    kept = 0  # open elements whose white space stays
    todo: list[tuple[Node | str, bool, bool]] = [(root, True, True)]  # with whether text is visible
    path: list[Node] = []  # the open elements
    foreign = 0  # those of them that are pictures or formulas
    inner_indents: list[str] = []
    shapes: list[tuple[bool, bool]] = []  # of the open elements: whether lines begin and end there, whether it is a list's item
    while todo:
        node, enters, visible = todo.pop()
        if isinstance(node, str):
            if not visible or (tables and flow is tables[-1][1] and not node.strip()):
                continue
            flow.text(node, kept > 0)
            continue
        tag = node.tag
        if enters:
            path.append(node)
            laid_out, visible, display = appearance(path, sheet, visible, foreign)
            if not laid_out or tag in VOID:
                path.pop()
            if not laid_out:
                continue
            if tag == "br":
                flow.end_line(True)
                continue
            if tag == "hr":
                flow.block(2)
                continue
            if tag == "input" and visible and (node.attrs.get("type") or "").lower() in LABELLED:
                flow.text(node.attrs.get("value") or "", False)
            if tag in VOID:
                continue
            block = display in BLOCK_DISPLAYS or tag in BLOCKS and display not in INLINE_DISPLAYS
            item = display == "list-item" and tag not in ("table", "tr") or tag == "li" and display not in INLINE_DISPLAYS and display not in BLOCK_DISPLAYS
            shapes.append((block, item))
            todo.append((node, False, visible))
            foreign += tag in ("svg", "math")
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.extend((c, True, visible) for c in reversed(children))
            if foreign and tag == "text":
                flow.block(1)
            if tag in ("td", "th") and tables:
                flows.append(flow)
                flow = Flow()
                continue
            if block:
                flow.block(2 if tag in APART and not (tag in ("ul", "ol", "menu") and lists) else 1)
            if tag in ("pre", "textarea", "listing"):
                kept += 1
            elif tag in ("ul", "ol", "menu"):
                lists.append(opened_list(node))
            elif item:
                inner_indents.append(flow.indent)
                depth = lists[-1] if lists else [False, 1, 1, None]
                if depth[0] and tag == "li":
                    depth[1] = number_of(node.attrs.get("value"), depth[1], 10**9)
                    flow.marker = f"{list_number(depth[1], node.attrs.get('type') or depth[3])}. "
                    depth[1] += depth[2]
                else:
                    flow.marker = "- "
                if not visible:
                    flow.marker = ""
            elif tag in ("dd", "blockquote"):
                inner_indents.append(flow.indent)
                flow.indent += "  "
            elif tag == "table":
                tables.append([[], flow])
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            continue
        # the element ends
        path.pop()
        block, item = shapes.pop()
        foreign -= tag in ("svg", "math")
        if foreign and tag == "text":
            flow.block(1)
        if tag in ("td", "th") and tables:
            lines, flow = flow.done(), flows.pop()
            rows = tables[-1][0]
            if not rows:
                rows.append([])
            rows[-1].append((lines, max(1, number_of(node.attrs.get("colspan"), 1, MOST_SPAN)), max(1, number_of(node.attrs.get("rowspan"), 1, 65_534))))
        elif tag == "table":
            rows = tables.pop()[0]
            flow.block_lines(table_lines(rows, blowup))
            flow.block(2)
        elif block:
            flow.block(2 if tag in APART and not (tag in ("ul", "ol", "menu") and len(lists) > 1) else 1)
        if tag in ("pre", "textarea", "listing"):
            kept -= 1
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif item or tag in ("dd", "blockquote"):
            flow.indent, flow.marker = inner_indents.pop(), ""
    return "\n".join(flow.done())


def visible_text(html: str, blowup: int = BLOWUP) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root, builder.styles, blowup)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", blowup: int = BLOWUP) -> DataFrame:
    """The id and ``text`` of every page, one row per input row; other columns are left behind. Null and empty pages
    have an empty text; a null id stays null. ``blowup`` bounds the padding of a table's columns by their text (BLOWUP). Pages are independent: no shuffle, and a task holds one at a time
    beside its batch."""
    rows = pages.select(F.col(id_col), F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, htmls in common.text_slices(batch, "__html"):
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([visible_text(x, blowup) for x in htmls], pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, f"{id_col} {common.sql_type(rows, id_col)}, text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_text(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
