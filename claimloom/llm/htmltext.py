"""Operator 1, HTML extraction: the visible text of a page, laid out.

A scanner gives tags and text, in one pass; a tree builder adds what HTML lets
authors leave out (end tags of p, li, dt, dd, option, table parts; a row's table
body) and passes over end tags that close nothing. Rendering walks the tree:

- Invisible: script, style, template, head and the like; the attribute hidden;
  display:none, in a style attribute or in a style sheet's rule (the more
  specific one counts; selectors of tags, classes and ids, below or directly
  below one another; rules for media as they hold on SCREEN); comments; a closed
  dialog, of closed details all but the summary; the options of a drop-down list
  but the chosen one; of an svg all but its texts. Below visibility:hidden
  nothing shows but what is visibility:visible again. What only screen readers
  pass over (aria-hidden) shows.
- Blocks stand on lines of their own, paragraphs and headings after a blank
  line; br ends a line; pre keeps its white space; hr is a rule.
- List items begin with "- " or their number (start, value and reversed count)
  and are indented by depth.
- Tables: cells of a column are padded to one width (that of its widest cell of
  no more than WIDEST characters), joined by " | "; a cell with colspan takes
  that many columns, one with rowspan its place in the rows below, too, within
  its group of rows. Padding is bounded, see laid_out().

Edge cases: null and empty pages give an empty text. A tag that the page's end
cuts off is passed over, as browsers do; "<" before anything but a letter, "/",
"!" or "?" is text. Elements nested deeper than DEEPEST are put beside each
other; their text is kept. Ids go along as they are, null ones too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.markup import RAW, attributes, scan
from claimloom.llm.common import mapped, small_batches

DEEPEST = 150
#: Widest cell that a column is padded for.
WIDEST = 200
#: Columns of a table's grid, and how many times longer than its texts a table may be for being aligned.
COLUMNS, PADDED = 1000, 10
#: Ancestors that are looked at for selectors of several parts, for each character of the page.
LOOKS = 20
#: A compound selector: a tag or *, classes and an id; nothing else is understood.
COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][^\s.#:\[\]+~>*,()]+)*)")
#: The screen that media queries are asked of, in CSS pixels, and what else is true of it.
SCREEN = {"width": 1280.0, "height": 800.0}
FEATURES = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "scripting": "enabled", "update": "fast", "color": ""}
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INVISIBLE = frozenset("head script style template noscript title iframe object audio video canvas datalist noembed noframes annotation annotation-xml rp".split())
#: Elements that stand apart from the text beside them.
APART = frozenset("button textarea".split())
#: Of an svg, only the text in DRAWN shows, unless it's within UNDRAWN.
DRAWN = frozenset("text foreignobject".split())
UNDRAWN = frozenset("defs symbol desc metadata clippath mask marker pattern".split())
#: HTML in these parts of an svg or a formula belongs there; elsewhere a tag of BREAKOUT ends the svg or formula.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Kinds of input fields whose value shows.
SHOWN_INPUT = frozenset(["", *"text search email url tel number submit button reset".split()])
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table ul tr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
CLOSES_P = BLOCK - {"html", "body", "tr", "li", "dd", "dt"}
#: A start tag ends the open elements named, if none of those after them stands in between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: An end tag reaches no further out than these.
SCOPE = {"td", "th", "table", "html", "body"}


class Node:
    __slots__ = ("attributes", "children", "marks", "parent", "tag")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.marks: frozenset | None = None

    def named(self) -> frozenset[str]:
        """The classes and the id, as selectors have them."""
        if self.marks is None:
            attrs = attributes(self.attributes) if self.attributes else {}
            self.marks = frozenset(["." + c for c in attrs.get("class", "").split()] + (["#" + attrs["id"]] if attrs.get("id") else []))
        return self.marks


def build(page: str) -> tuple[Node, list[str]]:
    """The tree, and the texts of its style sheets."""
    root = Node("html")
    stack, sheets = [root], []
    foreign = False

    def close(names: set[str], until: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                # the outermost of the run counts
                j = i
                while j > 1 and stack[j - 1].tag in names:
                    j -= 1
                del stack[j:]
                return
            if stack[i].tag in until:
                return

    for kind, name, rest in scan(page):
        if kind == "text":
            if stack[-1].tag == "style":
                sheets.append(name)
            stack[-1].children.append(name if stack[-1].tag in RAW - {"textarea"} else html.unescape(name) if "&" in name else name)
        elif kind == "start":
            if name in ("html", "head") and len(stack) > 1:
                continue
            within = 0
            if foreign:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in INTEGRATION:
                        break
                    if stack[i].tag in ("svg", "math"):
                        within = i
                if within and name in BREAKOUT:
                    del stack[within:]
                    within = 0
            foreign = foreign or name in ("svg", "math")
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name in CLOSES_P:
                close({"p"}, SCOPE | {"button"})
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", "", stack[-1])
                stack[-1].children.append(row)
                stack.append(row)
            node = Node(name, rest, stack[-1])
            stack[-1].children.append(node)
            if name not in VOID and not (rest.endswith("/") and (within or name in ("svg", "math", "path"))) and len(stack) < DEEPEST:
                stack.append(node)
        else:
            if name == "br":
                stack[-1].children.append(Node("br", "", stack[-1]))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and name not in SCOPE | {"tr", "tbody", "thead", "tfoot"}:
                    break
    return root, sheets


def declared(block: str) -> dict[str, str]:
    """display and visibility as a block of declarations sets them."""
    out = {}
    for declaration in block.split(";"):
        name, _, value = declaration.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            out[name] = value.replace("!important", "").strip().lower()
    return out


def on_screen(query: str) -> bool:
    """Does a media query hold on SCREEN? What isn't understood doesn't."""
    for part in query.lower().split(","):
        terms = [t.strip() for t in re.split(r"\band\b", part)]
        turned = terms[0].startswith("not ")
        terms[0] = re.sub(r"^(not|only)\s+", "", terms[0])
        good = True
        for term in terms:
            if not term.startswith("("):
                good = good and term in ("all", "screen", "")
                continue
            name, _, value = term.strip("() \t\n").partition(":")
            name, value = name.strip(), value.strip()
            bound, _, side = name.rpartition("-")
            size = re.fullmatch(r"(\d+(?:\.\d+)?|\.\d+)(px|em|rem)?", value)
            if bound in ("min", "max") and side in SCREEN and size:
                pixels = float(size[1]) * (16 if size[2] in ("em", "rem") else 1)
                good = good and (SCREEN[side] >= pixels if bound == "min" else SCREEN[side] <= pixels)
            else:
                good = good and name in FEATURES and value in ("", FEATURES[name])
        if good != turned:
            return True
    return False


def selector(text: str) -> list[tuple[str, str, frozenset]] | None:
    """A selector from right to left: (what joins it to the one before, tag, marks); None if it has parts that aren't understood."""
    out: list[tuple[str, str, frozenset]] = []
    for piece in re.sub(r"\s*>\s*", " > ", text).split():
        if piece == ">":
            if not out or out[-1][0] == ">":
                return None
            out.append((">", "", frozenset()))
            continue
        m = COMPOUND.fullmatch(piece)
        if not m or not piece:
            return None
        parent = bool(out) and out[-1][0] == ">" and not out[-1][1] and not out[-1][2]
        if parent:
            out.pop()
        out.append((">" if parent else " ", (m[1] or "*").lower(), frozenset(re.findall(r"[.#][^.#]+", m[2]))))
    return out[::-1] if out and (out[-1][1] or out[-1][2]) else None


def _picks(node: Node, part: tuple[str, str, frozenset]) -> bool:
    return part[1] in ("*", node.tag) and part[2] <= node.named()


class Rules:
    """What sheets declare, by a mark or the tag that an element must have: (specificity and place, selector, declarations)."""

    def __init__(self, sheets: list[str], left: int):
        """left: how many elements may be looked at for selectors of several parts; from then on these pick nothing."""
        self.by: dict[str, list] = {}
        self.left = left
        known: dict[tuple, list] = {}
        place = 0
        for sheet in sheets:
            opened, text = [], ""
            for part in re.split(r"([{}])", re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)):
                if part == "{":
                    opened.append(text.rsplit(";", 1)[-1].strip())
                    text = ""
                elif part == "}":
                    chosen = opened.pop() if opened else "@"
                    found = declared(text) if not chosen.startswith("@") else {}
                    if found and all(not x.lower().startswith("@media") or on_screen(x[6:].strip()) for x in opened):
                        for one in chosen.split(","):
                            parts = selector(one.strip())
                            if parts:
                                place += 1
                                ids = sum(m[0] == "#" for p in parts for m in p[2])
                                weight = (ids, sum(len(p[2]) for p in parts) - ids, sum(p[1] != "*" for p in parts), place)
                                if tuple(parts) not in known:
                                    known[tuple(parts)] = [weight, parts, {}]
                                    self.by.setdefault(min(parts[0][2]) if parts[0][2] else parts[0][1], []).append(known[tuple(parts)])
                                known[tuple(parts)][0] = weight
                                known[tuple(parts)][2].update(found)
                    text = ""
                else:
                    text = part

    def fits(self, node: Node, parts: list[tuple[str, str, frozenset]]) -> bool:
        """Does a selector pick an element? Of each part all ancestors are kept that it could mean, so no search goes back."""
        if not _picks(node, parts[0]):
            return False
        here = [node]
        for (joined, _, _), part in zip(parts, parts[1:]):
            found: dict[int, Node] = {}
            for n in here:
                up = n.parent
                while up is not None and id(up) not in found and self.left > 0:
                    self.left -= 1
                    if _picks(up, part):
                        found[id(up)] = up
                    if joined == ">":
                        break
                    up = up.parent
            here = list(found.values())
        return bool(here)

    def of(self, node: Node) -> dict[str, str]:
        met = [r for key in (*node.named(), node.tag, "*") for r in self.by.get(key, ()) if self.fits(node, r[1])]
        out: dict[str, str] = {}
        for _, _, found in sorted(met, key=lambda r: r[0]):
            out.update(found)
        return out


def options(node: Node, off: bool = False) -> Iterator[tuple[Node, dict[str, str], bool]]:
    """(option, attributes, is it disabled) of a list, in order."""
    for child in node.children:
        if not isinstance(child, str):
            attrs = attributes(child.attributes)
            if child.tag == "option":
                yield child, attrs, off or "disabled" in attrs
            else:
                yield from options(child, off or child.tag == "optgroup" and "disabled" in attrs)


def shown(node: Node, attrs: dict[str, str]) -> list[tuple[Node, dict[str, str]]]:
    """Options that a list shows: all those of a list box, of a drop-down list the last selected or else the first not disabled."""
    found = list(options(node))
    size = attrs.get("size", "").strip()
    if "multiple" in attrs or (size.isdigit() and int(size[:9]) > 1):
        return [x[:2] for x in found]
    return [x[:2] for x in found if "selected" in x[1]][-1:] or [x[:2] for x in found if not x[2]][:1]


class Renderer:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.visible = True
        self.counts = {"blocks": 0, "items": 0, "tables": 0, "cells": 0, "hidden": 0}

    def hidden(self, node: Node, attrs: dict[str, str]) -> bool:
        return "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs) or self.style(node, attrs).get("display") == "none"

    def style(self, node: Node, attrs: dict[str, str]) -> dict[str, str]:
        """display and visibility of an element, as far as anything sets them."""
        out = self.rules.of(node) if self.rules.by else {}
        if "style" in attrs:
            out.update(declared(attrs["style"]))
        return out

    def enter(self, node: Node, attrs: dict[str, str]) -> bool:
        """Sets whether the element's own text is visible; gives what held before."""
        before, own = self.visible, self.style(node, attrs).get("visibility")
        if own in ("hidden", "collapse"):
            self.counts["hidden"] += before
            self.visible = False
        elif own == "visible":
            self.visible = True
        return before

    def lines(self, node: Node, depth: int = 0, keep: bool = False) -> list[str]:
        """The element's lines; an empty line asks for a blank one there."""
        out: list[str] = []
        inline: list[str] = []
        step = 1
        number = 0
        if node.tag == "ol":
            own = attributes(node.attributes) if node.attributes else {}
            step = -1 if "reversed" in own else 1
            first = whole(own.get("start"))
            number = (sum(not isinstance(c, str) and c.tag == "li" for c in node.children) if step < 0 else 1) - step if first is None else first - step
        # of a closed details element the first summary shows
        shut = node.tag == "details" and "open" not in (attributes(node.attributes) if node.attributes else {})

        def flush() -> None:
            text = "".join(inline)
            inline.clear()
            if keep:
                out.extend(text.split("\n") if text.strip() else [])
                return
            for line in text.split("\0"):
                line = SPACE.sub(" ", line).strip(" ")
                if line:
                    out.append(line)

        def draw(children: list) -> None:
            for child in children:
                if isinstance(child, str):
                    continue
                attrs = attributes(child.attributes)
                if child.tag in INVISIBLE or child.tag in UNDRAWN or self.hidden(child, attrs):
                    self.counts["hidden"] += child.tag != "title"
                    continue
                before = self.enter(child, attrs)
                if child.tag in DRAWN:
                    inline.append(" ")
                    walk(child.children)
                    inline.append(" ")
                else:
                    draw(child.children)
                self.visible = before

        def walk(children: list) -> None:
            nonlocal number
            for child in children:
                if isinstance(child, str):
                    if self.visible:
                        inline.append(child.replace("\0", "") if "\0" in child else child)
                    continue
                tag = child.tag
                if tag == "br":
                    inline.append("\n" if keep else "\0")
                    continue
                if tag in INVISIBLE:
                    self.counts["hidden"] += tag not in ("head", "title")
                    continue
                attrs = attributes(child.attributes) if child.attributes else {}
                if self.hidden(child, attrs):
                    self.counts["hidden"] += 1
                    continue
                before = self.enter(child, attrs)
                if tag in APART:
                    inline.append(" ")
                if tag in ("img", "input"):
                    shown_text = attrs.get("alt") if tag == "img" else attrs.get("value") if attrs.get("type", "").strip().lower() in SHOWN_INPUT else None
                    if shown_text and self.visible:
                        inline.append(f" {shown_text} ")
                elif tag == "svg":
                    draw(child.children)
                elif tag == "select":
                    for option, own_attrs in shown(child, attrs):
                        inline.append(" ")
                        walk([own_attrs["label"]] if own_attrs.get("label") else option.children)
                        inline.append(" ")
                elif tag == "hr":
                    flush()
                    out.extend(["---"] if self.visible else [])
                elif tag == "table":
                    flush()
                    self.counts["tables"] += 1
                    out.extend(["", *self.table(child, depth), ""])
                elif tag == "li":
                    flush()
                    self.counts["items"] += 1
                    told = whole(attrs.get("value")) if node.tag == "ol" else None
                    number = number + step if told is None else told
                    mark = f"{number}. " if node.tag == "ol" else "- "
                    own = [x for x in self.lines(child, depth + 1) if x]
                    if own:
                        out.append(mark + own[0])
                        out.extend("  " + x for x in own[1:])
                elif tag in BLOCK:
                    flush()
                    self.counts["blocks"] += 1
                    own = self.lines(child, depth + 1, keep or tag == "pre")
                    if tag == "blockquote":
                        own = [f"> {x}" if x else x for x in own]
                    if tag == "dd":
                        own = [f"  {x}" if x else x for x in own]
                    out.extend(["", *own, ""] if tag in SPACED else own)
                else:
                    walk(child.children)
                if tag in APART:
                    inline.append(" ")
                self.visible = before

        walk([c for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1] if shut else [node] if node.tag in ("svg", "select") else node.children)
        flush()
        return out

    def table(self, node: Node, depth: int) -> list[str]:
        captions: list[str] = []
        rows: list[tuple[int, list[tuple[str, int, int]]]] = []
        group = 0

        def gather(children: list) -> None:
            nonlocal group
            loose = []
            for child in children:
                if isinstance(child, str):
                    if child.strip() and self.visible:
                        loose.append(child)
                    continue
                attrs = attributes(child.attributes)
                if child.tag in INVISIBLE or self.hidden(child, attrs):
                    self.counts["hidden"] += 1
                    continue
                before = self.enter(child, attrs)
                if child.tag in ("tbody", "thead", "tfoot"):
                    group += 1
                    gather(child.children)
                    group += 1
                elif child.tag == "tr":
                    row(child)
                else:
                    captions.extend(x for x in self.lines(child, depth + 1) if x)
                self.visible = before
            captions.extend(SPACE.sub(" ", x).strip() for x in loose)

        def row(node: Node) -> None:
            cells = []
            for cell in node.children:
                if isinstance(cell, str):
                    if cell.strip() and self.visible:
                        captions.append(SPACE.sub(" ", cell).strip())
                    continue
                attrs = attributes(cell.attributes)
                if cell.tag in INVISIBLE or self.hidden(cell, attrs):
                    self.counts["hidden"] += 1
                    continue
                before = self.enter(cell, attrs)
                self.counts["cells"] += 1
                cells.append((" ".join(x for x in self.lines(cell, depth + 1) if x), span(attrs, "colspan", 100), span(attrs, "rowspan", 65534)))
                self.visible = before
            rows.append((group, cells))

        gather(node.children)
        return captions + laid_out(rows)


def laid_out(rows: list[tuple[int, list[tuple[str, int, int]]]]) -> list[str]:
    """Lines of a table from rows of (text, columns, rows); cells of one column begin at one place.

    A cell that reaches into the rows below does so within its group of rows.
    A row is as long as it takes to
    reach its last cell with text; where that would make the table more than
    PADDED times as long as its texts and bars, its cells stand without padding.
    """
    until = np.zeros(COLUMNS + 101, np.int64)  # of each column, the first row that a cell from above leaves free
    placed: list[list[tuple[int, int, str]]] = []
    last = None
    for r, (group, cells) in enumerate(rows):
        if group != last:
            until[:] = 0
            last = group
        free = np.flatnonzero(until <= r)
        at, line = 0, []
        for text, across, down in cells:
            k = int(np.searchsorted(free, at))
            begin = int(free[k]) if k < len(free) and at < COLUMNS else COLUMNS  # what is beyond them stands in the last one
            end = min(begin + across, COLUMNS + 1)
            line.append((begin, end, text))
            if down > 1:
                until[begin:end] = np.maximum(until[begin:end], r + down)
            at = end
        placed.append(line)
    width = [0] * max((e for line in placed for _, e, _ in line), default=0)
    for line in placed:
        for b, e, text in line:
            if e - b == 1 and len(text) <= WIDEST:
                width[b] = max(width[b], len(text))
    room = np.concatenate([[0], np.cumsum(np.array(width, np.int64) + 3)])
    lines = []
    for line in placed:
        while line and not line[-1][2]:
            line.pop()
        if line:
            lines.append(line)
    long = sum(int(room[line[-1][0]]) for line in lines)
    if long > PADDED * sum(len(t) + 3 for line in lines for _, _, t in line) + WIDEST:
        return [" | ".join(t for _, _, t in line if t) for line in lines]
    out = []
    for line in lines:
        at, cells = 0, []
        for b, e, text in line:
            cells += [" " * w for w in width[at:b]]
            cells.append(text.ljust(int(room[e] - room[b]) - 3))
            at = e
        out.append(" | ".join(cells).rstrip())
    return out


def whole(value: str | None) -> int | None:
    """A whole number of up to nine digits, as the attributes start and value have it."""
    m = re.match(r"\s*([+-]?[0-9]{1,9})(?![0-9])", value or "")
    return int(m[1]) if m else None


def span(attrs: dict[str, str], name: str, most: int) -> int:
    """How many columns or rows a cell takes."""
    value = attrs.get(name, "").strip()
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def render(page) -> tuple[str, dict[str, int]]:
    """Text and counts of a page."""
    if not isinstance(page, str) or not page:
        return "", {"blocks": 0, "items": 0, "tables": 0, "cells": 0, "hidden": 0}
    root, sheets = build(page)
    renderer = Renderer(Rules(sheets, LOOKS * max(1000, len(page))))
    out: list[str] = []
    for line in renderer.lines(root):
        line = line.rstrip()
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip("\n"), renderer.counts


SCHEMA = "page_id long, text string, n_chars long, n_blocks long, n_items long, n_tables long, n_cells long, n_hidden long"


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of pages (page_id, html): page_id, text, counts of what was laid out."""

    def make():
        def rendered(batch: pd.DataFrame) -> pd.DataFrame:
            got = [render(page) for page in batch["html"]]
            out = {"text": [text for text, _ in got], "n_chars": [len(text) for text, _ in got]}
            return pd.DataFrame(out | {f"n_{x}": [n[x] for _, n in got] for x in ("blocks", "items", "tables", "cells", "hidden")})

        return rendered

    return mapped(small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("html")), ["page_id"], make, SCHEMA)
