"""Text of HTML pages as a reader sees it.

A page is parsed into a tree, with the tags that HTML lets authors leave out: a paragraph ends where
a block begins, list items, table parts and options end where the next begins, rows and cells get
the table parts around them, and what stands in a table outside of cells moves in front of it. Then
the visible part of the tree is rendered: blocks on lines of their own, paragraphs and the like with
an empty line between them, list items with a bullet or number and indented, preformatted text as
it is, and table cells in aligned columns.

Hidden is what an attribute or a style sheet hides by display or visibility on a screen. Of a style
sheet count the rules for a tag, classes and an id of one element, without combinators and pseudo
classes; the last of the most specific ones wins, important ones first. Bodies of at-rules count if
they hold for a screen of ``SCREEN`` size (media) or always (supports, layer). The text of drawings
and formulas is emitted, but not their titles, definitions and annotations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from pitchspark.llm.common import extended, fresh

# Widest table column that cells are aligned to; longer cells move what follows them.
COLUMN_WIDTH = 80
# Lists and quotations within as many others are indented no further.
INDENTED = 32
# Width and height in CSS pixels that media queries are held against.
SCREEN = (1280, 800)

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
ESCAPABLE = frozenset("textarea title".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table "
    "ul li dd dt search xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
NEVER_SHOWN = frozenset(
    "head script style template noscript title meta link datalist iframe noembed noframes object "
    "audio video canvas rp area base param source track col colgroup map".split()
)
# In drawings; their text stands in <text> only.
NEVER_DRAWN = frozenset(
    "desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split()
)
NEVER_IN_FORMULAS = frozenset("annotation annotation-xml".split())
# Parts of a formula that stand apart.
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtr mtable".split())
# Start tags that end a drawing or formula.
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
    "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
# In which HTML may stand.
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
# With an empty line around them, and only on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr xmp".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center details dialog div dd dt figcaption footer form header "
    "hgroup legend li main nav option optgroup search section summary caption select tr td th thead "
    "tbody tfoot textarea".split()
)
LISTS = frozenset("ul ol menu dir".split())

# A start tag ends open elements of the first kind, up to the nearest of the second.
_CELLS, _PARTS = ("td", "th"), ("thead", "tbody", "tfoot")
IMPLIED_ENDS = {
    "li": (("li",), tuple(LISTS)),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (_CELLS, ("tr", "table")),
    "th": (_CELLS, ("tr", "table")),
    "tr": (("tr", *_CELLS, "caption", "colgroup"), ("table",)),
    **{p: ((*_PARTS, "tr", *_CELLS, "caption", "colgroup"), ("table",)) for p in (*_PARTS, "caption", "colgroup")},
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
    "a": (("a",), ("table", "td", "th", "body")),
    "button": (("button",), ("table", "td", "th", "body")),
}
# An end tag doesn't reach beyond these.
WALLS = frozenset("table td th caption html template".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Parts of a selector on attributes and pseudo classes, and those that no page is in by itself.
_QUALIFIERS = re.compile(r"\[[^\]]*\]|::?[\w-]+(?:\([^)]*\))?")
_STATES = re.compile(r"(?i):(?:hover|focus[\w-]*|active|target|checked|visited|open|before|after|print)\b")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#]-?[a-zA-Z_][\w-]*)*)")
_PART = re.compile(r"[.#][\w-]+")
_DECLARATION = re.compile(
    r"\s*(?:(display)\s*:\s*(none|block|contents|list-item|flow(?:-root)?|run-in|(?:inline|block|ruby|table|flex|grid)"
    r"[a-z -]*|initial|inherit|unset|revert(?:-layer)?)|(visibility)\s*:\s*(visible|hidden|collapse|initial|inherit"
    r"|unset|revert(?:-layer)?))\s*(!\s*important)?\s*", re.I
)
_CLOSES_ITSELF = re.compile(r"""(?:^|["'\s]|(?:^|\s)[^\s"'=]+)/$""")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)
_AT_RULE = re.compile(r"@([\w-]*)\s*(.*)", re.S)
_LENGTH = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+))(px|em|rem|pt|pc|in|cm|mm|q|)")
_UNITS = {"px": 1, "": 1, "em": 16, "rem": 16, "pt": 4 / 3, "pc": 16, "in": 96, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "q": 2.4 / 2.54}
_OF_SCREEN = {
    "orientation": ("landscape",), "prefers-color-scheme": ("light",), "prefers-reduced-motion": ("no-preference",),
    "prefers-contrast": ("no-preference",), "hover": ("hover",), "any-hover": ("hover",), "pointer": ("fine",),
    "any-pointer": ("fine", "coarse"), "scripting": ("enabled",), "update": ("fast",), "grid": ("0",),
    "display-mode": ("browser",), "forced-colors": ("none",), "color": (),
}


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html", {}, None)
        self.open = [self.root]
        # How many elements of a tag are open: most searches for one can be left out.
        self.depth: Counter[str] = Counter()
        self.rules: list[str] = []

    def _pop_to(self, place: int) -> None:
        self.depth.subtract(node.tag for node in self.open[place:])
        del self.open[place:]

    def _place(self, foster: bool) -> tuple[Node, int]:
        """Where the next child goes."""
        here = self.open[-1]
        if foster:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "table":
                    above = self.open[i].parent
                    return above, above.kids.index(self.open[i])
        return here, len(here.kids)

    def _push(self, tag: str, attrs: dict[str, str], foster: bool = False) -> None:
        parent, at = self._place(foster)
        node = Node(tag, attrs, parent)
        parent.kids.insert(at, node)
        if tag not in VOID:
            self.open.append(node)
            self.depth[tag] += 1

    def text(self, text: str) -> None:
        here = self.open[-1].tag
        if here in ("table", "thead", "tbody", "tfoot", "tr", "colgroup"):
            if not text.isspace():
                parent, at = self._place(True)
                parent.kids.insert(at, text)
        else:
            if here == "head" and not text.isspace():
                self._pop_to(len(self.open) - 1)
            self.open[-1].kids.append(text)

    def foreign(self) -> int:
        """The place of the drawing or formula whose parts come next, 0 if HTML does."""
        if self.depth["svg"] or self.depth["math"]:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in ("svg", "math"):
                    return i
                if self.open[i].tag in HOLDS_HTML:
                    return 0
        return 0

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ENDS_FOREIGN and (place := self.foreign()):
            self._pop_to(place)
        if tag in ("html", "body"):
            if self.open[-1].tag == "head":
                self._pop_to(len(self.open) - 1)
            self.root.attrs = attrs | self.root.attrs
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._pop_to(len(self.open) - 1)
        if tag in IMPLIED_ENDS and any(self.depth[t] for t in IMPLIED_ENDS[tag][0]):
            ends, walls = IMPLIED_ENDS[tag]
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i].tag
                if name in walls:
                    break
                if name in ends:
                    self._pop_to(i)
                    if tag not in ("tr", "caption", "colgroup", *_PARTS):
                        break
        if tag in ENDS_PARAGRAPH:
            for i in range(len(self.open) - 1, 0, -1) if self.depth["p"] else ():
                name = self.open[i].tag
                if name in WALLS or name == "button":
                    break
                if name == "p":
                    self._pop_to(i)
                    break
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self._pop_to(len(self.open) - 1)
        here = self.open[-1].tag
        if tag in ("td", "th") and here in ("table", *_PARTS):
            if here == "table":
                self._push("tbody", {})
            self._push("tr", {})
        elif tag == "tr" and here == "table":
            self._push("tbody", {})
        elif tag in ("td", "th", "tr", "caption", *_PARTS) and not self.depth["table"]:
            return  # parts of no table
        inside = here in ("table", "thead", "tbody", "tfoot", "tr")
        self._push(tag, attrs, foster=inside and tag not in IN_TABLE)

    def end(self, tag: str) -> None:
        if tag == "br":
            self._push("br", {})
            return
        if tag in HEADINGS:
            match = HEADINGS
        else:
            match = (tag,)
        if not any(self.depth[t] for t in match):
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if name in match:
                self._pop_to(i)
                return
            if name in WALLS and tag not in ("table", "tr", *_PARTS, *_CELLS):
                return
            if name == "table":
                return


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style sheets."""
    build, at, pattern, lower = _Builder(), 0, _TAG, None
    # Behind the last one no tag ends, so none is looked for.
    last = html.rfind(">")
    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            begin = len(html)
        if begin > at:
            text = html[at:begin]
            build.text(unescape(text) if "&" in text else text)
            at = begin
            continue
        follows = html[at + 1 : at + 2]
        if follows == "!" or follows == "?":
            stop = "-->" if html.startswith("<!--", at) else ">"
            if html.startswith("<![CDATA[", at):
                stop = "]]>"
            end = html.find(stop, at + 2)
            at = len(html) if end < 0 else end + len(stop)
            continue
        match = pattern.match(html, at) if at < last else None
        if match is None and at < last and follows.isalpha() | (follows == "/") and pattern is _TAG:
            # A quote that never ends: from here on quotes mean nothing.
            match = _PLAIN_TAG.match(html, at)
            if match is not None:
                pattern = _PLAIN_TAG
        if match is None:
            if follows == "/":
                end = html.find(">", at)
                at = len(html) if end < 0 else end + 1
            else:
                build.text("<")
                at += 1
            continue
        at, tag = match.end(), match[2].lower()
        if match[1]:
            build.end(tag)
            continue
        attrs = {}
        if match[3]:
            for name, *values in _ATTRIBUTE.findall(match[3]):
                attrs.setdefault(name.lower(), unescape(next(filter(None, values), "")))
        foreign = build.foreign()
        build.start(tag, attrs)
        if (foreign or tag in ("svg", "math")) and _CLOSES_ITSELF.search(match[3]):
            build.end(tag)
            continue
        if tag in RAW or tag in ESCAPABLE:
            if lower is None:
                lower = html.lower()
                if len(lower) != len(html):  # a letter whose lower case is longer
                    lower = "".join(c.lower() if c.isascii() else c for c in html)
            end = len(html) if tag == "plaintext" else lower.find(f"</{tag}", at)
            end = len(html) if end < 0 else end
            text = html[at:end]
            if tag == "style" and on_screen(attrs.get("media", "")):
                build.rules.append(text)
            if text and build.open[-1].tag == tag:
                build.open[-1].kids.append(unescape(text) if tag in ESCAPABLE else text)
            build.end(tag)
            close = html.find(">", end)
            at = len(html) if close < 0 else close + 1
    return build.root, build.rules


def _feature(text: str) -> bool | None:
    """Whether a media feature holds for the screen; None if it isn't known."""
    text = text.strip().lower()
    sides = re.split(r"\s*(<=|>=|<|>|=|:)\s*", text)
    if len(sides) == 1:
        return True if text in ("width", "height", *_OF_SCREEN) and text != "grid" else None
    if sides[1] == ":":
        name, value = sides[0], "".join(sides[2:]).strip()
        if name in _OF_SCREEN:
            return value in _OF_SCREEN[name]
        kind = {"min": ">=", "max": "<="}.get(name[:3])
        sides = [name[4:], kind, value] if kind and name[3:4] == "-" else [name, "=", value]
    numbers = []
    for side in sides[::2]:
        side = side.removeprefix("device-")
        found = _LENGTH.fullmatch(side)
        if side in ("width", "height"):
            numbers.append(SCREEN[side == "height"])
        elif found and (found[2] or float(found[1]) == 0):
            numbers.append(float(found[1]) * _UNITS[found[2]])
        else:
            return None
    compare = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__}
    return all(compare[c](float(x), float(y)) for x, c, y in zip(numbers, sides[1::2], numbers[1:]))


def _condition(tokens: list[str]) -> bool | None:
    """Of media types and features in brackets, with not, and, or; takes its tokens away."""
    found, how, negate = None, None, False
    while tokens:
        token = tokens.pop(0)
        if token == ")":
            break
        if token == "(":
            if tokens and tokens[0] not in ("(", "not") and not tokens[0].startswith("not "):
                value, closed = _feature(tokens.pop(0)), tokens and tokens.pop(0)
                value = value if closed in (")", []) else None
            else:
                value = _condition(tokens)
        elif token in ("and", "or"):
            how = token
            continue
        elif token in ("not", "only"):
            negate ^= token == "not"
            continue
        else:
            value = token in ("all", "screen")
        if negate and how is None and tokens and tokens[0] == "and":
            # not <type> and ... negates all of it.
            rest = _condition(["all", *tokens])
            tokens.clear()
            value = value and rest
        if negate:
            value, negate = None if value is None else not value, False
        if how is None:
            found = value
        elif how == "and":
            found = False if False in (found, value) else None if None in (found, value) else True
        else:
            found = True if True in (found, value) else None if None in (found, value) else False
    return found


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for the screen; one that isn't understood doesn't."""
    media = _COMMENT.sub(" ", media).strip().lower()
    if not media:
        return True
    for query in media.split(","):
        tokens = []
        for part in re.split(r"([()])", query):
            if part.strip():
                inside = bool(tokens) and tokens[-1] == "(" and not re.match(r"\s*not\b", part)
                tokens += [part.strip()] if inside else part.split()
        if _condition(tokens):
            return True
    return False


def _declared(body: str) -> dict[str, tuple[bool, str]]:
    """Display and visibility as a list of declarations has them, with their importance."""
    found = {}
    if "display" in (lower := body.lower()) or "visibility" in lower:
        for one in body.split(";"):
            if match := _DECLARATION.fullmatch(one):
                name, value = (match[1] or match[3]).lower(), (match[2] or match[4]).lower()
                if match[5] or not found.get(name, (False,))[0]:
                    found[name] = bool(match[5]), value
    return found


Rules = dict[str, list[tuple[tuple, str, frozenset, dict]]]


def rules_of(sheets: list[str]) -> Rules:
    """Rules on display and visibility, by one part of their selectors: precedence without the
    importance, tag, other parts and declarations."""
    rules: Rules = {}
    for sheet in sheets:
        sheet = _STRING.sub('""', _COMMENT.sub(" ", sheet))
        lower = sheet.lower()
        if "display" not in lower and "visibility" not in lower:
            continue
        # Whether the blocks around are read, and where the prelude or declaration begins.
        blocks, at, skip = [], 0, 0
        for mark in re.finditer(r"[{};]", sheet):
            text, at = sheet[at : mark.start()].strip(), mark.end()
            if mark[0] == "{":
                if skip or (blocks and blocks[-1] is not None):
                    skip += 1  # in what isn't read, and rules in rules
                elif text.startswith("@"):
                    name, rest = _AT_RULE.match(text).groups()
                    name = name.lower()
                    if name == "media" and on_screen(rest) or name == "layer" or (
                        name == "supports" and not rest.lower().startswith("not")
                    ):
                        blocks.append(None)
                    else:
                        skip += 1
                else:
                    blocks.append((text, []))
            elif skip:
                skip -= mark[0] == "}"
            elif blocks and blocks[-1] is not None:
                blocks[-1][1].append(text)
                if mark[0] == "}":
                    _add_rule(rules, *blocks.pop())
            elif mark[0] == "}" and blocks:
                blocks.pop()
        if blocks and blocks[-1] is not None:  # never closed
            selectors, body = blocks.pop()
            _add_rule(rules, selectors, [*body, sheet[at:] if not skip else ""])
    return rules


def _add_rule(rules: Rules, selectors: str, body: list[str]) -> None:
    declared = _declared(";".join(body))
    if not declared:
        return
    order = sum(map(len, rules.values()))
    shows = {k: v for k, v in declared.items() if v[1] not in ("none", "hidden", "collapse")}
    for one in selectors.split(","):
        match, use = _SELECTOR.fullmatch(one.strip()), declared
        if shows and not match and not _STATES.search(one):
            # What stands before the last element isn't read: where it may hold, the text is shown.
            last = re.split(r"[\s>+~]+", _QUALIFIERS.sub("", one).strip())[-1].removeprefix("*")
            match, use = _SELECTOR.fullmatch(last), shows
            if match and not match[0]:
                rules.setdefault("*", []).append(((0, 0, 1, False, order), "", frozenset(), shows))
        if match and match[0]:
            tag, parts = (match[1] or "").lower(), _PART.findall(match[2])
            ids = sum(x[0] == "#" for x in parts)
            rank = (0, ids, len(parts) - ids, bool(tag), order)
            rules.setdefault(parts[0] if parts else tag, []).append((rank, tag, frozenset(parts), use))


def _seen(node: Node, rules: Rules, visible: bool) -> bool | None:
    """Whether an element is visible, if its parent is or isn't; None if it goes with all in it."""
    tag, attrs = node.tag, node.attrs
    if tag in NEVER_SHOWN:
        return None
    if tag == "input" and attrs.get("type", "").lower() not in ("submit", "button", "reset"):
        return None
    best = {}
    if "hidden" in attrs or tag == "dialog" and "open" not in attrs:
        best["display"] = (False, (-1,)), "none"
    found = [((1,), _declared(attrs["style"]))] if "style" in attrs else []
    if rules:
        own = {f".{c}" for c in attrs.get("class", "").split()}
        if "id" in attrs:
            own.add(f"#{attrs['id']}")
        for key in ("*", tag, *own):
            for rank, of, parts, declared in rules.get(key, ()):
                if of in ("", tag) and parts <= own:
                    found.append((rank, declared))
    for rank, declared in found:
        for name, (important, value) in declared.items():
            if name not in best or (important, rank) >= best[name][0]:
                best[name] = (important, rank), value
    if best.get("display", (0, ""))[1] == "none":
        return None
    value = best.get("visibility", (0, ""))[1]
    if value in ("visible", "initial"):
        return True
    return visible and value not in ("hidden", "collapse")


class _Flow:
    """Lines as they grow."""

    __slots__ = ("gap", "lines", "now", "space")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space = 0, False

    def text(self, text: str) -> None:
        words = text.split()
        if not words:
            self.space = self.space or bool(self.now and text)
            return
        if self.now and (self.space or text[0].isspace()):
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = text[-1].isspace()

    def exact(self, text: str) -> None:
        first, *more = text.expandtabs().split("\n")
        self.now.append(first)
        for line in more:
            self.line(keep=True)
            self.now.append(line)

    def line(self, keep: bool = False) -> None:
        """End the line; an empty one only if it is to be kept."""
        text = "".join(self.now)
        self.now, self.space = [], False
        if keep or text.strip():
            self.add([text.rstrip()])

    def add(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines += lines

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap = self.gap or int(spaced)

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _number(text: str | None, usual: int, most: int) -> int:
    try:
        return max(0, min(most, int(text.strip())))
    except (AttributeError, ValueError):
        return usual


def _table(rows: list[list[tuple[int, int, list[str]]]], caption: list[str]) -> list[str]:
    """Lines of a table from its rows of (columns, rows, lines) cells."""
    placed, busy, widths = [], {}, {}
    for cells in rows:
        column, row = 0, []
        for across, down, lines in cells:
            while busy.get(column, 0) > 0:
                busy[column] -= 1
                column += 1
            row.append((column, lines))
            width = max(map(len, lines), default=0)
            if across == 1:
                widths[column] = max(widths.get(column, 0), min(width, COLUMN_WIDTH))
            else:
                widths.setdefault(column, min(1, width))
            if down > 1:
                for i in range(column, column + across):
                    busy[i] = down - 1
            column += across
        for i in [i for i in busy if i >= column and busy[i] > 0]:
            busy[i] -= 1
        placed.append(row)
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2 * (widths[column] > 0)
    out = list(caption)
    for row in placed:
        for i in range(max((len(lines) for _, lines in row), default=0)):
            line = ""
            for column, lines in row:
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts[column])
                    if line and line[-1] != " ":
                        line += "  "
                    line += lines[i]
            out.append(line.rstrip())
    return out


def render(root: Node, rules: Rules) -> str:
    """The text of all that is visible in a tree."""
    flow, flows, tables, lists, pre = _Flow(), [], [], [], 0
    # With whether it is left, whether what is around it is visible, and if that is a drawing, its
    # text, or a formula.
    work: list[tuple[Node | str, bool, bool, str]] = [(root, False, True, "")]
    while work:
        node, leaving, visible, within = work.pop()
        if isinstance(node, str):
            if node and visible and within != "svg":
                flow.exact(node) if pre else flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            if node.attrs or rules or tag in NEVER_SHOWN or tag == "dialog":
                visible = _seen(node, rules, visible)
                if visible is None:
                    continue
            if within in ("svg", "text") and tag in NEVER_DRAWN or within == "math" and tag in NEVER_IN_FORMULAS:
                continue
            if tag in ("svg", "math"):
                within = tag
            elif within == "svg" and tag in ("text", "foreignobject"):
                flow.text(" ")
                within = "text" if tag == "text" else ""
            elif within == "math" and node.parent.tag in APART:
                flow.text(" ")
            if tag == "br":
                if visible:
                    flow.line(keep=True)
                continue
            if tag == "input":
                if visible:
                    flow.text(f" {node.attrs.get('value', '')} ")
                continue
            if tag in BLOCKS:
                flow.block(tag in SPACED and not (tag in LISTS and lists))
            if tag in LISTS:
                start = node.attrs.get("start")
                lists.append(_number(start, 1, 10**9) if tag == "ol" else None)
            elif tag == "table":
                tables.append(([], []))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "q" and visible:
                flow.now.append('"')
            if tag in ("li", "td", "th", "blockquote", "dd", "table", "caption"):
                flows.append((flow, lists, pre))
                flow, pre = _Flow(), 0
                lists = lists if tag == "li" else []
            work.append((node, True, visible, within))
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
            work.extend((kid, False, visible, within) for kid in reversed(kids))
            continue
        if tag in ("li", "td", "th", "blockquote", "dd", "table", "caption"):
            lines = flow.done()
            while lines and not lines[-1]:
                lines.pop()
            flow, lists, pre = flows.pop()
            if tag == "li":
                mark = "- "
                if lists and lists[-1] is not None:
                    value = _number(node.attrs.get("value"), lists[-1], 10**9)
                    mark, lists[-1] = f"{value}. ", value + 1
                if lines:
                    pad = " " * len(mark) * (len(flows) < INDENTED)
                    flow.add([mark + lines[0], *[pad * bool(x) + x for x in lines[1:]]])
            elif tag in ("td", "th"):
                if tables and tables[-1][0]:
                    across = _number(node.attrs.get("colspan"), 1, 1000) or 1
                    down = _number(node.attrs.get("rowspan"), 1, 65534) or 1
                    tables[-1][0][-1].append((across, down, lines))
                else:
                    flow.add(lines)
            elif tag == "caption":
                tables[-1][1].extend(lines) if tables else flow.add(lines)
            elif tag == "table":
                rows, caption = tables.pop()
                flow.add([*lines, *_table(rows, caption)])
            else:
                flow.add([("    " * (bool(x) and len(flows) < INDENTED)) + x for x in lines])
        if tag in LISTS:
            lists.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag == "q" and visible:
            flow.now.append('"')
        elif tag in ("text", "foreignobject") and node.parent and within != "math":
            flow.text(" " * (within == "text" or tag == "foreignobject"))
        if tag in BLOCKS:
            flow.block(tag in SPACED and not (tag in LISTS and lists))
    lines = flow.done()
    return "\n".join(lines).strip("\n")


def page_text(html: str | None) -> str:
    """The visible text of a page; empty for a null or empty one."""
    if not html:
        return ""
    root, sheets = parse(html)
    return render(root, rules_of(sheets))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row of ``pages`` with the column text in place of its HTML, renamed with a leading _
    where it has such a column. A null page has an empty text. No row gives no row."""
    keep = [c for c in pages.columns if c != html]
    kept = pages.select(*keep) if keep else pages.select()
    name = fresh(kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([page_text(x.as_py()) for x in batch.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], texts], names=[*keep, name])

    return pages.mapInArrow(run, extended(kept.schema, f"`{name}` string"))
