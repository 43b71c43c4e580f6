"""HTML to Markdown for one document: a tolerant parser for real-world markup.

This is the per-row helper of the Python stage. ``functions/markup.py`` is the same
mapping as column expressions for simple markup; the two are checked against each
other on every page of the test tables.
"""

from __future__ import annotations

import re
from html import unescape

# Markdown spelling of the inline and block elements.
INLINE_MARKS = {
    "em": "_", "i": "_", "u": "_",
    "strong": "**", "b": "**",
    "del": "~~", "strike": "~~", "s": "~~",
    "code": "`", "kbd": "`", "tt": "`",
    "q": '"',
}
CODE = ("code", "kbd", "tt")
STRESS = ("em", "i", "u", "strong", "b", "del", "strike", "s")
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
BLOCKS = ("p", "div")
HIDDEN = ("head", "script", "style")

# Comments, tags and declarations. A quote only counts after ``=``, so a stray one cannot
# swallow the text behind it; the repeat never gives back, so broken markup costs no more.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^<>])*+)>"
    r"|<[!?/][^<>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}
_WITH_ATTRIBUTES = ("a", "img", "ol")

_BLANKS = re.compile(r"[ \t\n\r\f\v]+")
_ESCAPES = (
    (re.compile(r"\\(?=[\\`*_{}\[\]()#+\-.!])"), r"\\\\"),
    (re.compile(r"^(\s*[0-9]+)\.(?=\s)", re.M), r"\1\\."),
    (re.compile(r"^(\s*)(\+(?=\s)|-(?=[\s-]))", re.M), r"\1\\\2"),
)
_LINK_CHARACTERS = re.compile(r"([\\\[\]()])")
_ABSOLUTE = re.compile(r"^[a-zA-Z+]+://")
_MAYBE_LIST = re.compile(r"^\s*(?:[0-9]+\.|[+-])", re.M)
# A letter after a closing mark needs a space, or the mark would not render.
_GLUED = re.compile(r"[^\]\[(){}\s.!?]")


def html_to_markdown(html: str) -> str:
    """Markdown with unwrapped lines, one line break between blocks, ``\\n`` at the end."""
    writer = _Writer()
    position = 0
    while found := _MARKUP.search(html, position):
        if found.start() > position:
            writer.text(html[position:found.start()])
        position = found.end()
        end, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            writer.end_tag(tag)
            continue
        writer.start_tag(tag, _attributes(attributes) if tag in _WITH_ATTRIBUTES else {})
        if attributes.endswith("/"):
            writer.end_tag(tag)
        elif tag in _RAW_END:
            close = _RAW_END[tag].search(html, position)
            position = close.start() if close else len(html)
    if position < len(html):
        writer.text(html[position:])
    return writer.result()


def _attributes(text: str) -> dict[str, str | None]:
    """The first value of every attribute; None for one without a value."""
    found: dict[str, str | None] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        value = next(filter(None, values), "" if "=" in text else None)
        found.setdefault(name.lower(), value and unescape(value))
    return found


def _in_link(text: str) -> str:
    return _LINK_CHARACTERS.sub(r"\\\1", text)


class _Writer:
    """Collects pieces of Markdown; white space is decided when the next piece comes."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.last = "\n"          # last character written
        self.line_break = False   # the next piece starts a new line
        self.hard_break = ""      # and that line end carries this
        self.blank = False        # the next piece is parted by a space
        self.glue = True          # nothing may part the next piece (start, after a bullet)
        self.hidden = 0
        self.quotes = 0
        self.lists: list[list] = []       # [tag, items so far]
        self.after_list = False
        self.links: list[dict | None] = []
        self.open_link: str | None = None  # target of a link without text so far
        self.preformatted = self.pre_start = self.code = False
        self.after_open = self.after_stressed = False
        self.tag = ""
        self.cells = 0
        self.table_head = self.next_cell = False

    # -- writing ---------------------------------------------------------

    def write(self, piece: str) -> None:
        if self.hidden or not piece:
            return
        if self.glue:
            self.line_break = self.blank = self.glue = False
        if self.line_break:
            self._append(self.hard_break + "\n" + self._quote())
            self.line_break, self.hard_break, self.blank = False, "", False
        elif self.blank:
            if not self.last.isspace():
                self._append(" ")
            self.blank = False
        self._append(piece)

    def _append(self, piece: str) -> None:
        self.pieces.append(piece)
        self.last = piece[-1]

    def _quote(self) -> str:
        return ">" * self.quotes + " " if self.quotes else ""

    def block(self) -> None:
        self.line_break = True

    def result(self) -> str:
        return "".join(self.pieces) + "\n"

    # -- text ------------------------------------------------------------

    def text(self, data: str) -> None:
        if self.hidden:
            return
        if "&" in data:
            data = unescape(data)
        if self.preformatted:
            return self._preformatted(data)
        if self.after_open:
            data = data.strip()
            self.after_open, self.after_stressed = False, True
        elif self.after_stressed:
            if _GLUED.match(data) and self.tag not in HEADINGS and self.tag not in ("a", "code"):
                data = " " + data
            self.after_stressed = False
        if self.open_link is not None and data.strip():
            inner = self.links[-1] if self.links else None
            if inner and data == inner["href"] and _ABSOLUTE.match(data):
                self.open_link = inner["href"] = None
                return self.write(f"<{data}>")
            self._open_link()
        if not self.code:
            if "\\" in data or _MAYBE_LIST.search(data):
                for pattern, replacement in _ESCAPES:
                    data = pattern.sub(replacement, data)
        data = _BLANKS.sub(" ", data)
        if data.startswith(" "):
            self.blank = True
        self.write(data.removeprefix(" "))

    def _preformatted(self, data: str) -> None:
        indent = self._quote() + "    " * (len(self.lists) + (not self.lists))
        if self.pre_start and not data.startswith(("\n", "\r\n")):
            data = "\n" + data
        if self.pre_start and self.lists:
            data = data.lstrip("\n")
        self.pre_start = False
        self.write(data.replace("\n", "\n" + indent))

    # -- tags ------------------------------------------------------------

    def start_tag(self, tag: str, attributes: dict) -> None:
        self.tag = tag
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "body":
            self.hidden = 0   # a head that was never closed ends here
        elif not self.hidden:
            self._start(tag, attributes)

    def end_tag(self, tag: str) -> None:
        self.tag = tag
        if tag in HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif not self.hidden:
            self._end(tag)

    def _start(self, tag: str, attrs: dict) -> None:
        top_list = tag in ("ul", "ol") and not self.lists and not self.after_list
        self.after_list = tag in ("ul", "ol")
        if tag in HEADINGS:
            if not self.links:
                self.block()
            self.write("#" * HEADINGS[tag] + " ")
        elif tag in BLOCKS or tag == "dl":
            if tag == "p" or not self.links:
                self.block()
        elif tag in INLINE_MARKS:
            if tag not in CODE:
                self._open_mark(tag)
            elif not self.preformatted:
                self._open_mark(tag)
                self.code = True
        elif tag == "br":
            self.write("  \n" + self._quote())
        elif tag == "hr":
            self.block()
            self.write("* * *")
            self.block()
        elif tag == "a":
            href = attrs.get("href")
            linked = href is not None and not href.startswith("#")
            self.links.append({"href": href, "title": attrs.get("title")} if linked else None)
            self.open_link = href if linked else self.open_link
        elif tag == "img":
            if attrs.get("src") is not None:
                self._open_link()
                self.write(f"![{_in_link(attrs.get('alt') or '')}]({_in_link(attrs['src'])})")
        elif tag in ("ul", "ol"):
            if top_list:
                self.block()
            first = attrs.get("start") or ""
            self.lists.append([tag, int(first) - 1 if first.isdigit() else 0])
        elif tag == "li":
            self.block()
            self._bullet()
        elif tag == "dd":
            self.write("    ")
        elif tag == "blockquote":
            self.block()
            self.write("> ")
            self.glue = True
            self.quotes += 1
        elif tag == "pre":
            self.block()
            self.preformatted = self.pre_start = True
        elif tag == "table":
            self.block()
            self.table_head = True
        elif tag == "tr":
            self.cells = 0
        elif tag in ("td", "th"):
            if self.next_cell:
                self.write("| ")
            self.next_cell = True
            self.cells += 1

    def _end(self, tag: str) -> None:
        top_list = tag in ("ul", "ol") and not self.lists and not self.after_list
        self.after_list = tag in ("ul", "ol")
        if tag in HEADINGS or tag in BLOCKS:
            if not self.links:
                self.block()
        elif tag in CODE and self.preformatted:
            pass   # the indent already says so
        elif tag in INLINE_MARKS:
            self.code = self.code and tag not in CODE
            self.blank = self.blank and tag not in STRESS
            self.write(INLINE_MARKS[tag])
            self.after_open = False
        elif tag == "a":
            self._close_link()
        elif tag in ("ul", "ol"):
            if top_list:
                self.block()
            if self.lists:
                self.lists.pop()
                if not self.lists:
                    self.write("\n")
        elif tag in ("li", "dt", "dd"):
            self.block()
        elif tag == "blockquote":
            self.quotes = max(self.quotes - 1, 0)
            self.block()
        elif tag == "pre":
            self.preformatted = False
            self.block()
        elif tag == "tr":
            self._end_row()

    def _open_mark(self, tag: str) -> None:
        mark = INLINE_MARKS[tag]
        flush = not (self.line_break or self.blank or self.glue)
        if mark == "_":
            apart = flush and (self.last.isalnum() or self.last == "_")
        else:
            apart = flush and tag in STRESS and self.last == mark[0]
        self.blank = self.blank or apart
        self.write(mark)
        self.after_open = tag in STRESS

    def _open_link(self) -> None:
        if self.open_link is not None:
            self.open_link = None
            self.write("[")

    def _close_link(self) -> None:
        link = self.links.pop() if self.links else None
        if link is None or link["href"] is None:
            return
        self._open_link()
        self.line_break = False
        title = (link["title"] or "").strip()
        self.write(f"]({_in_link(link['href'])}" + (f' "{_in_link(title)}")' if title else ")"))

    def _bullet(self) -> None:
        style = self.lists[-1] if self.lists else ["ul", 0]
        style[1] += 1
        mark = "*" if style[0] == "ul" else f"{style[1]}."
        self.write("  " * len(self.lists) + mark + " ")
        self.glue = True

    def _end_row(self) -> None:
        self.next_cell = False
        self.line_break, self.hard_break = True, "  "
        if self.table_head:
            self.write("|".join(["---"] * self.cells))
            self.line_break, self.hard_break = True, "  "
            self.table_head = False
