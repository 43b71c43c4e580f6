"""HTML to Markdown as a chain of native expressions, for simple markup.

The chain stays inside generated code, with no Python worker. It covers headings,
paragraphs, line breaks, rules, emphasis, code, links, images and flat lists, with tag
names in lower case; nested lists, tables and preformatted text need the parser in
``functions/html.py``. Both give the same text for the markup covered here, and a page with
any other markup gets null, not a text with losses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN, TEXT, CHARACTERS = "pattern", "text", "characters"

# Control characters stand for layout until the last rules: \x01 block edge,
# \x02 line break, \x03 end of a list, \x04 bullet.
_BLANK = r"[ \t\n\r\f]"
_STRESS = r"strong|b|em|i|u|del|strike|s"

# The rewriting rules, applied in this order to the whole text. A pattern
# costs several times a plain text, so there are few of them and each starts with a
# character that is rare.
RULES: list[tuple[str, str, str]] = [
    # what never shows
    (PATTERN, r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>", ""),
    # text that would read as a Markdown list
    (PATTERN,
     rf"([>\n]{_BLANK}*[0-9]+)(\.{_BLANK})|([>\n]{_BLANK}*)([+]{_BLANK}|-[- \t\n\r\f])",
     r"$1$3\\$2$4"),
    # white space
    (CHARACTERS, "\t\n\r\f", "    "),
    (PATTERN, r"  +", " "),
    (PATTERN, r"> $", ">"),
    # emphasis: no blanks inside the marks, one between a mark and a letter
    (PATTERN, rf"<({_STRESS})(?: [^>]*)?> ?([^<]*?) ?(<|$)", "<$1>$2$3"),
    (PATTERN, rf"</({_STRESS})>([^\]\[(){{}} .!?<])", "</$1> $2"),
    (PATTERN, r"<(?<=[^ !-/:-@\[-^`{-~]<)(em|i|u)>", " <$1>"),
    # links and images
    (PATTERN, r'<img [^>]*?src="([^"]*)"(?:[^>]*?alt="([^"]*)")?[^>]*>', "![$2]($1)"),
    (PATTERN, r'<a [^>]*?href="([^"#][^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)"),
    # one spelling per tag
    (PATTERN, r"<([a-z][a-z0-9]*)(?: [^>]*|/)>", "<$1>"),
    # blocks
    *[(TEXT, f"<h{n}>", "\x01" + "#" * n + " ") for n in range(1, 7)],
    (TEXT, "<br>", "\x02"),
    (TEXT, "<hr>", "\x01* * *\x01"),
    (TEXT, "<li>", "\x01\x04"),
    (TEXT, "</ul>", "\x01\x03"),
    (PATTERN, r"</?(?:p|div|li|ul|h[1-6])>", "\x01"),
    # marks
    (PATTERN, r"</?(?:strong|b)>", "**"),
    (PATTERN, r"</?(?:em|i|u)>", "_"),
    (PATTERN, r"</?(?:del|strike|s)>", "~~"),
    (PATTERN, r"</?(?:code|kbd|tt)>", "`"),
    (PATTERN, r"</?q>", '"'),
    # every other tag, then entities
    (PATTERN, r"<[^>]*>", ""),
    (PATTERN, r"  +", " "),
    (PATTERN, r"&(lt|gt|quot|nbsp|copy|middot|amp);?", "&$1;"),
    (TEXT, "&lt;", "<"),
    (TEXT, "&gt;", ">"),
    (TEXT, "&quot;", '"'),
    (TEXT, "&#39;", "'"),
    (TEXT, "&apos;", "'"),
    (TEXT, "&nbsp;", "\u00a0"),
    (TEXT, "&copy;", "©"),
    (TEXT, "&middot;", "·"),
    (TEXT, "&amp;", "&"),
    # layout
    (PATTERN, r"([\x02\x03]) +|(\x04)[\x01 ]+", "$1$2"),
    (PATTERN, r"^[\x01 ]+|\x01[\x01 ]*$", ""),
    (PATTERN, r"\x01[\x01 ]*", "\n"),
    (TEXT, "\x02", "  \n"),
    (TEXT, "\x03", "\n"),
    (TEXT, "\x04", "  * "),
]

# A line start before the text, so that no rule needs to look for the start itself.
START = "\n"


# What the rules cover. A page is inside if nothing that starts like a tag is left when all
# these are taken away; a link or an image counts as one piece, as the rules read it.
_VALUE = r'="[^"<>]*"'
_PLAIN = r'="[^"<>()\[\]\\]*"'  # without characters that links escape
_OTHERS = rf" *(?: (?:class|id|style|lang|rel|target|width|height|data-[a-z-]+(?<!href)(?<!src)){_VALUE})*"
_COVERED = (
    rf"<a{_OTHERS} href{_PLAIN}{_OTHERS} *>[^<]*</a>"
    rf"|<img{_OTHERS} src{_PLAIN}{_OTHERS}(?: alt{_PLAIN}{_OTHERS})? */?>"
    r"|</?(?!(?:a|img|ol|table|thead|tbody|tr|td|th|pre|blockquote|dl|dt|dd|head|script|style)\b)"
    rf"[a-z][a-z0-9]*(?: +[a-z-]+{_VALUE})* */?>"
    r"|<![^<>-][^<>]*>")
# Entities without a rule, characters that stand for layout, lists inside lists, marks of
# emphasis right beside other tags inside a line, and backslashes that Markdown would read.
_BLOCK = r"/?(?:p|div|li|ul|h[1-6r]|body|html)\b|!"
_ENTITY = r"&(?!(?:lt|gt|quot|nbsp|copy|middot|amp|apos|#39);)(?:#|[A-Za-z][A-Za-z0-9]*;)"
_OUTSIDE = (
    rf"(?s){_ENTITY}|[\x01-\x04]|<ul\b(?:(?!</ul>).)*<ul\b"
    rf"|</?(?:{_STRESS})\b[^>]*>{_BLANK}*<(?!{_BLOCK})"
    rf"|<(?!{_BLOCK})[^>]*>{_BLANK}*</?(?:{_STRESS})\b"
    r"|\\[\\`*_{}\[\]()#+.!-]")


def is_covered(html: Column) -> Column:
    """Whether the rules give the text of a page that the parser gives."""
    shown = F.regexp_replace(html, RULES[0][1], "")
    left = F.regexp_replace(shown, _COVERED, "")
    return ~left.contains("<") & ~shown.rlike(_OUTSIDE)


def html_to_markdown(html: Column) -> Column:
    """The Markdown of a page; null for a page with markup that the rules do not cover."""
    return F.when(is_covered(html), _rewritten(html))


def _rewritten(html: Column) -> Column:
    text = F.concat(F.lit(START), html)
    for kind, found, replacement in RULES:
        if kind == PATTERN:
            text = F.regexp_replace(text, found, replacement)
        elif kind == CHARACTERS:
            text = F.translate(text, found, replacement)
        else:
            text = F.replace(text, F.lit(found), F.lit(replacement))
    return F.concat(text, F.lit("\n"))
