"""Markup to text and Markdown by a parser, for what expressions can't say. Arrow batches, one pass each."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = re.compile(r"\s+")
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "header", "footer", "en-note", "body"}


#: What is no text: comments, scripts and styles up to their end or that of the document, declarations and tags.
_NO_TEXT = re.compile(r"<!--.*?-->|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!/?]?[A-Za-z][^>]*>", re.S | re.I)


def parsed_text(markup: str | None) -> str:
    """Visible text, with all entities of HTML; '' for null."""
    return _BLANK.sub(" ", unescape(_NO_TEXT.sub(" ", markup))).strip() if markup else ""


class _Markdown(HTMLParser):
    """Headings, emphasis, links, images, lists, quotes, code, tables, check boxes and media."""

    def __init__(self, media: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = self.pre = self.cells = 0
        self.code_divs = 0  # open divs of a code block, its own included
        self.lists: list[list] = []
        self.links: list[str | None] = []
        self.media = media

    def _block(self):
        self.out.append("\n\n")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "svg"):
            self.hidden += 1
        if self.hidden:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append(f"\n\n{'#' * int(tag[1])} ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("b", "strong", "i", "em"):
            if not self.pre:  # code has no emphasis
                self.out.append("**" if tag in ("b", "strong") else "*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif self.code_divs and tag == "div":
            self.code_divs += 1
        elif tag == "pre" or (tag == "div" and "--en-codeblock:true" in (a.get("style") or "").replace(" ", "")):
            self.pre += 1
            self.out.append("\n\n```\n")
            self.code_divs = int(tag == "div")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._block()
        elif tag == "li":
            depth = sum(x[0] in ("ul", "ol") for x in self.lists)
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. "
            self.out.append("\n" + "  " * max(0, depth - 1) + mark)
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "a":
            self.links.append(a.get("href"))
            if a.get("href"):
                self.out.append("[")
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})")
        elif tag == "en-media":
            name = self.media.get((a.get("hash") or "").lower())
            if name:
                self.out.append(("!" if (a.get("type") or "").startswith("image/") else "") + f"[{name}](_attachments/{name})")
        elif tag == "en-todo":
            self.out.append("- [x] " if a.get("checked") == "true" else "- [ ] ")
        elif tag == "tr":
            self.out.append("\n| ")
            self.cells = 0
        elif tag in _BLOCKS:
            self._block()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "svg") or tag == "a":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "svg"):
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        if re.fullmatch(r"h[1-6]", tag) or tag == "blockquote":
            self._block()
        elif tag in ("b", "strong", "i", "em"):
            if not self.pre:  # code has no emphasis
                self.out.append("**" if tag in ("b", "strong") else "*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif self.code_divs > 1 and tag == "div":
            self.code_divs -= 1
            self.out.append("\n")
        elif tag == "pre" or self.code_divs and tag == "div":
            self.code_divs = 0
            self.pre = max(0, self.pre - 1)
            self.out.append("```\n\n" if self.out[-1].endswith("\n") else "\n```\n\n")
        elif tag in ("ul", "ol"):
            if self.lists and self.lists[-1][0] == tag:
                self.lists.pop()
            self._block()
        elif tag == "a" and self.links:
            href = self.links.pop()
            if href:
                self.out.append(f"]({href})")
        elif tag in ("td", "th"):
            self.cells += 1
            self.out.append(" | ")
        elif tag == "tr" and self.cells:
            self.out.append("")
        elif tag in _BLOCKS:
            self._block()

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"[ \t]+", " ", data))


def to_markdown(markup: str | None, media: dict[str, str] | None = None) -> str:
    """Markdown of an HTML fragment; Markdown without tags passes with entities decoded. media: file names by hash."""
    if not markup:
        return ""
    text = markup.replace("\r\n", "\n")
    if "<" not in text:
        return unescape(text).replace("\xa0", " ").strip()
    p = _Markdown(media or {})
    p.feed(text)
    p.close()
    made = "".join(p.out).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", made)).strip()


_HEADING = re.compile(r"^(#{1,6}) +(.*?) *#* *$")


def _same_title(a: str, b: str) -> bool:
    clean = lambda x: _BLANK.sub(" ", re.sub(r"[*_`~]", "", x)).strip().casefold()
    return clean(a) == clean(b)


def normalise(markdown: str | None, title: str | None) -> str:
    """Without a heading that repeats the title; headings from level 2 on; a lone number joined to the line behind it;
    'number. text' lines alone in their paragraph become level-3 headings; no more than one blank line. Fenced code stays as it is."""
    out: list[str] = []
    fence = None
    lines = (markdown or "").replace("\r\n", "\n").split("\n")
    i = 0
    dropped = False
    while i < len(lines):
        line = lines[i].rstrip()
        mark = re.match(r"^ {0,3}(`{3,}|~{3,})", line)
        if fence or mark:
            if mark and (not fence or mark[1][0] == fence):
                fence = None if fence else mark[1][0]
            out.append(lines[i])
            i += 1
            continue
        if re.fullmatch(r"\d{1,2}", line) and i + 1 < len(lines) and lines[i + 1].strip() and not lines[i + 1].lstrip().startswith(("#", "-", ">")):
            line = f"{int(line)}. {lines[i + 1].strip()}"
            i += 1
        if m := _HEADING.match(line):
            if not dropped and title and _same_title(m[2], title):
                dropped = True
                i += 1
                continue
            line = f"{'#' * max(2, len(m[1]))} {m[2]}"
        elif re.match(r"^\d{1,2}[.、] ?\S", line) and len(line) <= 60 and (not out or not out[-1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip()):
            line = f"### {line}"
        if line or (out and out[-1].strip()):
            out.append(line)
        i += 1
    return "\n".join(out).strip()


def _each(function, *columns: Column) -> Column:
    @F.pandas_udf("string")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*x) for x in zip(*series)], index=series[0].index, dtype=object)

    return run(*columns)


def parsed_text_column(markup: Column) -> Column:
    return _each(parsed_text, markup)


def markdown_column(markup: Column) -> Column:
    return _each(to_markdown, markup)


def normalise_column(title: Column, markdown: Column) -> Column:
    return _each(lambda t, m: normalise(m, t), title, markdown)


def clip_page(markup: str | None, media: dict[str, str]) -> str:
    """A clipped page with its media as images or links to stored files."""

    def put(m: re.Match) -> str:
        tag = m[0]
        found = re.search(r'hash="([0-9a-fA-F]{32})"', tag)
        name = media.get(found[1].lower()) if found else None
        if not name:
            return ""
        return f'<img src="_attachments/{name}">' if 'type="image/' in tag else f'<a href="_attachments/{name}">{name}</a>'

    body = re.sub(r"</?en-note\b[^>]*>|<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", "", markup or "")
    return "<html><body>" + re.sub(r"<en-media\b[^>]*/?>(?:\s*</en-media>)?", put, body) + "</body></html>"
