"""Converter plug-ins (X1): set up once per Python worker, then convert many documents.

A converter turns one document's text into ordered blocks ``(type, level, text)``. They run inside
``mapInPandas`` over Arrow batches, so Spark partitions the documents and each task streams its
batches through one converter instance. Readers of XML and Office files are in
``formats``. Neural PDF/OCR converters are not available on this machine; they plug in through the same two methods.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from ..functions.columns import IMAGE_REF_PATTERN

_WS = re.compile(r"\s+")
_EDGE = re.compile(r"^[ \t\r]+|[ \t\r]+$")


class Converter:
    """Base plug-in. ``open`` runs once per worker before the first document."""

    name = "base"
    raw = False  # True: ``convert`` takes bytes as they are, not text

    def open(self) -> None:  # pragma: no cover - default no-op
        pass

    def convert(self, content: str) -> list[tuple[str, int, str]]:
        raise NotImplementedError


class TextConverter(Converter):
    """Plain text: every non-blank line is a block; Markdown-style markers set the type."""

    name = "text"

    def convert(self, content):
        out = []
        for raw in (content or "").split("\n"):
            line = _EDGE.sub("", raw)
            if not line:
                continue
            out.append(classify_line(line))
        return out


def classify_line(line: str) -> tuple[str, int, str]:
    m = re.match(r"^(#{1,6}) +(.*)$", line)
    if m:
        return "heading", len(m.group(1)), m.group(2)
    if line.startswith(("- ", "* ")):
        return "list_item", 0, line[2:]
    if line.startswith("|"):
        return "table", 0, line
    if line.startswith("$$") and line.endswith("$$") and len(line) > 4:
        return "equation", 0, line[2:-2]
    return "paragraph", 0, line


class MarkdownConverter(TextConverter):
    """Markdown: like text, but image references and display formulas inside a line are blocks of
    their own, in reading order, and the text around them loses them. The line's type stays with its
    first piece of text; later pieces are paragraphs. Dropping an equation block (P6) therefore takes
    the formula out of the document."""

    name = "markdown"
    _inside = re.compile(IMAGE_REF_PATTERN + r"|\$\$(.+?)\$\$")

    def convert(self, content):
        out = []
        for kind, level, text in super().convert(content):
            if kind == "equation":
                out.append((kind, level, text))
                continue
            at = 0
            for m in self._inside.finditer(text):
                self._text(out, kind, level, text[at:m.start()])
                if _EDGE.sub("", text[:m.start()]):
                    kind, level = "paragraph", 0
                out.append(("image", 0, m.group(2)) if m.group(3) is None else ("equation", 0, m.group(3)))
                at = m.end()
            self._text(out, kind, level, text[at:])
        return out

    @staticmethod
    def _text(out, kind, level, piece):
        piece = _EDGE.sub("", piece)
        if piece:
            out.append((kind, level, piece))


_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_SKIP = {"script", "style", "nav", "head", "template", "noscript"}
_BLOCK_CONTAINERS = {"div", "footer", "article", "section", "main", "header", "aside", "body", "ul", "ol",
                     "table", "caption", "tr", "blockquote", "pre", "dl", "dt", "dd", "figure", "figcaption"}
# what may stand in a head; any other start tag ends it, as its end tag is optional
_METADATA = {"title", "meta", "link", "base", "html"}


class _BlockParser(HTMLParser):
    def __init__(self, skip=frozenset(_SKIP)):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.skipped_tags = skip
        self.skip: list[str] = []  # open elements that are dropped
        self.cur: list[str] | None = None
        self.cur_kind: tuple[str, int] | None = None
        self.loose: list[str] = []

    # a block in progress is closed by the next block start (HTML's implied </p>)
    def _flush(self):
        if self.cur is not None:
            text = _WS.sub(" ", "".join(self.cur)).strip()
            if text:
                self.blocks.append((self.cur_kind[0], self.cur_kind[1], text))
        self.cur, self.cur_kind = None, None

    def _flush_loose(self):
        text = _WS.sub(" ", "".join(self.loose)).strip()
        if text:
            self.blocks.append(("text", 0, text))
        self.loose = []

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped_tags:
            self.skip.append(tag)
            return
        if self.skip == ["head"] and tag not in _METADATA:
            self.skip.pop()
        if self.skip:
            return
        if tag in _HEADINGS or tag in ("p", "li"):
            self._flush()
            self._flush_loose()
            kind = ("heading", _HEADINGS[tag]) if tag in _HEADINGS else (("paragraph", 0) if tag == "p" else ("list_item", 0))
            self.cur, self.cur_kind = [], kind
        elif tag in _BLOCK_CONTAINERS:
            self._flush()
            self._flush_loose()
        elif tag in ("br", "td", "th"):
            (self.cur if self.cur is not None else self.loose).append(" ")

    def handle_endtag(self, tag):
        if tag in self.skipped_tags:
            if tag in self.skip:
                del self.skip[self.skip.index(tag):]
            return
        if self.skip:
            return
        if tag in _HEADINGS or tag in ("p", "li"):
            self._flush()
        elif tag in _BLOCK_CONTAINERS:
            self._flush()
            self._flush_loose()

    def handle_data(self, data):
        if self.skip:
            return
        (self.cur if self.cur is not None else self.loose).append(data)

    def close(self):
        super().close()
        self._flush()
        self._flush_loose()


class HtmlConverter(Converter):
    """HTML/XHTML with the standard-library parser: headings, paragraphs, list items and loose text
    of block containers (a table row is one block, its cells apart); script, style, head and
    navigation are dropped; entities decoded. A head ends where its end tag is left out; navigation
    that is never closed is kept as text rather than taking the rest of the page with it."""

    name = "html"

    def convert(self, content):
        p = self._parsed(content or "")
        if p.skip:
            p = self._parsed(content or "", frozenset(_SKIP - ({"nav", "noscript"} & set(p.skip))))
        return p.blocks

    @staticmethod
    def _parsed(content: str, *skip) -> _BlockParser:
        p = _BlockParser(*skip)
        p.feed(content)
        p.close()
        return p


# fixed values: converter chosen per lower-cased suffix on the text route
TEXT_ROUTE_CONVERTERS = {".html": "html", ".htm": "html", ".md": "markdown", ".markdown": "markdown"}
DEFAULT_CONVERTERS = {"html": HtmlConverter, "text": TextConverter, "markdown": MarkdownConverter}
