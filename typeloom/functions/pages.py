"""HTML pages: specifications and plain text, by Arrow-batched functions over html.parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPEC_TERMS, UNRELATED_HEADINGS

KEY_VALUE = re.compile(r"^([^:]{2,40}):\s*(.+)$", re.S)
SKIPPED = {"script", "style", "nav", "footer", "header"}
BREAKS = {"p", "li", "tr", "br", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "section"}


class _Events(HTMLParser):
    """Collects table rows, definition pairs, list items, paragraphs and lines of text."""

    def __init__(self):
        super().__init__()
        self.headings, self.open = [], []
        self.rows, self.pairs, self.items, self.lines = [], [], [], [""]
        self.skip = 0

    def unrelated(self) -> bool:
        return any(k in h.lower() for h in self.headings[-2:] for k in UNRELATED_HEADINGS)

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED
        if tag in BREAKS:
            self.lines.append("")
        if tag in ("li", "p"):
            self._close({"p"} if tag == "p" else {"p", "li"})
        if tag in ("table", "dl"):
            self.open.append([tag, self.unrelated(), [], []])
        elif tag in ("tr", "td", "th", "dt", "dd", "li", "p", "h1", "h2", "h3", "h4"):
            self.open.append([tag, None, [], []])

    def _close(self, tags):
        while self.open and self.open[-1][0] in tags:
            self._pop()

    def _pop(self):
        tag, flag, text, inner = self.open.pop()
        joined = " ".join(text)
        above = self.open[-1] if self.open else None
        if tag in ("td", "th") and above:
            above[3].append(joined)
        elif tag == "tr":
            table = next((o for o in reversed(self.open) if o[0] == "table"), None)
            if len(inner) == 2 and not (table and table[1]):
                self.rows.append(tuple(inner))
        elif tag in ("dt", "dd"):
            dl = next((o for o in reversed(self.open) if o[0] == "dl"), None)
            if dl:
                dl[3].append((tag, joined))
        elif tag == "dl" and not flag:
            terms, values = ([t for k, t in inner if k == kind] for kind in ("dt", "dd"))
            self.pairs += list(zip(terms, values))
        elif tag in ("li", "p"):
            self.items.append(joined)
        elif tag in ("h1", "h2", "h3", "h4"):
            self.headings.append(joined)

    def handle_endtag(self, tag):
        self.skip -= tag in SKIPPED and self.skip > 0
        if tag in BREAKS:
            self.lines.append("")
        if any(o[0] == tag for o in self.open):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        text = " ".join(data.split())
        if text:
            for o in self.open:
                o[2].append(text)
            if not self.skip:
                self.lines[-1] += (" " if self.lines[-1] else "") + text

    def finish(self):
        self.close()
        while self.open:
            self._pop()
        return self


def specs_of(html: str | None) -> dict[str, str]:
    """Key and value pairs that name a size or weight: two-cell table rows, then definition lists,
    then short Key: Value items; nothing under a heading for related products."""
    page = _Events()
    page.feed(html or "")
    page.finish()
    short = [m.groups() for t in page.items if t and len(t) <= 160 and (m := KEY_VALUE.match(t))]
    out: dict[str, str] = {}
    for key, value in [*page.rows, *page.pairs, *short]:
        key, value = key.strip().strip(":").lower(), " ".join(value.split())
        if key and value and len(value) <= 120 and any(c.isdigit() for c in value) and any(t in key for t in SPEC_TERMS):
            out.setdefault(key, value)
    return out


def text_of(html: str | None) -> str:
    """The text of a page, a line a block; scripts, styles and navigation left out."""
    page = _Events()
    page.feed(html or "")
    return "\n".join(x for x in page.finish().lines if x)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def page_specs(html: pd.Series) -> pd.Series:
    return html.map(specs_of)


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    return html.map(text_of)
