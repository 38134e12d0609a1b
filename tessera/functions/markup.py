"""HTML to text with tables kept as rows of cells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAK = frozenset("p div br li h1 h2 h3 h4 tr".split())
HIDDEN = frozenset("script style head".split())


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden, self.depth, self.rows, self.cell = 0, 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "body":
            self.hidden = 0
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.rows = []
        elif self.depth and tag == "tr":
            self.end_cell()
            self.rows.append([])
        elif self.depth and tag in ("td", "th"):
            self.end_cell()
            self.cell = []
        elif tag == "br" and not self.depth:
            self.out.append("\n")

    def end_cell(self):
        if self.cell is not None:
            text = " ".join(" ".join(x.strip() for x in self.cell if x.strip()).split())
            if not self.rows:
                self.rows.append([])
            if text:
                self.rows[-1].append(text)
            self.cell = None

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.end_cell()
                lines = [" | ".join(r) for r in self.rows if r]
                self.out.append("\n\n[TABLE]\n" + "\n".join(lines) + "\n[/TABLE]\n\n" if lines else "\n\n")
        elif tag in BREAK and tag != "br" and not self.depth:
            self.out.append("\n")

    def handle_data(self, data):
        if self.hidden:
            return
        if self.depth:
            if self.cell is not None:
                self.cell.append(data)
        else:
            self.out.append(data)


def to_text(page: str | None) -> str:
    """Visible text: block ends are line ends, white space is collapsed, at most one blank line stands between lines."""
    p = _Text()
    p.feed(page or "")
    p.close()
    t = re.sub(r"[ \t]+", " ", "".join(p.out).replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", t)).strip()


@F.pandas_udf(T.StringType())
def html_to_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        yield pd.Series([to_text(p) for p in s], dtype=object)
