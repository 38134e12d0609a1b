"""Sequential segmentation of one text: blocks, chunks, and typed sentence units. Pure Python, run in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate, groupby
from operator import itemgetter
from typing import NamedTuple

import regex

from tessera.functions.text import TOKEN

TOKENS = regex.compile(TOKEN)
#: Markers and patterns of tables, blank lines, list items and code fences.
OPEN, CLOSE = "[TABLE]", "[/TABLE]"
TABLE = re.compile(r"\[TABLE\].*?\[/TABLE\]", re.S)
BLANK = re.compile(r"\n\s*\n")
BULLET = re.compile(r"\s*(?:[•●▪‣\-*·]|\(?[a-z0-9]{1,3}[.)])\s+")
FENCE = re.compile(r"\s*(?:```|~~~)")
END = re.compile(r"""[.!?…]["'”’)\]]*(?=\s+["'“‘(\[]?[A-ZÀ-ÖØ-Þ0-9])""")
ABBREVIATION = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|No|Inc|Corp|Co|Ltd|vs|etc|e\.g|i\.e|Fig|approx)|\b[A-Z])\.$")


class Block(NamedTuple):
    text: str
    offset: int
    table: bool


def count(text: str) -> int:
    return len(TOKENS.findall(text))


def pieces(text: str, pattern: re.Pattern):
    """(text, offset, whether it matched) for matches and what lies between, in order."""
    at = 0
    for m in pattern.finditer(text):
        yield text[at : m.start()], at, False
        yield m.group(), m.start(), True
        at = m.end()
    yield text[at:], at, False


def blocks(text: str) -> list[Block]:
    """Tables whole, other text by blank lines. A paragraph's offset is that before stripping."""
    out = []
    for part, at, table in pieces(text, TABLE):
        if table:
            out.append(Block(part, at, True))
        else:
            out += [Block(p.strip(), at + o, False) for p, o, sep in pieces(part, BLANK) if not sep and p.strip()]
    return out


def spans(sizes: list[int], target: int, want: int, legacy: bool = False) -> list[tuple[int, int]]:
    """The first and end block of each chunk, for blocks of these sizes; with running sums, a chunk's size is a difference and the
    carry a search. off: by how much the legacy carry is mismeasured."""
    sums = [0, *accumulate(sizes)]
    out, start, off = [], 0, 0
    for i, n in enumerate(sizes):
        alone, full = n >= target, sums[i] - sums[start] + off + n > target
        if start < i and (alone or full):
            out.append((start, i))
        if alone:
            out.append((i, i + 1))
            start, off = i + 1, 0
        elif start < i and full:
            last, least = (i - start, 0) if legacy else (i, start)
            back = last - min(last, max(least, bisect_right(sums, sums[last] - want, hi=last + 1) - 1))
            off = sums[last] - sums[last - back] - (sums[i] - sums[i - back])
            start = i - back
    return out + [(start, len(sizes))] * (start < len(sizes))


def chunks(text: str, target: int = 400, overlap: float = 0.15, legacy: bool = False, count: Callable[[str], int] = count) -> list[tuple[int, str, int]]:
    """(offset, body, tokens) of greedily packed blocks. A block of the target or more stands alone and nothing is carried across
    it; otherwise a full chunk's last blocks are carried into the next until they hold the overlap, one block at least. With legacy
    the carry is measured with the counts of the document's first blocks. count: the tokens of a text."""
    bs = blocks(text)
    cuts = spans([count(b.text) for b in bs], target, int(target * overlap), legacy)
    bodies = ["\n\n".join(b.text for b in bs[first:end]) for first, end in cuts]
    return [(bs[first].offset, body, count(body)) for (first, _), body in zip(cuts, bodies)]


def ends(para: str) -> list[int]:
    """Where sentences end by rules: . ! ? before white space and a capital or digit, not after abbreviations."""
    return [m.end() for m in END.finditer(para) if not ABBREVIATION.search(para[: m.end()][-12:])]


def sentences(text: str, ends: Callable[[str], list[int]] = ends) -> list[tuple[str, int]]:
    """(sentence, offset) of prose, cut at blank lines and at the ends within each paragraph."""
    out = []
    for para, at, sep in pieces(text, BLANK):
        if sep:
            continue
        start = 0
        for end in [*ends(para), len(para)]:
            raw = para[start:end]
            lead = len(raw) - len(raw.lstrip())
            if raw.strip():
                out.append((raw.strip(), at + start + lead))
            start = end
    return out


def _kinds(lines: list[str]) -> list[str]:
    """fence, code, list or prose for each line; what lies behind an odd number of fences is code."""
    fences = [bool(FENCE.match(x)) for x in lines]
    inside = [n % 2 == 1 for n in accumulate(fences, initial=0)]
    return ["fence" if f else "code" if c else "list" if BULLET.match(x) else "prose" for x, f, c in zip(lines, fences, inside)]


def units(text: str, base: int = 0, ends: Callable[[str], list[int]] = ends) -> list[tuple[str, int, str]]:
    """(text, offset, kind) of a chunk: tables whole, code lines, blank ones too, list lines, and sentences of the prose between."""
    out: list[tuple[str, int, str]] = []
    for part, at, table in pieces(text, TABLE):
        if table:
            out.append((part.strip(), base + at, "table"))
        elif part.strip():
            lines = part.split("\n")
            places = [base + at + x for x in accumulate((len(x) + 1 for x in lines), initial=0)]
            for kind, run in groupby(zip(_kinds(lines), places, lines), key=itemgetter(0)):
                rows = list(run)
                if kind == "prose":
                    out += [(s, rows[0][1] + o, kind) for s, o in sentences("\n".join(x for _, _, x in rows), ends)]
                else:
                    out += [(x if kind == "code" else x.strip(), place, "list" if kind == "list" else "code") for _, place, x in rows]
    return out
