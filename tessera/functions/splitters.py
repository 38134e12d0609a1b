"""Sentence splitters: where the sentences of a paragraph end. Settings name the one that is used."""

from __future__ import annotations

from typing import Protocol

import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tessera.functions import segment

#: Rows that a learned table may have; it is sent to every executor.
MOST_ROWS = 1 << 20

#: Patterns that Spark's, DuckDB's and Python's engines read alike: white space, punctuation before a word and behind it, numbers, a full
#: stop that is no ellipsis, and what a word ends with that the next one may begin a sentence after.
SPACE = r"[\s\p{Z}]+"
OPENING = r"^[\"'“‘„«(\[]+"
CLOSING = r"[\"'”’»)\],;:!?.…]+$"
NUMBER = r"^[-+]?[0-9][0-9.,]*$"
STOP = r"[^.]\.[\"'”’»)\],;:!?]*$"
END_BEFORE = r"[.!?…:][\"'”’»)\]]*$"
CAN_END = ".!?…:\"'”’»)]"  #: what can be the last character of what END_BEFORE matches


class SentenceSplitter(Protocol):
    name: str

    def ends(self, paragraph: str) -> list[int]: ...


class RuleSplitter:
    """. ! ? before white space and a capital or digit, but not after a fixed list of abbreviations and single capitals."""

    name = "rules"

    def ends(self, paragraph: str) -> list[int]:
        return segment.ends(paragraph)


class LearnedSplitter:
    """The same places, but what stands before and after a full stop is judged by a table that operators.boundaries.learn made. A
    paragraph's words are looked up by their types; what the table does not know is neither abbreviation nor collocation."""

    LONGEST = 64  #: no abbreviation or number of interest is as long: its score falls with e to the length

    def __init__(self, name: str, known: Broadcast):
        self.name, self._known = name, known

    @classmethod
    def of(cls, model: DataFrame, name: str = "learned") -> LearnedSplitter:
        """An error if the table is too large to be sent to every executor; a greater `least` makes it smaller."""
        rows = model.select("kind", "word", "next").limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"the table of sentence ends has over {MOST_ROWS} rows; learn it with a greater least")
        known = {kind: set() for kind in ("abbreviation", "starter", "collocation", "common", "proper")}
        for kind, word, after in rows:
            known[kind].add((word, after) if kind == "collocation" else word)
        return cls(name, model.sparkSession.sparkContext.broadcast(known))

    def ends(self, paragraph: str) -> list[int]:
        return [m.end() for m in segment.END.finditer(paragraph) if m.group()[0] != "." or self._ends(paragraph, m.start(), m.end())]

    def _ends(self, paragraph: str, at: int, end: int) -> bool:
        before = WORD_BEFORE.search(paragraph[max(0, at - self.LONGEST) : at])
        w = word_type(before.group()) if before else None
        if w is None:
            return True
        known = self._known.value
        abbreviation, single = w in known["abbreviation"], len(w) == 1 and w != "0"
        if not (abbreviation or single or w == "0"):
            return True
        x = word_type(WORD_AFTER.search(paragraph, end).group())
        if (w, x) in known["collocation"]:
            return False
        if w == "0":
            return x not in known["proper"]
        return x in known["common"] or (x in known["starter"] and not single)


WORD_BEFORE = regex.compile(r"[^\s\p{Z}]+$")
WORD_AFTER = regex.compile(r"[^\s\p{Z}]+")
_OPENING, _CLOSING, _NUMBER, _LETTER = (regex.compile(p) for p in (OPENING, CLOSING, NUMBER, r"\p{L}"))


def word_type(word: str) -> str | None:
    """operators.boundaries.word_type, for one word."""
    bare = _OPENING.sub("", _CLOSING.sub("", word))
    if _NUMBER.search(bare):
        return "0"
    return bare.lower() if _LETTER.search(bare) else None
