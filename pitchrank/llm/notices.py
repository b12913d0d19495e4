"""Licence notices in texts: exact phrases, and short notices with a bounded number of edits.

A notice that is found with at most k edits holds at least one of any k + 1 pieces it is cut
into unchanged. The pieces of all notices are looked up at once, each hit marks the stretch
of text where its notice could stand, and the bounded-error matching of the ``regex`` library
verifies the stretch, counts the edits and tells the span. Nothing else of the text is
matched, and every match has a piece, so none is missed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitchrank.llm.textbytes import ALNUM, LOWER, bounded, buffers, find_words, joined, slices


@dataclass(frozen=True)
class Notice:
    """Lower-case words joined by blanks; ``tail`` follows and must stand unchanged, as whole words."""

    label: str
    text: str
    edits: int = 0
    tail: str = ""

    def pieces(self) -> list[tuple[int, str]]:
        """Offset and text of ``edits + 1`` about equal pieces."""
        cuts = [len(self.text) * k // (self.edits + 1) for k in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def pattern(self) -> regex.Pattern:
        tail = f"{regex.escape(self.tail)}(?= )" if self.tail else ""
        return regex.compile(f"(?e)(?:{regex.escape(self.text)}){{e<={self.edits}}}{tail}")


# fixed values: exact phrases, and openings of well-known licence notices
PHRASES = (
    Notice("mit", "under the mit license"),
    Notice("apache-2", "apache license version 2"),
    Notice("cc-by-nc", "cc by nc"),
)
NOTICES = (
    Notice("apache-2", "licensed under the apache license version", 3, " 2 0"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("cc-by", "licensed under a creative commons attribution", 3, " 4 0"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("gpl", "licensed under the gnu general public license", 3),
    Notice("gpl", "under the terms of the gnu general public license", 4),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 7),
    Notice("lgpl", "under the terms of the gnu lesser general public license", 4),
    Notice("mit", "licensed under the mit license", 2),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mpl-2", "subject to the terms of the mozilla public license v", 4, " 2 0"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
)
FOUND = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("phrase", T.BooleanType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("edits", T.IntegerType()), T.StructField("allowed", T.IntegerType())]))


class Finder:
    """Finds phrases and notices in texts whose words are joined by one blank, one in front and one behind."""

    def __init__(self, phrases: tuple[Notice, ...], notices: tuple[Notice, ...]):
        self.phrases, self.notices = phrases, notices
        self.patterns = [n.pattern() for n in notices]
        pieces = defaultdict(list)
        for k, phrase in enumerate(phrases):
            pieces[f" {phrase.text} "].append((0, k, 0))
        for k, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                pieces[piece].append((1, k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.seeds.add_word(piece, (len(piece), where))
        if pieces:
            self.seeds.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, bool, int, int, int]]:
        """(index, is it a phrase, first byte, end byte, edits) of all that is found."""
        out, near = [], defaultdict(list)
        if not len(self.seeds):
            return out
        for end, (size, where) in self.seeds.iter(text.decode("latin-1")):  # one character a byte
            for kind, k, offset in where:
                start = end + 1 - size
                if kind == 0:
                    out.append((k, True, start + 1, start + size - 1, 0))
                else:
                    near[k].append(start - offset)
        for k, starts in near.items():
            for lo, hi in _stretches(sorted(starts), self.notices[k], text):
                part = text[lo:hi].decode("utf-8", "replace")
                for hit in self.patterns[k].finditer(part):
                    first = lo + len(part[:hit.start()].encode())
                    out.append((k, False, first, first + len(hit.group().encode()), sum(hit.fuzzy_counts)))
        return out


def _stretches(starts: list[int], notice: Notice, text: bytes) -> Iterator[tuple[int, int]]:
    """Where a notice can stand that begins near one of ``starts``; overlapping stretches are one."""
    spare = 4 * notice.edits + 1  # bytes of as many characters, and what follows a tail
    lo = hi = None
    for start in starts:
        a, b = max(start - spare, 0), min(start + len(notice.text) + len(notice.tail) + spare, len(text))
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield _whole(lo, hi, text)
        lo, hi = a, b
    if hi is not None:
        yield _whole(lo, hi, text)


def _whole(lo: int, hi: int, text: bytes) -> tuple[int, int]:
    """The stretch with no character cut."""
    while lo > 0 and text[lo] & 0xC0 == 0x80:
        lo -= 1
    while hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi += 1
    return lo, hi


def find_notices(docs: DataFrame, phrases: tuple[Notice, ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES,
                 text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``found``, what its whole text holds, by place.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower
    case; they are compared joined by one blank. Each place where a phrase's words stand
    consecutively is an entry, overlapping ones too. A notice's entries do not overlap: from
    left to right the text is matched with at most ``edits`` characters put in, left out or
    replaced. An entry has the label, whether it is of a phrase, the first and last word it
    touches (from 0), its edits and how many were allowed. A null text counts as empty and
    has no entries; columns ``n_words`` and ``found`` are replaced, all others stay.
    """
    docs = bounded(docs.drop("n_words", "found"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("found", FOUND)])
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()),
                               ("last_word", pa.int64()), ("edits", pa.int32()), ("allowed", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(phrases, notices)
        for part in slices(batches, text_col):
            data, off = buffers(part.column(text_col))
            words = find_words(LOWER[data], off, ALNUM)
            flat, begin = joined(words)
            found = []
            for a, b in zip(words.first, words.first[1:]):
                text = b" " + flat[begin[a]:begin[b]].tobytes()
                hits = finder.find(text)
                at = (begin[a:b] - begin[a] + 1).tolist() if hits else []
                found.append(sorted((_entry(finder, text, at, *h) for h in hits),
                                    key=lambda e: (e["first_word"], e["last_word"], e["label"], not e["phrase"])))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(words.first[1:] - words.first[:-1], pa.int64()), pa.array(found, kind)],
                [*part.schema.names, "n_words", "found"])

    return docs.mapInArrow(run, schema)


def _entry(finder: Finder, text: bytes, at: list[int], k: int, phrase: bool, lo: int, hi: int, edits: int) -> dict:
    notice = (finder.phrases if phrase else finder.notices)[k]
    lo += len(re.match(rb" *", text[lo:hi]).group())
    hi = lo + len(text[lo:hi].rstrip(b" "))
    return {"label": notice.label, "phrase": phrase, "first_word": bisect_right(at, lo) - 1,
            "last_word": bisect_right(at, max(lo, hi - 1)) - 1, "edits": edits, "allowed": notice.edits}
