"""Headings and verses of chapter pages: what a narrator reads, without labels, cross-references and notes."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class suffixes (what follows the last `__`) of headings, verses, their text and what is left out; elements without an end.
HEADING, VERSE, CONTENT = "s", "verse", "content"
LEFT_OUT = frozenset({"label", "r", "note", "fr", "fq", "body"})
VOID = frozenset({"br", "img", "hr", "meta", "link", "input", "wbr", "source"})
UNITS = "array<struct<kind:string,ref:string,text:string>>"


class Reader(HTMLParser):
    """Open elements with what they say about the text inside, and the units so far as [kind, ref, pieces of text]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset[str], str | None]] = []
        self.units: list[list] = []

    def within(self, wanted: frozenset[str]) -> bool:
        return any(marks & wanted for _, marks, _ in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br" and self.units:
                self.units[-1][2].append(" ")
            return
        found = dict(attrs)
        marks = frozenset(name.rpartition("__")[2] for name in (found.get("class") or "").split())
        self.open.append((tag, marks, found.get("data-usfm")))
        if CONTENT in marks and self.units:
            self.units[-1][2].append(" ")  # a new run never glues to the word before
        if HEADING in marks and not self.within(LEFT_OUT):
            self.units.append(["heading", "", []])

    def handle_endtag(self, tag: str) -> None:
        names = [name for name, _, _ in self.open]
        if tag in names:  # what was left open inside closes with it
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not data.strip() or self.within(LEFT_OUT):
            return
        if self.within(frozenset({HEADING})):
            self.units[-1][2].append(data)
        elif self.within(frozenset({CONTENT})):
            refs = [ref for _, marks, ref in self.open if VERSE in marks and ref]
            if not refs:
                return
            if self.units and self.units[-1][:2] == ["verse", refs[-1]]:
                self.units[-1][2].append(data)
            else:
                self.units.append(["verse", refs[-1], [data]])


def units_of(html: str | None) -> list[dict[str, str]]:
    """Units of a page in order; runs of white space are one space, blank units go. Null is an empty page."""
    reader = Reader()
    reader.feed(html or "")
    joined = [(kind, ref, " ".join("".join(parts).split())) for kind, ref, parts in reader.units]
    return [{"kind": kind, "ref": ref, "text": text} for kind, ref, text in joined if text]


def parsed(html: Column) -> Column:
    @F.pandas_udf(UNITS)
    def parse(pages: pd.Series) -> pd.Series:
        return pd.Series([units_of(p) for p in pages])

    return parse(html)


def page_units(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, kind, ref, text) of each unit."""
    return pages.select(key, F.posexplode(parsed(F.col(html))).alias("place", "u")).select(key, "place", "u.kind", "u.ref", "u.text")
