"""HTML to blocks: the standard library's parser gives events, everything after it is worked out from lists of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag -> type of the block that it begins.
BLOCKS = {"p": "p", "div": "p", "li": "p", "dd": "p", "dt": "p", "h1": "h1", "h2": "h1", "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "blockquote": "quote", "pre": "verse"}
#: Tags whose content is no text.
SKIPPED = {"script", "style", "head", "title", "svg", "table"}
#: Tag -> kind of emphasis.
EMPHASIS = {"em": "em", "i": "em", "strong": "strong", "b": "strong", "u": "em"}
#: Signs of which a run is one blank.
BLANKS = " \t\r\n\u00a0\u2007\u202f"
SCHEMA = "id long, ix long, type string, text string, marks array<struct<s:long,e:long,kind:string>>"
MARK = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string())]))

_blank = re.compile(f"[{BLANKS}]")


class Events(HTMLParser):
    """('<', tag), ('>', tag) and ('', text) in their order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("<", tag))

    def handle_endtag(self, tag):
        self.found.append((">", tag))

    def handle_data(self, data):
        self.found.append(("", data))


def shown(events: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The events outside of skipped tags. A stray end of such a tag changes nothing."""
    depth = 0
    for sign, x in events:
        if sign and x in SKIPPED:
            depth = max(0, depth + (1 if sign == "<" else -1))
        elif not depth:
            yield sign, x


def runs(events: Iterator[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(type, events) between the begins and ends of block tags."""
    kind, held = "p", []
    for sign, x in events:
        if sign and x in BLOCKS:
            yield kind, held
            kind, held = BLOCKS[x] if sign == "<" else "p", []
        else:
            held.append((sign, x))
    yield kind, held


def block(events: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """Text with single blanks, and the emphasis in it.

    Where a place of the raw text lies in the collapsed one follows from two running counts: signs that are no blank,
    and words begun before it."""
    raw, edges = "", []
    for sign, x in events:
        if not sign:
            raw += x
        elif x == "br" and sign == "<":
            raw += " "
        elif x in EMPHASIS:
            edges.append((sign, EMPHASIS[x], len(raw)))
    whole = " ".join(x for x in _blank.split(raw) if x)
    text = whole.strip()
    if not edges:
        return text, []
    blank = np.array([c in BLANKS for c in raw], bool)
    begins = ~blank & np.concatenate([[True], blank[:-1]])[: len(raw)]
    end_at = np.concatenate([[0], np.cumsum(~blank)]) + np.maximum(np.concatenate([[0], np.cumsum(begins)]) - 1, 0)
    lead = len(whole) - len(whole.lstrip())
    waiting: dict[str, list[int]] = {}
    marks = []
    for sign, kind, at in edges:
        if sign == "<":
            waiting.setdefault(kind, []).append(int(end_at[at]) + int(at > 0 and bool(blank[at - 1]) and end_at[at] > 0))
        elif waiting.get(kind):
            s, e = max(0, waiting[kind].pop() - lead), min(len(text), int(end_at[at]) - lead)
            if s < e:
                marks.append({"s": s, "e": e, "kind": kind})
    return text, marks


def blocks_of(html: str | None) -> list[tuple[str, str, list[dict]]]:
    """(type, text, marks) of each block that holds text."""
    found = ((kind, *block(events)) for kind, events in runs(shown(Events(html or "").found)))
    return [x for x in found if x[1]]


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per block of every page."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, html in zip(batch.column(0), batch.column(1)):
                found = blocks_of(html.as_py())
                kinds, texts, marks = zip(*found) if found else ((), (), ())
                columns = [pa.array([i.as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(marks, MARK)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ix", "type", "text", "marks"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(parsed, SCHEMA)


def page_titles(blocks: DataFrame) -> DataFrame:
    """Title of a page: its headings among the first three blocks, joined."""
    heads = F.array_sort(F.collect_list(F.when((F.col("ix") < 3) & F.col("type").isin("h1", "h2"), F.struct("ix", "text"))))
    return blocks.groupBy("id").agg(F.array_join(F.array_distinct(F.transform(heads, lambda h: h.text)), " – ").alias("title"))
