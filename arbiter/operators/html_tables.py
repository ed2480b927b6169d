"""Tables of HTML pages as rows: spans filled in, nested tables apart, columns found by their headers."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s+")
#: The greatest spans that count (fixed values of the HTML standard).
COLUMNS, ROWS = 1000, 65534


class _Tables(HTMLParser):
    """Rows of cells ``(text, columns, rows)`` of each table, in the order in which tables begin."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[list[list[list]]] = []  # tables around the present place
        self.inside: list[bool] = []  # whether a cell of each is open
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
            self.inside.append(False)
        elif self.open and tag == "tr":
            self.open[-1].append([])
            self.inside[-1] = False
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            given = dict(attrs)
            self.open[-1][-1].append([[], self._span(given.get("colspan"), COLUMNS), self._span(given.get("rowspan"), ROWS)])
            self.inside[-1] = True
        elif self.open and self.inside[-1]:
            self.open[-1][-1][-1][0].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open and tag == "table":
            self.open.pop()
            self.inside.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.inside[-1] = False

    def handle_data(self, data):
        if self.open and self.inside[-1] and not self.hidden:
            self.open[-1][-1][-1][0].append(data)

    @staticmethod
    def _span(value: str | None, most: int) -> int:
        n = int(value) if value and value.isascii() and value.isdigit() else 1
        return min(n, most) if n or most == ROWS else 1


def _grid(rows: list[list[list]]) -> list[list[str | None]]:
    """Cells in their columns; a cell over several rows or columns stands in each. A row span of 0 goes to the end."""
    out, running = [], {}  # column -> (text, rows left)
    for at, cells in enumerate(rows):
        line: dict[int, str] = {}
        for c, (text, left) in list(running.items()):
            line[c] = text
            running[c] = (text, left - 1)
            if left <= 1:
                del running[c]
        c = 0
        for pieces, columns, span in cells:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            span = span or len(rows) - at
            for _ in range(columns):
                while c in line:
                    c += 1
                line[c] = text
                if span > 1:
                    running[c] = (text, span - 1)
        out.append([line.get(i) for i in range(max(line, default=-1) + 1)])
    return out


def parse(html: str) -> list[list[list[str | None]]]:
    parser = _Tables()
    parser.feed(html)
    parser.close()
    return [_grid(rows) for rows in parser.tables]


def grids(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, table, grid``: every table, numbered from 0 in the page's order, with all of its rows; null pages have none."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, numbers, found = [], [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                for t, grid in enumerate(parse(html or "")):
                    at.append(i)
                    numbers.append(t)
                    found.append(grid)
            if at:
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(numbers, pa.int32()), pa.array(found, pa.list_(pa.list_(pa.string())))], names=["page_id", "table", "grid"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, table int, grid array<array<string>>")


def tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, table, row, cells``: every row of every table, numbered from 0 in the page's order; null pages have none."""
    return grids(pages, id_col, html_col).select("page_id", "table", F.posexplode("grid").alias("row", "cells"))


def _place(has: str, lacks: str | None):
    """Where among ``heads`` the first header is that has one text and lacks the other; 0 if there is none."""
    fits = lambda h: F.contains(h, F.lit(has)) & (~F.contains(h, F.lit(lacks)) if lacks else F.lit(True))
    return F.array_position(F.transform("heads", fits), True)


_HEADS = lambda c: F.transform(c, lambda h: F.lower(F.coalesce(h, F.lit(""))))


def page_columns(pages: DataFrame, wanted: dict[str, tuple[str, str | None]]) -> DataFrame:
    """As ``columns(tables(pages), wanted)``: pages are parsed once and a table's rows find their headers beside them."""
    found = grids(pages).withColumn("heads", _HEADS(F.get("grid", F.lit(0)))).select("page_id", "table", "grid", *(_place(*rule).alias(name) for name, rule in wanted.items()))
    for name in wanted:
        found = found.where(F.col(name) > 0)
    far = F.greatest(*wanted) if len(wanted) > 1 else F.col(next(iter(wanted)))
    body = found.withColumn("far", far).select("page_id", "table", "far", F.struct(*wanted).alias("at"), F.posexplode("grid").alias("row", "cells"))
    return body.where("row > 0").where(F.size("cells") >= F.col("far")).select("page_id", "table", "row", *(F.element_at("cells", F.col(f"at.{name}").cast("int")).alias(name) for name in wanted))


def columns(rows: DataFrame, wanted: dict[str, tuple[str, str | None]]) -> DataFrame:
    """``page_id, table, row`` and the wanted columns of tables that have all of them.

    ``wanted`` says for each column what its header has in it and what not, in small letters; the first header
    that fits counts. A table's first row is its headers. Rows that are too short for a wanted column are left out.
    """
    first = rows.where("row = 0").select("page_id", "table", _HEADS("cells").alias("heads"))
    found = first.select("page_id", "table", *(_place(*rule).alias(name) for name, rule in wanted.items()))
    for name in wanted:
        found = found.where(F.col(name) > 0)
    # Of a page, a table's rows meet its one row of places.
    places = found.select("page_id", "table", F.struct(*wanted).alias("at"))
    body = rows.where("row > 0").join(places, ["page_id", "table"])
    far = F.greatest(*(F.col(f"at.{name}") for name in wanted)) if len(wanted) > 1 else F.col(f"at.{next(iter(wanted))}")
    return body.where(F.size("cells") >= far).select("page_id", "table", "row", *(F.element_at("cells", F.col(f"at.{name}").cast("int")).alias(name) for name in wanted))
