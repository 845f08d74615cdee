"""Operators whose next step depends on the last: chunks, grids, suppression, scopes.

Each runs on one page or document at a time in Arrow batches; groups are bounded by a page's
content.  Injected functions (resolver, model client, parser) are arguments with deterministic
defaults.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import catalogue
from ..sources.shipping import ship

LETTERS = 1 << 22  #: letters of text in a batch that goes back, about

def pack_text(text: str, limit: int) -> list[str]:
    """Greedy chunks of at most ``limit`` characters: sentences, then clauses, then words; a
    longer unit is cut (TX14)."""
    units = [text]
    for sep in (r"(?<=[.!?。]) +", r"(?<=;) *", r" +"):
        units = [y for x in units for y in (re.split(sep, x) if len(x) > limit else [x])]
    units = [u[k : k + limit] for u in units for k in range(0, max(1, len(u)), limit)]
    out: list[str] = []
    for u in units:
        if out and len(out[-1]) + 1 + len(u) <= limit:
            out[-1] += " " + u
        else:
            out.append(u)
    return out


class Tables(HTMLParser):
    """Tables of a page as rows of (text, rowspan, colspan) (SRC08)."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.table = self.row = self.cell = None
        self.span = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row, self.cell = [], None, None
        elif tag == "tr" and self.table is not None:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            number = lambda k: int(dict(attrs).get(k) or 0) if (dict(attrs).get(k) or "").isdigit() else 1
            self.cell, self.span = [], (max(1, number("rowspan")), max(1, number("colspan")))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append((" ".join("".join(self.cell).split()), *self.span))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.table.append(self.row)
            self.row = None
        elif tag == "table" and self.table is not None:
            self.tables.append(self.table)
            self.table = self.row = self.cell = None


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells with spans as a rectangle (TX13)."""
    below: dict[int, tuple[str, int]] = {}
    out = []
    for cells in rows:
        line: list[str] = []
        for text, high, wide in cells:
            while len(line) in below:
                at = len(line)
                line.append(below[at][0])
                below[at] = (below[at][0], below[at][1] - 1)
                if not below[at][1]:
                    del below[at]
            for _ in range(wide):
                if high > 1:
                    below[len(line)] = (text, high - 1)
                line.append(text)
        while len(line) in below:
            at = len(line)
            line.append(below[at][0])
            below[at] = (below[at][0], below[at][1] - 1)
            if not below[at][1]:
                del below[at]
        out.append(line)
    width = max(map(len, out), default=0)
    return [x + [""] * (width - len(x)) for x in out]


def blocks(lines: list[str]) -> list[tuple[str, list[str]]]:
    """Runs of lines as html_table, pipe_table or text (TX12)."""
    out: list[tuple[str, list[str]]] = []
    inside = False
    for x in lines:
        bar = x.count("|") >= 2 and not x.lstrip().startswith(("#", "* "))
        kind = "html_table" if inside or "<table" in x.lower() else "pipe_table" if bar else "text"
        if out and out[-1][0] == kind and not (kind == "html_table" and not inside):
            out[-1][1].append(x)
        else:
            out.append((kind, [x]))
        if kind == "html_table":
            inside = "</table" not in x.lower()
    return out


def suppressed(boxes: list[tuple], limit: float, most: int | None = None) -> list[tuple]:
    """Boxes (id, y1, x1, y2, x2) in order of preference that meet no kept one, to ``most`` of them
    (SP02).  The limit is the decimal number that it is written as, and shares are compared as whole
    numbers: 0.55 of an area of 100 is 55, which a product of floats exceeds."""
    if not boxes:
        return []
    share, whole = Fraction(str(limit)).as_integer_ratio()
    at = np.array([b[1:] for b in boxes], object)
    if 16 * max(abs(x) for x in at.flat) ** 2 * max(share, whole) < 1 << 63:
        at = at.astype(np.int64)
    area = (at[:, 2] - at[:, 0]) * (at[:, 3] - at[:, 1])
    free = np.ones(len(boxes), bool)
    kept = []
    while len(kept) != most:
        k = int(free.argmax())
        if not free[k]:
            break
        kept.append(boxes[k])
        sides = [np.minimum(at[:, i + 2], at[k, i + 2]) - np.maximum(at[:, i], at[k, i]) for i in (0, 1)]
        common = np.clip(sides[0], 0, None) * np.clip(sides[1], 0, None)
        free &= ~((common > 0) & (common * whole >= (area + area[k] - common) * share)).astype(bool)
        free[k] = False
    return kept


def per_group(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over each group of equal keys (not null), many groups to an Arrow batch: rows come sorted by
    the keys, and a group that a batch cuts waits for its rest."""
    ship(df.sparkSession)

    def groups(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), bool)
        change[:1] = True
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def run(frames):
        held: pd.DataFrame | None = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            starts = groups(pdf)
            if len(starts):
                done = [f(pdf.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                held = pdf.iloc[starts[-1] :]
                if done:
                    yield pd.concat(done, ignore_index=True)
        if held is not None and len(held):
            yield f(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def rows_of(df: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Any number of rows for each row, in Arrow batches; a row is one dict, filled anew."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            columns = list(pdf.columns)
            cells = [pdf[c].tolist() for c in columns]
            yield pd.DataFrame([r for x in zip(*cells) for r in f(dict(zip(columns, x)))], columns=names)

    return df.mapInPandas(run, schema)


def chunk_text(docs: DataFrame, limit: int = 12000) -> DataFrame:
    return rows_of(docs.select("doc_id", "text").where("text IS NOT NULL"), lambda r: ((r["doc_id"], k, x) for k, x in enumerate(pack_text(r["text"], limit))), "doc_id long, chunk long, text string")


def table_cells(pages: DataFrame) -> DataFrame:
    def cells(r):
        p = Tables()
        p.feed(r["html"] or "")
        for t, table in enumerate(p.tables):
            for i, line in enumerate(grid(table)):
                for j, text in enumerate(line):
                    yield r["page_id"], t, i, j, text

    return rows_of(pages.select("page_id", "html"), cells, "page_id long, table_no long, row_no long, col_no long, text string")


def page_parts(text: str, limit: int, most_rows: int) -> list[str]:
    """A page's own chunks: prose packed, tables alone, long pipe tables in parts with their header
    lines (TX15, TX16)."""
    made = []
    for kind, own in blocks(text.split("\n")):
        if kind == "text":
            made += pack_text("\n".join(own), limit)
        elif kind == "html_table":
            made.append("\n".join(own))
        else:
            top = own[:2] if len(own) > 1 and re.fullmatch(r"[|: -]+", own[1].strip()) else own[:1]
            rest = own[len(top) :]
            made += ["\n".join([*top, *rest[k : k + most_rows]]) for k in range(0, max(1, len(rest)), most_rows)]
    return made


def page_chunks(pages: DataFrame, limit: int = 12000, most_rows: int = 12) -> DataFrame:
    """A page's chunks, with the page's head before the later ones where there is room (TX17)."""

    def chunks(r):
        lines = (r["text"] or "").split("\n")
        head = "\n".join(lines[:8])[:600]
        for k, x in enumerate(page_parts(r["text"] or "", limit, most_rows)):
            yield r["doc_id"], k, x if k == 0 or len(head) + 1 + len(x) > limit else f"{head}\n{x}"

    return rows_of(pages.select("doc_id", "text"), chunks, "doc_id long, chunk long, text string")


def run_task(df: DataFrame, operation: Callable[[str], str] | None = None, parser: Callable[[str], dict] = json.loads, retry: int = 2, delays: tuple[float, ...] = ()) -> DataFrame:
    """A model task over (id, prompt): operation, parser, typed errors, retries and an audit row
    (ML01, ML07, UD04).  The default operation is a stub that echoes a fixed answer."""
    operation = operation or (lambda prompt: json.dumps({"length": len(prompt)}))

    def one(r):
        error = kind = payload = ""
        for attempt in range(1, max(1, retry) + 1):
            try:
                payload = json.dumps(parser(operation(r["prompt"] or "")), sort_keys=True)
                yield r["id"], True, attempt, payload, "", ""
                return
            except TimeoutError as e:
                kind, error = "timeout", str(e)
            except (ValueError, KeyError) as e:
                kind, error = "contract", str(e)
            except Exception as e:  # noqa: BLE001  whatever the provider raises is its row's error
                kind, error = "provider", str(e)
            if attempt < retry and delays:
                time.sleep(delays[min(attempt - 1, len(delays) - 1)])
        yield r["id"], False, max(1, retry), "", kind, error[:2000]

    return rows_of(df, one, "id long, ok boolean, attempts long, payload string, error_type string, error string")


def resolve(df: DataFrame, resolver: Callable[[str], str | None]) -> DataFrame:
    """Canonical ids of (raw, canonical, source) rows that stayed unresolved, by an injected
    resolver; its errors become the source llm_error (UD01)."""

    def one(r):
        if r["source"] != "unresolved":
            yield r["raw"], r["canonical"], r["source"]
            return
        try:
            found = resolver(r["raw"])
        except Exception:  # noqa: BLE001
            yield r["raw"], "", "llm_error"
            return
        yield (r["raw"], found, "llm_few_shot") if found else (r["raw"], "", "unresolved")

    return rows_of(df.select("raw", "canonical", "source"), one, "raw string, canonical string, source string")


def fetch_pages(df: DataFrame, client: Callable[[list[int]], list[str]] | None = None, batch: int = 3) -> DataFrame:
    """Page texts of (doc_id, page) from a batched service; a batch that times out is halved, a
    page that fails alone is "" (SRC03)."""
    client = client or (lambda pages: [f"page {p}" for p in pages])

    def ask(pages: list[int]) -> list[str]:
        try:
            got = client(pages)
        except TimeoutError:
            if len(pages) == 1:
                return [""]
            mid = len(pages) // 2
            return ask(pages[:mid]) + ask(pages[mid:])
        if len(got) != len(pages):
            if len(pages) == 1:
                return [""]
            raise ValueError("the service gave another number of pages")
        return got

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = sorted(set(pdf["page"]))
        texts = [x for k in range(0, len(pages), batch) for x in ask([int(p) for p in pages[k : k + batch]])]
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "page": pages, "text": texts})

    return per_group(df.select("doc_id", "page"), ["doc_id"], group, "doc_id long, page long, text string")


def nms(boxes: DataFrame, limit: float = 0.55, most: int = 60) -> DataFrame:
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True])
        kept = suppressed(list(pdf[["box_id", "y1", "x1", "y2", "x2"]].itertuples(index=False, name=None)), limit, most)
        return pd.DataFrame({"page": pdf["page"].iloc[0], "box_id": [k[0] for k in kept]})

    return per_group(boxes, ["page"], group, "page long, box_id long")


def scopes(contexts: DataFrame) -> DataFrame:
    """Table scopes of (doc_id, page, variables array): a new scope at a gap of pages or where no
    variable is shared with the current one (WN03).  Rows come sorted; what is known of the current
    scope goes along from row to row and from batch to batch, so documents of any number and length
    pass without being gathered."""
    ship(contexts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, doc, last, scope, known, text = False, None, None, 0, set(), ""
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_pylist()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            some_null = None in values
            numbers, reasons, texts = [], [], []
            given = at = letters = 0

            def part(given: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [c.slice(given, len(texts)) for c in batch.columns[:2]]
                return pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), pa.array(reasons, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "page", "scope", "reason", "known"])

            for d, page, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes):
                own = values[at : at + n]
                at += n
                if some_null:
                    own = [v for v in own if v is not None]
                if not begun or d != doc:
                    begun, doc, scope, reason = True, d, 1, "start"
                elif page is not None and last is not None and page > last + 1:
                    scope, reason = scope + 1, "gap"
                elif known and own and known.isdisjoint(own):
                    scope, reason = scope + 1, "no overlap"
                else:
                    reason = ""
                if reason:
                    known, text = set(own), None
                elif not known.issuperset(own):
                    known.update(own)
                    text = None
                if text is None:
                    text = " ".join(sorted(known))
                last = page
                numbers.append(scope)
                reasons.append(reason)
                texts.append(text)
                letters += len(text)
                if letters > LETTERS:
                    yield part(given)
                    given += len(texts)
                    numbers, reasons, texts, letters = [], [], [], 0
            if texts:
                yield part(given)

    rows = contexts.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), "variables")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("page")).mapInArrow(run, "doc_id long, page long, scope long, reason string, known string")


def merged_lines(boxes: DataFrame, tolerance: int = 3) -> DataFrame:
    """Spans on one line: both edges within the tolerance of the growing rectangle (WN06)."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, line, y1, y2 = [], 0, None, None
        for r in pdf.sort_values(["y1", "x1", "box_id"]).itertuples():
            if y1 is None or abs(r.y1 - y1) > tolerance or abs(r.y2 - y2) > tolerance:
                line, y1, y2 = line + 1, r.y1, r.y2
            else:
                y1, y2 = min(y1, r.y1), max(y2, r.y2)
            rows.append((r.page, r.box_id, line))
        return pd.DataFrame(rows, columns=["page", "box_id", "line"])

    return per_group(boxes, ["page"], group, "page long, box_id long, line long")


def distinct_blocks(boxes: DataFrame, near: int = 5) -> DataFrame:
    """Blocks that are not within ``near`` of, or inside, the last kept one (WN07)."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, k = [], None
        for r in pdf.sort_values(["y1", "x1", "box_id"]).itertuples():
            if k is not None:
                close = all(abs(a - b) <= near for a, b in ((r.y1, k.y1), (r.x1, k.x1), (r.y2, k.y2), (r.x2, k.x2)))
                if close or k.y1 <= r.y1 and k.x1 <= r.x1 and k.y2 >= r.y2 and k.x2 >= r.x2:
                    continue
            k = r
            kept.append((r.page, r.box_id))
        return pd.DataFrame(kept, columns=["page", "box_id"])

    return per_group(boxes, ["page"], group, "page long, box_id long")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.load(spark, d, "v_boxes").selectExpr("CAST(page AS BIGINT) page", "CAST(box_id AS BIGINT) box_id", "CAST(y1 AS BIGINT) y1", "CAST(x1 AS BIGINT) x1", "CAST(y2 AS BIGINT) y2", "CAST(x2 AS BIGINT) x2", "score")


def _html(spark: SparkSession, d: str) -> DataFrame:
    cells = "concat('<tr><td rowspan=2>', l_partkey, '</td><td>', l_suppkey, '</td></tr><tr><td colspan=2>', l_returnflag, '</td></tr>')"
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.expr(f"concat('<table>', array_join(array_sort(collect_list({cells})), ''), '</table>')").alias("html"))


# -- what must come out, as SQL of its own ---------------------------------------------------------

LINES = "SELECT l_orderkey AS page_id, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY concat('<tr><td rowspan=2>', l_partkey, '</td><td>', l_suppkey, '</td></tr><tr><td colspan=2>', l_returnflag, '</td></tr>')) - 1 AS i FROM @lineitem"
GRID = f"SELECT page_id, CAST(0 AS BIGINT) AS table_no, CAST(2 * i + r AS BIGINT) AS row_no, CAST(c AS BIGINT) AS col_no, CASE WHEN c = 0 THEN CAST(l_partkey AS VARCHAR) WHEN r = 1 THEN l_returnflag WHEN c = 1 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END AS text FROM ({LINES}) t CROSS JOIN (VALUES (0), (1)) a(r) CROSS JOIN (VALUES (0), (1), (2)) b(c)"
COUNTS = "SELECT l_orderkey AS id, count(*) AS n FROM @lineitem GROUP BY l_orderkey"
ORDERED = "SELECT CAST(page AS BIGINT) AS page, CAST(box_id AS BIGINT) AS box_id, CAST(y1 AS BIGINT) AS y1, CAST(x1 AS BIGINT) AS x1, CAST(y2 AS BIGINT) AS y2, CAST(x2 AS BIGINT) AS x2, row_number() OVER (PARTITION BY page ORDER BY {order}) AS i FROM @v_boxes"
#: Greedy choice, box by box: a list of the kept ones goes along.
NMS = f"""WITH RECURSIVE o AS ({ORDERED.format(order="score DESC, box_id")}),
g(page, i, kept) AS (SELECT page, i, [struct_pack(b := box_id, y1 := y1, x1 := x1, y2 := y2, x2 := x2)] FROM o WHERE i = 1
UNION ALL SELECT o.page, o.i, CASE WHEN len(kept) >= 60 OR len(list_filter(kept, lambda k: greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1)) * greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) > 0
AND greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1)) * greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) >= 0.55 * ((k.y2 - k.y1) * (k.x2 - k.x1) + (o.y2 - o.y1) * (o.x2 - o.x1) - greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1)) * greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1))))) > 0
THEN kept ELSE list_append(kept, struct_pack(b := o.box_id, y1 := o.y1, x1 := o.x1, y2 := o.y2, x2 := o.x2)) END FROM g JOIN o ON o.page = g.page AND o.i = g.i + 1)
SELECT page, unnest(kept).b AS box_id FROM (SELECT page, arg_max(kept, i) AS kept FROM g GROUP BY page) e"""
MERGED = f"""WITH RECURSIVE o AS ({ORDERED.format(order="y1, x1, box_id")}),
g(page, i, box_id, line, a, b) AS (SELECT page, i, box_id, CAST(1 AS BIGINT), y1, y2 FROM o WHERE i = 1
UNION ALL SELECT o.page, o.i, o.box_id, CASE WHEN abs(o.y1 - a) <= 3 AND abs(o.y2 - b) <= 3 THEN line ELSE line + 1 END, CASE WHEN abs(o.y1 - a) <= 3 AND abs(o.y2 - b) <= 3 THEN least(a, o.y1) ELSE o.y1 END, CASE WHEN abs(o.y1 - a) <= 3 AND abs(o.y2 - b) <= 3 THEN greatest(b, o.y2) ELSE o.y2 END FROM g JOIN o ON o.page = g.page AND o.i = g.i + 1)
SELECT page, box_id, line FROM g"""
NEAR = f"""WITH RECURSIVE o AS ({ORDERED.format(order="y1, x1, box_id")}),
g(page, i, box_id, kept, y1, x1, y2, x2) AS (SELECT page, i, box_id, true, y1, x1, y2, x2 FROM o WHERE i = 1
UNION ALL SELECT page, i, box_id, NOT same, CASE WHEN same THEN a ELSE y1 END, CASE WHEN same THEN b ELSE x1 END, CASE WHEN same THEN c ELSE y2 END, CASE WHEN same THEN e ELSE x2 END FROM
(SELECT o.*, g.y1 AS a, g.x1 AS b, g.y2 AS c, g.x2 AS e, (abs(o.y1 - g.y1) <= 5 AND abs(o.x1 - g.x1) <= 5 AND abs(o.y2 - g.y2) <= 5 AND abs(o.x2 - g.x2) <= 5) OR (g.y1 <= o.y1 AND g.x1 <= o.x1 AND g.y2 >= o.y2 AND g.x2 >= o.x2) AS same FROM g JOIN o ON o.page = g.page AND o.i = g.i + 1) x)
SELECT page, box_id FROM g WHERE kept"""
SCOPES = """WITH RECURSIVE v AS (SELECT record_id AS doc_id, page, list_sort(list_distinct(list(scaffold_ref))) AS own FROM @v_relations GROUP BY record_id, page), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM v),
g(doc_id, page, i, scope, reason, known) AS (SELECT doc_id, page, i, CAST(1 AS BIGINT), 'start', own FROM o WHERE i = 1
UNION ALL SELECT doc_id, page, i, scope + CASE WHEN r = '' THEN 0 ELSE 1 END, r, CASE WHEN r = '' THEN list_sort(list_distinct(list_concat(known, own))) ELSE own END FROM
(SELECT o.*, g.scope, g.known, CASE WHEN o.page > g.page + 1 THEN 'gap' WHEN len(g.known) > 0 AND len(o.own) > 0 AND NOT list_has_any(g.known, o.own) THEN 'no overlap' ELSE '' END AS r FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1) x)
SELECT doc_id, page, scope, reason, array_to_string(known, ' ') AS known FROM g"""
#: Every page of these has a line, a table of 2 + n lines, a line, a table of one line, and a line.
BLOCKS = f"SELECT id AS doc_id, CAST(b AS BIGINT) AS block, CASE WHEN b IN (1, 3) THEN 'pipe_table' ELSE 'text' END AS kind, CAST(CASE WHEN b = 1 THEN 2 + n ELSE 1 END AS BIGINT) AS n_lines FROM ({COUNTS}) t CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(b)"

frame = catalogue.frame
frame("src08_html_tables", lambda d: GRID)(lambda s, d: table_cells(_html(s, d)))
frame("tx13_grid", lambda d: f"SELECT id AS page_id, CAST(0 AS BIGINT) AS table_no, CAST(2 * n - 1 AS BIGINT) AS last_row, CAST(2 AS BIGINT) AS last_col FROM ({COUNTS}) t")(lambda s, d: table_cells(_html(s, d)).groupBy("page_id", "table_no").agg(F.max("row_no").alias("last_row"), F.max("col_no").alias("last_col")))
frame("tx12_blocks", lambda d: BLOCKS)(lambda s, d: rows_of(catalogue.load(s, d, "v_tables").select("doc_id", "markdown"), lambda r: ((r["doc_id"], k, b[0], len(b[1])) for k, b in enumerate(blocks(r["markdown"].split("\n")))), "doc_id long, block long, kind string, n_lines long"))
frame("tx14_text_chunks")(lambda s, d: chunk_text(s.read.parquet(f"{d}/documents.parquet"), 1000))
frame("tx17_page_chunks")(lambda s, d: page_chunks(catalogue.load(s, d, "v_tables").selectExpr("doc_id", "markdown AS text"), 400))
frame("tx16_html_chunks", lambda d: f"SELECT id AS page_id, CAST(c AS BIGINT) AS chunk, CAST(least(12, 2 * n - 12 * c) AS BIGINT) AS n_rows FROM (SELECT id, n, unnest(generate_series(0, (2 * n - 1) // 12)) AS c FROM ({COUNTS}) t) u")(lambda s, d: _html(s, d).selectExpr("page_id", "posexplode(regexp_extract_all(html, '(?is)<tr.*?</tr>', 0)) AS (i, tr)").groupBy("page_id", F.floor(F.col("i") / 12).alias("chunk")).agg(F.count("*").alias("n_rows")))
frame("sp02_nms", lambda d: NMS)(lambda s, d: nms(_boxes(s, d)))
frame("wn03_scopes", lambda d: SCOPES)(lambda s, d: scopes(catalogue.load(s, d, "v_relations").groupBy(F.col("record_id").alias("doc_id"), "page").agg(F.sort_array(F.collect_set("scaffold_ref")).alias("variables"))))
frame("wn06_line_merge", lambda d: MERGED)(lambda s, d: merged_lines(_boxes(s, d)))
frame("wn07_near_blocks", lambda d: NEAR)(lambda s, d: distinct_blocks(_boxes(s, d)))
frame("ml01_text_task", lambda d: "SELECT doc_id AS id, true AS ok, CAST(1 AS BIGINT) AS attempts, concat('{\"length\": ', length(coalesce(text, '')), '}') AS payload, '' AS error_type, '' AS error FROM @documents")(lambda s, d: run_task(s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id AS id", "text AS prompt")))
frame("ml07_retry", lambda d: "SELECT doc_id AS id, lang = 'en' AS ok, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS BIGINT) AS attempts, CASE WHEN lang = 'en' THEN '{}' ELSE '' END AS payload, CASE WHEN lang = 'en' THEN '' ELSE 'contract' END AS error_type FROM @documents")(lambda s, d: run_task(s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id AS id", "lang AS prompt"), operation=lambda p: "{}" if p == "en" else "no json").drop("error"))
frame("src03_ocr_scan", lambda d: "SELECT DISTINCT doc_id, page, concat('page ', page) AS text FROM @v_assay_long")(lambda s, d: fetch_pages(catalogue.load(s, d, "v_assay_long").selectExpr("CAST(doc_id AS BIGINT) doc_id", "page")))
