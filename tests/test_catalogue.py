"""Every registered query against its SQL, and hand-written cases."""

import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone import catalog
from marlstone.functions import chemistry, columns, payloads, raster
from marlstone.operators import sequential, shipments, tables
from marlstone.plans.dialect import TABLES, catalogue

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()
#: Queries whose SQL is made from the operator's own text: a part of them here, as the driver compares
#: all.  Those with SQL of their own are all compared.
PART = sorted(set(SQL) - set(catalogue.frames))[::7]
OWN = sorted(set(SQL) & set(catalogue.frames))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", PART + OWN)
def test_against_sql(spark, sf, duck, name):
    assert canon(QUERIES[name](spark, sf).toPandas()) == canon(duck.execute(SQL[name]).df())


def one(spark, name, **inputs):
    return catalogue.apply(name, spark, **inputs).collect()


def test_value_unit(spark):
    rows = [(k, v, "") for k, v in enumerate(["54 nM", "< 0.5 µM", "++", "ND", "12", "1.2 x 10^-3 M"])]
    got = {r["ord"]: (r["value"], r["unit"]) for r in one(spark, "tx19_value_unit", v_values=spark.createDataFrame(rows, "ord long, value string, assay string"))}
    assert [got[k] for k in range(6)] == [("54", "nM"), ("<0.5", "µM"), ("++", ""), ("ND", ""), ("12", ""), ("1.2x10^-3", "M")]


@pytest.mark.parametrize(("text", "cli", "api", "ui"), [("1-3,5", [1, 2, 3, 5], [1, 2, 3, 5], [1, 2, 3, 5]), ("5-3", [], [3, 4, 5], [3, 4, 5]), ("-3", [-3], [], [1, 2, 3]), ("0", [0], [0], []), ("x", None, [], []), ("1-2-3", None, [], [])])
def test_page_ranges(spark, text, cli, api, ui):
    df = spark.createDataFrame([(1, text)], "k long, pages string")
    got = df.select(columns.cli_pages(df["pages"]).alias("p")).first()["p"]
    assert got["pages"] == cli and (got["error"] is None) == (cli is not None)
    for name, want in (("tx02_pages_api", api), ("tx03_pages_ui", ui)):
        assert sorted(r["page"] for r in one(spark, name, v_ranges=df)) == want, name


def test_page_runs(spark):
    df = spark.createDataFrame([(1, p) for p in (7, 1, 2, 2, 3, 9, 8)], "doc_id long, page long")
    assert sorted((r["first_page"], r["last_page"]) for r in one(spark, "ag05_page_runs", v_assay_long=df)) == [(1, 3), (7, 9)]


def test_fair_queue(spark):
    df = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 3), ("f", 3)])], "seq long, task_id string, partition_ord long")
    assert [r["task_id"] for r in sorted(tables.fair_places(df).collect(), key=lambda r: r["place"])] == list("adebfc")
    assert [r["task_id"] for r in tables.pop_next(df).collect()] == ["a"]


def test_no_window_spans_lineitem(spark, sf):
    """Numbers of rows come from the rows; a single-task window is left only where its input is a
    table of turns, names or pages, or a page of a sorted list."""
    fine = {"wn04_fair_queue", "so02_paging", "sm04_admission", "ag09_column_set", "sp09_contact_sheet"}
    found = set()
    for name, f in QUERIES.items():
        if name in catalogue.texts or name in ("jn01_pipeline_merge", "ag01_assay_pivot", "fl12_assembly_blockers", "fl13_downgrade", "sp02_nms", *fine):
            plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            if any("Window [" in x and any("SinglePartition" in y for y in lines[k + 1 : k + 4]) for k, x in enumerate(lines)):
                found.add(name)
    assert found <= fine


def test_remap_is_order_free(spark, sf):
    base = catalogue.load(spark, sf, "v_assay_long").where("page = 1").cache()
    resolved = catalogue.load(spark, sf, "v_resolved").cache()
    text = catalogue.views["v_remapped"]
    a, b = (catalogue.run(spark, text, {"v_assay_long": x, "v_resolved": resolved}.__getitem__).toPandas() for x in (base, base.repartition(7)))
    assert canon(a) == canon(b)


def test_grid():
    assert sequential.grid([[("A", 2, 1), ("B", 1, 1)], [("C", 1, 1)]]) == [["A", "B"], ["A", "C"]]
    assert sequential.grid([[("A", 1, 2), ("B", 1, 1)], [("C", 1, 1)]]) == [["A", "A", "B"], ["C", "", ""]]


def test_chunks_hold_all_words_within_the_limit():
    text = "One two three. Four five; six seven eight nine ten. " * 9 + "x" * 300
    out = sequential.pack_text(text, 60)
    assert max(map(len, out)) <= 60 and "".join(out).replace(" ", "") == text.replace(" ", "")


def test_suppression_leaves_no_conflict():
    boxes = [(k, k % 7, k % 5, k % 7 + 10, k % 5 + 10) for k in range(40)]
    kept = sequential.suppressed(boxes, 0.55)
    assert kept and all(sequential.suppressed([a, b], 0.55) == [a, b] for a in kept for b in kept if a[0] < b[0])


def test_suppression_at_the_limit_itself(spark, duck):
    """Boxes that share exactly 0.55 of their union, by hand, in the SQL, and with sides of a billion."""
    pairs = [(10, 20, 10, 11), (23, 80, 23, 44), (1, 20, 1, 11), (1, 20, 1, 10), (23, 80, 23, 43), (10**9, 20 * 10**8, 10**9, 11 * 10**8)]
    want = [[1], [1], [1], [1, 2], [1, 2], [1]]
    assert [[b[0] for b in sequential.suppressed([(1, 0, 0, a, b), (2, 0, 0, c, d)], 0.55)] for a, b, c, d in pairs] == want
    rows = [(p, n, 0, 0, y, x, float(-n)) for p, (a, b, c, d) in enumerate(pairs) for n, y, x in ((1, a, b), (2, c, d))]
    boxes = spark.createDataFrame(rows, "page long, box_id long, y1 long, x1 long, y2 long, x2 long, score double")
    duck.register("pairs", boxes.toPandas())
    sql = sequential.NMS.replace("@v_boxes", "pairs")
    assert canon(sequential.nms(boxes).toPandas()) == canon(duck.execute(sql).df()) == canon(pd.DataFrame([(p, n) for p, own in enumerate(want) for n in own], columns=["page", "box_id"]))


def test_scopes_over_batches(spark, duck, monkeypatch):
    """Documents longer than a batch, empty and absent lists, gaps, by the SQL; and never a data frame a
    document."""
    monkeypatch.setattr(sequential, "per_group", None)
    monkeypatch.setattr(sequential, "LETTERS", 100)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        rows = [(d, p * (1 + (p + d) % 11 // 10), f"v{(p // 3 + k * d) % 9}" if p % 5 else None) for d in range(40) for p in range(1, 60 if d % 13 == 0 else 4) for k in range(1 + p % 2)]
        df = spark.createDataFrame(rows, "record_id long, page long, scaffold_ref string")
        duck.register("relations", df.toPandas())
        got = sequential.scopes(df.selectExpr("record_id AS doc_id", "page", "scaffold_ref").groupBy("doc_id", "page").agg(F.collect_set("scaffold_ref").alias("variables"))).toPandas()
        sql = sequential.SCOPES.replace("@v_relations", "relations").replace("list(scaffold_ref)", "coalesce(list(scaffold_ref) FILTER (scaffold_ref IS NOT NULL), [])")
        assert canon(got) == canon(duck.execute(sql).df()) and set(got["reason"]) == {"start", "gap", "no overlap", ""}
        odd = spark.createDataFrame([(1, 1, ["a", None]), (1, None, ["b"]), (1, 2, None), (None, 5, ["c"])], "doc_id long, page long, variables array<string>")
        assert canon(sequential.scopes(odd).toPandas()) == canon(pd.DataFrame([(1, 1, 1, "start", "a"), (1, 2, 1, "", "a"), (1, None, 2, "no overlap", "b"), (None, 5, 1, "start", "c")], columns=got.columns))
    finally:
        spark.conf.set(key, before)


def test_tasks_retry_and_type_errors(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id long, prompt string")

    def operation(p):
        if p == "bad":
            raise TimeoutError("slow")
        return "{}" if p else "no json"

    got = {r["id"]: (r["ok"], r["attempts"], r["error_type"]) for r in sequential.run_task(df, operation, retry=3).collect()}
    assert got == {1: (True, 1, ""), 2: (False, 3, "timeout"), 3: (False, 3, "contract")}


def test_ocr_bisection(spark):
    df = spark.createDataFrame([(1, p) for p in range(1, 8)], "doc_id long, page long")

    def client(pages):
        if 4 in pages:
            raise TimeoutError
        return [f"t{p}" for p in pages]

    got = {r["page"]: r["text"] for r in sequential.fetch_pages(df, client).collect()}
    assert got == {p: "" if p == 4 else f"t{p}" for p in range(1, 8)}


def test_streams(spark, sf):
    from marlstone.streaming import state

    events = state.events_stream(spark, f"{sf}/events.parquet".replace("events.parquet", "event[s].parquet"))
    n = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert state.drained(state.latest_status(events), "complete").count() == n
    assert state.drained(state.deliveries(events.unionByName(events)), "append").count() == spark.read.parquet(f"{sf}/events.parquet").count()


BOXES = sorted(n for n in SQL if "l_discount * 10" in SQL[n])


def test_boxes_cover_lineitem(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    boxes = catalogue.load(spark, sf, "v_boxes")
    assert boxes.count() == lines.count()
    assert boxes.select("page").distinct().count() == lines.selectExpr("l_orderkey % 50").distinct().count()
    assert QUERIES["sp06_tiling"](spark, sf).groupBy("page").count().where("count > 80").count() == 0
    assert QUERIES["wn06_line_merge"](spark, sf).count() == lines.count()


@pytest.mark.parametrize("name", BOXES)
def test_boxes_against_sql(spark, sf, duck, name):
    assert canon(QUERIES[name](spark, sf).toPandas()) == canon(duck.execute(SQL[name]).df())


WHOLE = ["tx26_revision_hash", "tx44_documents", "snk06_metadata_report", "jn04_dictionary_join"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    assert canon(got.toPandas()) == canon(duck.execute(SQL[name]).df())
    tasks = catalogue.load(spark, sf, "v_tasks").selectExpr("type", "task_id", "status", "n", "error").toPandas().sort_values("n")
    out = got.toPandas()
    if name == "tx44_documents":
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        assert dict(zip(out["doc_id"], out["text"])) == {k: None if t is None else t.rstrip("\r\n") for k, t in docs.items()}
    elif name == "jn04_dictionary_join":
        pages = catalogue.load(spark, sf, "v_assay_long").select("ord", "page")
        assert got.join(pages, "ord").select("page").distinct().count() == pages.select("page").distinct().count() > 1
    else:
        for kind, g in tasks.groupby("type"):
            row = out[out["type"] == kind].iloc[0]
            if name == "tx26_revision_hash":
                assert row["revision"] == hashlib.sha1("|".join(f"{t}:{s}" for t, s in zip(g["task_id"], g["status"])).encode()).hexdigest()
            else:
                assert row["report"].count("- ") == len(g)


def test_files_round_trip(spark):
    from marlstone.sources import files
    from marlstone.sources.shipping import scratch

    df = spark.createDataFrame([(1, 'a "b", c', None), (2, None, 2)], "k long, s string, n int")
    for bom in (True, False):
        path = scratch(spark, "t")
        files.write_csv(df, path, bom)
        assert sorted(map(tuple, files.read_csv(spark, path, "k long, s string, n int").collect())) == [(1, 'a "b", c', None), (2, "", 2)]
    path = scratch(spark, "t")
    df.write.parquet(path)
    files.replace_records(spark, path, spark.createDataFrame([(2, "new", 5), (9, "no row", 1)], "k long, s string, n int").where("k = 2"), "k")
    assert sorted(r["s"] for r in spark.read.parquet(path).collect()) == ['a "b", c', "new"]


def test_range_cache(spark):
    rows = [(1, k, key, n, bad) for k, (key, n, bad) in enumerate([("a", 1, False), ("a", 1, False), ("b", 65, False), ("b", 65, False), ("c", 1, True), ("c", 1, True), ("d", 1, False), ("e", 1, False), ("f", 1, False), ("a", 1, False), ("g", 1, False), ("d", 1, False), ("a", 1, False)])]
    got = shipments.cached_ranges(spark.createDataFrame(rows, "session long, seq long, key string, n_pages int, failed boolean")).orderBy("seq")
    assert [r["hit"] for r in got.collect()] == [False, True, False, False, False, False, False, False, False, True, False, False, True]


def test_admission_stops_at_a_heavy_head(spark):
    queue = spark.createDataFrame([(k, f"t{k}", 0, kind) for k, kind in enumerate(["light", "heavy", "light", "heavy", "light"])], "seq long, task_id string, partition_ord long, task_name string")
    none = queue.where("false")
    go = lambda most, cap, busy=none: sorted(r["task_id"] for r in tables.admitted(queue, busy, ["heavy"], most, cap).collect())
    assert go(9, 2) == ["t0", "t1", "t2", "t3", "t4"] and go(9, 1) == ["t0", "t1", "t2"] and go(2, 2) == ["t0", "t1"] and go(9, 0) == ["t0"]
    assert go(9, 1, queue.where("task_id = 't1'")) == ["t0", "t2"]


def test_payload_rules():
    assert payloads.merged({"a": {"b": 1}}, {"a": {"c": 2}, "d": [1]}) == {"a": {"b": 1, "c": 2}, "d": [1]}
    assert payloads.indel_ratio("abc", "abc") == 1 and payloads.indel_ratio("ab", "cd") == 0 and round(payloads.indel_ratio("abcd", "abxd"), 3) == 0.75
    assert payloads.beams([[-1.0, -0.5], [-0.1, -2.0]], 1, 9) == [([1, 0], -0.6)]
    assert payloads.violations('{"keep": true, "x": 1}', [("string", "x", None, True), ("string", "x", None, False)]) == ["x must be string"]


def test_rasters():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.5
        label, n = raster.labelled(mask)
        seen = np.zeros(mask.shape, int)
        count = 0
        for y, x in zip(*np.nonzero(mask)):  # flood fill
            if seen[y, x]:
                continue
            count += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 9 and 0 <= b < 11 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = count
                    stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        assert n == count and (label == seen).all()


def test_molecules():
    assert chemistry.graph("C1CC1")[1] == [(0, 1, 1), (1, 2, 1), (0, 2, 1)]
    for broken in ("C1CC", "C(C", "C)C", "C$"):
        with pytest.raises(ValueError):
            chemistry.graph(broken)
    assert chemistry.flipped("[C@H][C@@H]", [0, 1]) == "[C@@H][C@H]"


def test_groups_that_batches_cut(spark):
    """Groups larger and smaller than an Arrow batch are each met once, whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        df = spark.range(300).selectExpr("id", "CASE WHEN id < 90 THEN 0 ELSE id % 40 END AS a", "id % 2 AS b")
        got = sequential.per_group(df, ["a", "b"], lambda pdf: pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "n": [len(pdf)], "s": [pdf["id"].sum()]}), "a long, b long, n long, s long").collect()
        want = df.groupBy("a", "b").agg({"id": "sum", "*": "count"}).collect()
        assert sorted((r["a"], r["b"], r["n"], r["s"]) for r in got) == sorted((r["a"], r["b"], r["count(1)"], r["sum(id)"]) for r in want)
        assert sequential.per_group(df.limit(0), ["a"], lambda pdf: pdf[["a"]], "a long").count() == 0
    finally:
        spark.conf.set(key, before)
