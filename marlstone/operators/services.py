"""Interfaces to engines that are injected (vision models, recognisers, chemistry searches), and what
goes round them: locks, steps, warnings, documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chemistry as H
from ..functions import columns as C
from ..functions import payloads as P
from ..plans.dialect import catalogue
from ..sources.shipping import ship
from . import ids, merge
from .rules import PAGE_CONTRACT, golden_rows, laid_out, rows_by
from .sequential import pack_text, page_parts, rows_of, run_task

frame = catalogue.frame


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalogue.load(spark, sf_dir, name)


# -- identifiers with literals -------------------------------------------------------------------

#: Raw answers and their normal forms (ID01 with its literal branch).
LITERALS = [
    (("{'COMPOUND_ID': 'Example {k}'}",), ("Example {k}",)), (("['Compound  {k}a']",), ("Compound {k}a",)), (('```json\n{"id": "see Example 1 and No. {k}"}\n```',), ("No. {k}",)),
    (("the answer was (Example {k}),",), ("Example {k}",)), (('{"answer": {"x": 1}}',), ("1",)), ((None,), ("",)), (("'IV'",), ("IV",)),
]


def normalised_ids(df: DataFrame, raw: str = "raw") -> DataFrame:
    """All columns and ``norm``: the normal form of an id in any wrapping (ID01)."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def unwrap(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: P.unwrapped(None if pd.isna(t) else t))

    held = df.withColumn("held_", unwrap(F.col(raw)))
    return catalogue.run(df.sparkSession, lambda d: ids.normalised(d, "SELECT * FROM @held", "held_"), {"held": held}.__getitem__).drop("held_")


golden_rows("id01_normalise_literals", ["raw"], "norm string", LITERALS, lambda raw: ("",))
catalogue.frames["id01_normalise_literals"] = lambda spark, sf_dir: normalised_ids(laid_out(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", ["raw"], LITERALS)).select("k", "norm")


# -- pages --------------------------------------------------------------------------------------


def page_subset(pages: DataFrame, numbers: list[int]) -> DataFrame:
    """The chosen pages of each document (SRC13).  A document that lacks one of them has a row with an
    error, and no page."""
    wanted = sorted(set(numbers))
    spark = pages.sparkSession
    asked = spark.createDataFrame([(n,) for n in wanted], "page long")
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    bad = F.when((F.col("last") < max(wanted, default=0)) | F.lit(min(wanted, default=1) < 1), F.concat(F.lit("page out of range 1-"), F.col("last").cast("string")))
    judged = ends.select("doc_id", bad.alias("error"))
    good = pages.join(F.broadcast(asked), "page", "left_semi").join(judged.where("error IS NULL").select("doc_id"), "doc_id", "left_semi")
    return good.select("doc_id", "page", "text", F.lit(None).cast("string").alias("error")).unionByName(judged.where("error IS NOT NULL").select("doc_id", F.lit(None).cast("long").alias("page"), F.lit(None).cast("string").alias("text"), "error"))


@frame("src13_page_subset", lambda d: "WITH n AS (SELECT doc_id, max(page) AS last FROM @v_lines GROUP BY doc_id) SELECT l.doc_id, l.page, l.text, CAST(NULL AS VARCHAR) AS error FROM @v_lines l JOIN n ON n.doc_id = l.doc_id WHERE n.last >= 4 AND (l.page = 1 OR l.page = 3 OR l.page = 4) UNION ALL SELECT doc_id, NULL, NULL, concat('page out of range 1-', last) FROM n WHERE last < 4")
def _src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_subset(load(spark, sf_dir, "v_lines"), [4, 1, 3, 3])


# -- warnings and documents ----------------------------------------------------------------------


def warnings(decisions: DataFrame, scope: str) -> DataFrame:
    """(event_id, scope, error_type, error): a row for each decision that breaks its contract; the others
    go on without one (SNK08)."""

    def one(r: dict) -> Iterator[tuple]:
        faults = P.violations(r["payload"], PAGE_CONTRACT)
        if faults:
            yield r["event_id"], scope, "contract", "; ".join(faults)

    return rows_of(decisions.select("event_id", "payload"), one, "event_id long, scope string, error_type string, error string")


@frame("snk08_warnings", lambda d: "SELECT event_id, 'assay' AS scope, 'contract' AS error_type, CASE event_id % 3 WHEN 0 THEN 'not an object' ELSE 'missing confidence; missing pages' END AS error FROM @events WHERE event_id % 3 < 2")
def _snk08(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    e = load(spark, sf_dir, "events").select("event_id", F.when(n == 0, F.lit("no json")).when(n == 1, F.lit('{"keep": true}')).otherwise(F.lit('{"keep": false, "confidence": "low", "reason": "none"}')).alias("payload"))
    return warnings(e, "assay")


golden_rows("snk09_markdown_blocks", ["s"], "text string", [
    (('[{"type": "title", "level": 2, "text": "A\\nB"}, {"type": "text", "text": "1. x_y"}]',), ("\n## A B\n1\\. x\\_y\n",)),
    (('[{"type": "table", "text": "<table></table>"}, {"type": "footer", "text": "#{k}"}]',), ("<table></table>\n\\#{k}\n",)),
    (('[{"type": "figure", "name": "f{k}.png"}, {"type": "title", "level": 9, "text": "t"}]',), ("![f{k}.png](f{k}.png)\n\n###### t\n",)), (("[]",), ("",)),
], lambda s: (P.markdown(json.loads(s)),))

golden_rows("sm06_lease_lock", ["s"], "taken string", [
    (("0 acquire a x 0|10 acquire a y 0|60 acquire a y 0",), ("1 0 1",)), (("0 acquire a x 500|400 acquire a y 9|400 release a y 0|401 release a x 0|402 acquire a y 0",), ("1 0 0 1 1",)),
    (("0 acquire a x 0|1 acquire b x 0|2 release a - 0|3 acquire a z 0",), ("1 1 1 1",)), (("0 release a x 0|0 acquire a x 70|69 acquire a x 0|70 release a x 0",), ("0 1 0 0",)),
], lambda s: (" ".join(str(int(x)) for x in P.leases([(float(e.split()[0]), e.split()[1], e.split()[2], e.split()[3].replace("-", ""), float(e.split()[4])) for e in s.split("|")])),))


def _step(kind: str):
    import time

    if kind == "fails":
        raise ValueError("no page")
    if kind in ("slow", "cancelled"):
        time.sleep(0.4)
    return kind


golden_rows("sm09_interruptible_step", ["s"], "outcome string, value string", [
    (("quick",), ("done", "quick")), (("fails",), ("failed", "ValueError: no page")), (("slow",), ("timeout", None)), (("cancelled",), ("cancelled", None)),
], lambda s: P.interruptible(lambda: _step(s), timeout=0.05, heartbeat=0.02, cancelled=lambda: s == "cancelled"), table="nation", key="n_nationkey")


# -- injected models -----------------------------------------------------------------------------


def vision_task(jobs: DataFrame, operation: Callable[[bytes, str], str], at_once: int = 2, **how) -> DataFrame:
    """A vision task over (id, image, prompt), with the errors, retries and audit columns of the text
    task (ML02).  At most ``at_once`` calls run at a time: as many as there are partitions."""

    def ask(packed: str) -> str:
        image, _, prompt = packed.partition(" ")
        return operation(bytes.fromhex(image), prompt)

    packed = jobs.select("id", F.concat_ws(" ", F.lower(F.hex(F.coalesce("image", F.lit("").cast("binary")))), F.coalesce("prompt", F.lit(""))).alias("prompt"))
    return run_task(packed.coalesce(at_once), operation=ask, **how)


def _seen(image: bytes, prompt: str) -> str:
    if not image:
        raise TimeoutError("no image")
    return json.dumps({"bytes": len(image), "prompt": prompt})


@frame("ml02_vision_task", lambda d: "SELECT p_partkey AS id, p_partkey % 5 <> 0 AS ok, CAST(CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('{\"bytes\": ', length(p_name), ', \"prompt\": \"is it whole?\"}') END AS payload, CASE WHEN p_partkey % 5 = 0 THEN 'timeout' ELSE '' END AS error_type FROM @part")
def _ml02(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name").cast("binary"))
    jobs = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), image.alias("image"), F.lit("is it whole?").alias("prompt"))
    return vision_task(jobs, _seen, retry=3).drop("error")


def reviewed(jobs: DataFrame, operation: Callable[[bytes, str], str], fallback: dict, **how) -> DataFrame:
    """(id, ok, payload, error_type): a visual review of each item, and a typed answer in the place of one
    that fails (ML14)."""
    done = vision_task(jobs, operation, **how)
    said = F.when(F.col("ok"), F.col("payload")).otherwise(F.lit(json.dumps(fallback, sort_keys=True)))
    return done.select("id", "ok", said.alias("payload"), "error_type")


@frame("ml14_review_fallback", lambda d: "SELECT n_nationkey AS id, n_nationkey % 5 <> 0 AS ok, CASE WHEN n_nationkey % 5 = 0 THEN '{\"box_status\": \"uncertain\", \"confidence\": \"low\"}' ELSE concat('{\"bytes\": ', length(n_name), ', \"prompt\": \"\"}') END AS payload, CASE WHEN n_nationkey % 5 = 0 THEN 'timeout' ELSE '' END AS error_type FROM @nation")
def _ml14(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name").cast("binary")).alias("image"), F.lit("").alias("prompt"))
    return reviewed(jobs, _seen, {"box_status": "uncertain", "confidence": "low"}, retry=1)


def recognised(images: DataFrame, recogniser: Callable[[list[bytes]], list[str]], batch: int = 16) -> DataFrame:
    """(id, smiles, n_atoms, formula): an injected recogniser over batches of images (ML11); what it
    can't read, or what is no molecule, has none."""
    ship(images.sparkSession)

    def run(frames):
        for pdf in frames:
            found: list[str] = []
            cells = [bytes(x) if x is not None else b"" for x in pdf["image"]]
            for k in range(0, len(cells), batch):
                found += recogniser(cells[k : k + batch])
            rows = []
            for name, smiles in zip(pdf["id"], found):
                try:
                    rows.append((name, smiles, len(H.graph(smiles)[0]), H.molecular_formula(smiles)))
                except ValueError:
                    rows.append((name, "", 0, ""))
            yield pd.DataFrame(rows, columns=["id", "smiles", "n_atoms", "formula"])

    return images.select("id", "image").mapInPandas(run, "id long, smiles string, n_atoms long, formula string")


#: What the stub reads, its atoms and formula: by hand.
MOLECULES = [("CCO", 3, "C2H6O"), ("c1ccccc1", 6, "C6H6"), ("CC(=O)N", 4, "C2H5NO"), ("C1CC", 0, ""), ("ClC#N", 3, "CClN")]


def _read(images: list[bytes]) -> list[str]:
    if len(images) > 16:
        raise ValueError("too many at once")
    return [MOLECULES[int(x) % len(MOLECULES)][0] for x in images]


def _molecules(column: int) -> str:
    return "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN " + (f"'{m[column]}'" if isinstance(m[column], str) else str(m[column])) for i, m in enumerate(MOLECULES)) + " END"


@frame("ml11_recogniser", lambda d: f"SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 3 THEN '' ELSE {_molecules(0)} END AS smiles, CAST({_molecules(1)} AS BIGINT) AS n_atoms, {_molecules(2)} AS formula FROM @part")
def _ml11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").cast("binary").alias("image")), _read)


# -- chemical search -----------------------------------------------------------------------------


def searched(molecules: DataFrame, query: str, low: float = 0.0, high: float = 1.0, top: int | None = None) -> DataFrame:
    """(id, smiles, exact, part, similarity, formula) of molecules against a query (SRC16): equal text,
    holds the query as a substructure, Tanimoto similarity of path fingerprints within a range, the
    ``top`` most similar if wanted.  A text that is no molecule is left out."""
    pattern, own, formula = H.graph(query), H.features(query), H.molecular_formula(query)

    def one(r: dict) -> Iterator[tuple]:
        try:
            found = H.graph(r["smiles"])
        except ValueError:
            return
        likeness = round(H.tanimoto(H.features(r["smiles"]), own), 6)
        if low <= likeness <= high:
            yield r["id"], r["smiles"], r["smiles"] == query, H.contains(found, pattern), likeness, H.molecular_formula(r["smiles"]) == formula

    out = rows_of(molecules.select("id", "smiles"), one, "id long, smiles string, exact boolean, part boolean, similarity double, same_formula boolean")
    return out if top is None else out.orderBy(F.desc("similarity"), "id").limit(top)


#: Molecules against CCO: holds it, similarity (paths shared over paths of either), same formula; by hand.
AGAINST = [("CCO", True, 1.0, True), ("OCC", True, 1.0, True), ("COC", False, round(4 / 8, 6), True), ("CC", False, round(2 / 7, 6), False), ("CC(O)C", True, round(7 / 8, 6), False), ("C=O", False, round(2 / 9, 6), False)]


@frame("src16_molecule_search", lambda d: "SELECT p_partkey AS id, v.smiles, v.smiles = 'CCO' AS exact, v.part, v.similarity, v.formula AS same_formula FROM @part JOIN (VALUES " + ", ".join(f"({i}, '{s}', {p}, CAST({x} AS DOUBLE), {f})" for i, (s, p, x, f) in enumerate(AGAINST)) + f") v(i, smiles, part, similarity, formula) ON p_partkey % {len(AGAINST)} = v.i")
def _src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_partkey") % len(AGAINST)).cast("int") + 1
    return searched(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(m[0]) for m in AGAINST]), at).alias("smiles")), "CCO")


@frame("src16_top_similar", lambda d: "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 1.0 ELSE 1.0 END AS similarity FROM @part WHERE p_partkey % 6 < 2 ORDER BY p_partkey LIMIT 10")
def _src16_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_partkey") % len(AGAINST)).cast("int") + 1
    molecules = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(m[0]) for m in AGAINST]), at).alias("smiles"))
    return searched(molecules, "CCO", top=10).select("id", "similarity")


# -- chunks --------------------------------------------------------------------------------------

golden_rows("tx14_pack_text", ["s", "most"], "chunks string", [
    (("One two. Three four. Five", 14), ("One two.|Three four.|Five",)), (("One two. Three four. Five", 20), ("One two. Three four.|Five",)), (("short {k}", 40), ("short {k}",)),
    (("aaaa bbbb; cccc dddd eeee", 10), ("aaaa bbbb;|cccc dddd|eeee",)), (("abcdefghijkl", 5), ("abcde|fghij|kl",)), (("", 5), ("",)),
], lambda s, most: ("|".join(pack_text(s or "", most)),))

golden_rows("tx17_assemble_page", ["s", "most"], "chunks string", [
    (("head\n| a | b |\n|--|--|\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |\ntail", 200), ("head~| a | b |/|--|--|/| 1 | 2 |/| 3 | 4 |~| a | b |/|--|--|/| 5 | 6 |~tail",)), (("only text", 200), ("only text",)), (("<table>\n<tr></tr>\n</table>\nafter", 200), ("<table>/<tr></tr>/</table>~after",)),
], lambda s, most: ("~".join(x.replace("\n", "/") for x in page_parts(s, most, 2)),))


# -- text operators over cases of their own ------------------------------------------------------


def golden_text(name: str, names: list[str], schema: str, cases: list[tuple], text, **tables) -> None:
    """As golden(), for an operator that is one SQL text: it reads the cases as ``@cases`` and other inputs
    from the tables given (functions of a session)."""
    golden_rows(name, names, schema, cases, lambda *c: ())

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = {"cases": laid_out(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", names, cases)} | {n: make(spark) for n, make in tables.items()}

        def source(n: str) -> DataFrame:
            return inputs[n] if n in inputs else catalogue.run(spark, catalogue.views[n], source)

        return catalogue.run(spark, text, source)

    catalogue.frames[name] = query


def _one(d, expression: str, column: str = "raw") -> str:
    return f"SELECT k, {d.let(f"coalesce({column}, '')", 'c', expression)} AS out FROM @cases"


golden_text("id01_normal_forms", ["raw"], "norm string", [
    (("  Example   {k} ",), ("Example {k}",)), (("see Example 1 and Compound {k}",), ("Compound {k}",)), (("(12a)",), ("(12a)",)), (('{"COMPOUND_ID": null, "value": "No. {k}"}',), ("No. {k}",)),
    (("12-b;",), ("12-b",)), (("the model returned label (7) here",), ("the model returned label (7) here",)), (("so ... (7) !",), ("(7)",)), (("",), ("",)), ((None,), ("",)), (("a long text without any identifier in it at all",), ("a long text without any identifier in it at all",)),
], lambda d: f"SELECT k, norm FROM ({ids.normalised(d, 'SELECT k, raw FROM @cases', 'raw')}) n")

golden_text("id02_concise_forms", ["raw"], "out boolean", [
    (("12a",), (True,)), (("Example {k}",), (True,)), (("no digits here",), (True,)), (("two words or more than four 1",), (False,)), (("the answer 1",), (False,)), (("",), (False,)), (("ab efgh",), (False,)), (("abc efgh",), (True,)), (("(1) ",), (False,)), (("1/2",), (True,)),
], lambda d: _one(d, ids.concise(d, "c")))

golden_text("id03_alias_tokens", ["raw"], "out string", [
    (("Example {k}",), ("example{k}",)), (("(No. 7-B)",), ("no7b",)), (("化合物 3",), ("化合物3",)), (("--",), ("",)), ((None,), ("",)),
], lambda d: _one(d, ids.token(d, "c")))

golden_text("id04_part_forms", ["norm"], "prefix string, core string", [
    (("Example {k}",), ("Example", "{k}")), (("Compound IVa",), ("Compound", "IVa")), (("12a",), ("", "12a")), (("(7)",), ("", "7")), (("实施例 5",), ("实施例", "5")), (("alpha beta",), ("", "")), (("Formula 3-x",), ("Formula", "3-x")),
], lambda d: f"SELECT k, prefix, core FROM ({ids.parted(d, 'SELECT k, norm FROM @cases')}) p")


def _officials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(["Example 1", "Compound 5", "12", "Example 12", "7b"])), "ord long, compound_id string")


golden_text("id07_resolved_forms", ["raw_id"], "canonical string, source string", [
    (("1",), ("Example 1", "deterministic_alias")), (("Example 1",), ("Example 1", "exact_match")), (("Ex. 5",), ("Compound 5", "deterministic_alias")), (("(12)",), ("Example 12", "deterministic_preferred")),
    (("Example 12",), ("Example 12", "exact_match")), (("7B",), ("7b", "deterministic_alias")), (("No. 12",), ("", "unresolved")), (("nothing like it",), ("", "unresolved")), (("",), ("", "empty")), (("Formula 7b",), ("7b", "deterministic_alias")),
], lambda d: "SELECT c.k, r.canonical, r.source FROM @cases c JOIN @v_resolved r ON r.raw = c.raw_id", v_structures=_officials, v_assay_long=lambda spark: spark.createDataFrame([(r,) for r in ("1", "Example 1", "Ex. 5", "(12)", "Example 12", "7B", "No. 12", "nothing like it", "", "Formula 7b")], "raw_id string"))

golden_text("tx19_value_forms", ["value"], "number string, unit string", [
    (("{k} nM",), ("{k}", "nM")), (("< {k}.5 µM",), ("<{k}.5", "µM")), (("++",), ("++", "")), (("1.2 x 10^-3 M",), ("1.2x10^-3", "M")), (("{k}%",), ("{k}", "%")), (("-4 mg/mL",), ("-4", "mg/mL")), (("4 5 nM",), ("4 5 nM", "")), (("",), ("", "")),
], lambda d: f"SELECT k, {merge.value_of(d, 'value')} AS number, {merge.unit_of(d, 'value')} AS unit FROM @cases")

golden_text("tx20_name_forms", ["assay", "unit"], "name string", [
    (("IC50", "nM"), ("IC50 (nM)",)), (("IC50 (nM)", "nM"), ("IC50 (nM)",)), (("", "nM"), ("Assay (nM)",)), (("Ki{k}", ""), ("Ki{k}",)), (("  ", ""), ("Assay",)), (("IC50 (uM)", "nM"), ("IC50 (uM) (nM)",)),
], lambda d: f"SELECT k, {merge.column_of(d, 'assay', 'unit')} AS name FROM @cases")


# -- OCR jobs ------------------------------------------------------------------------------------

ENDPOINTS = ("pdf-to-markdown", "image-to-markdown", "pdf-to-word", "image-to-word")


def ocr_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """(request, job_id, queued, status): requests for the same pages of the same content in the same way
    are one job (ML13).  It is queued by its first request unless it is pending, running or completed;
    an unknown endpoint fails.  requests: request, content (binary), document_key, endpoint, lang, page_start,
    page_end, page_number_offset, return_raw; jobs: job_id, status."""
    key = F.coalesce(F.nullif(F.trim(F.coalesce("document_key", F.lit(""))), F.lit("")), F.sha2("content", 256))
    number = lambda c: F.col(c).cast("string")
    job = C.hash_key(
        document_key=C.quoted(key), endpoint=C.quoted(F.col("endpoint")), lang=C.quoted(F.col("lang")), page_end=number("page_end"), page_start=number("page_start"),
        page_number_offset=number("page_number_offset"), return_raw=number("return_raw"),
    )
    named = requests.select("request", "endpoint", job.alias("job_id")).join(jobs.select("job_id", F.col("status").alias("stored")), "job_id", "left")
    active = F.coalesce(F.col("stored").isin("pending", "running", "completed"), F.lit(False))
    queued = ~active & (F.row_number().over(Window.partitionBy("job_id").orderBy("request")) == 1)
    status = F.when(active, F.col("stored")).when(F.col("endpoint").isin(*ENDPOINTS), "pending").otherwise("failed")
    return named.select("request", "job_id", queued.alias("queued"), status.alias("status"))


JOBS = """WITH r AS (SELECT o_orderkey AS request, sha256(concat('{"document_key": "', CASE WHEN o_custkey % 2 = 0 THEN concat('d', o_custkey) ELSE sha256(CAST(o_custkey AS VARCHAR)) END, '", "endpoint": "', CASE WHEN o_custkey % 7 = 0 THEN 'fax' ELSE 'pdf-to-word' END, '", "lang": "en", "page_end": ', o_custkey % 3, ', "page_number_offset": 0, "page_start": 1, "return_raw": false}')) AS job_id, o_custkey AS c FROM @orders)
SELECT request, job_id, c % 5 <> 0 AND request = min(request) OVER (PARTITION BY job_id) AS queued, CASE WHEN c % 5 = 0 THEN 'completed' WHEN c % 7 = 0 THEN 'failed' ELSE 'pending' END AS status FROM r"""


@frame("ml13_ocr_jobs", lambda d: JOBS)
def _ml13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    requests = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request"), c.cast("string").cast("binary").alias("content"), F.when(c % 2 == 0, F.concat(F.lit(" d"), c.cast("string"))).alias("document_key"),
        F.when(c % 7 == 0, "fax").otherwise("pdf-to-word").alias("endpoint"), F.lit("en").alias("lang"), F.lit(1).alias("page_start"), (c % 3).alias("page_end"), F.lit(0).alias("page_number_offset"), F.lit(False).alias("return_raw"))
    none = spark.createDataFrame([], "job_id string, status string")
    done = ocr_jobs(requests.where(c % 5 == 0), none).select("job_id", F.lit("completed").alias("status")).distinct()
    late = ocr_jobs(requests.where(c % 5 == 1), none).select("job_id", F.lit("failed").alias("status")).distinct()
    return ocr_jobs(requests, done.unionByName(late))


golden_rows("tx11_block_validity", ["s"], "valid boolean", [
    (("| a | b |\n|---|---|\n| 1 | 2 |",), (True,)), (("| a | b |",), (False,)), (("| a | b |\n| c | d |",), (False,)), (("| id | b |\n| c | d |\n| e | f |",), (True,)), (("| a | b |\n| 1 | 5 nM |\n| 2 | 6 nM |",), (True,)),
    (("| a | b |\n| x | y |\n| z | w |",), (False,)), (("|---|---|\n| a | b | c |\n| d | e |",), (False,)), (("# a | b | c\n* d | e | f",), (False,)), (("| a |\n| b |\n| c |",), (False,)),
], lambda s: (P.valid_block(s.split("\n")),))
