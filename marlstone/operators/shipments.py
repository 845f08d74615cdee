"""Files in and out, caches and streams, each with a query that writes and reads back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import catalogue
from ..plans.views import ORD
from ..sources import files
from ..sources.shipping import scratch, written
from ..streaming import state
from .sequential import resolve, rows_of, run_task

frame = catalogue.frame


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalogue.load(spark, sf_dir, name)


STRUCTURES = "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('Example, \"', CAST(p_partkey AS STRING), '\"') END AS compound_id, p_name AS smiles, p_size AS page FROM @part"
catalogue.view("v_csv")(lambda d: STRUCTURES)


def _csv(bom: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "csv")
        files.write_csv(load(spark, sf_dir, "v_csv"), path, bom)
        return files.read_csv(spark, path, "k long, compound_id string, smiles string, page int")

    return query


BLANK = lambda d: "SELECT k, coalesce(compound_id, '') AS compound_id, smiles, page FROM @v_csv"
frame("snk01_csv_bom", BLANK)(_csv(True))
frame("snk02_csv_plain", BLANK)(_csv(False))
frame("src06_csv_blanks", BLANK)(_csv(False))


@frame("snk03_assay_json", lambda d: "SELECT replace(assay, ' ', '_') AS assay_slug, assay, raw_id, value FROM (SELECT CASE WHEN page % 2 = 0 THEN concat('IC ', page) ELSE concat('IC_', page) END AS assay, raw_id, value FROM @v_assay_long) t")
def _snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder for each assay, named with "_" for blanks and slashes; read as one table."""
    path = scratch(spark, "assays")
    name = F.when(F.col("page") % 2 == 0, F.concat(F.lit("IC "), "page")).otherwise(F.concat(F.lit("IC_"), "page"))
    files.write_assays(load(spark, sf_dir, "v_assay_long").select(name.alias("assay"), "raw_id", "value"), path)
    return spark.read.schema("assay string, raw_id string, value string, assay_slug string").json(path).select("assay_slug", "assay", "raw_id", "value")


@frame("snk04_audit_log", lambda d: "SELECT event_id, event_type AS task_name, value > 50 AS ok, substring(props, 1, 2000) AS preview FROM @events UNION ALL SELECT event_id, event_type, true, '' FROM @events WHERE value > 90")
def _snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one log of JSON lines."""
    path = scratch(spark, "audit")
    e = load(spark, sf_dir, "events").withColumnRenamed("event_type", "task_name")
    files.append_audit(e.select("event_id", "task_name", (F.col("value") > 50).alias("ok"), F.substring("props", 1, 2000).alias("preview")), path)
    files.append_audit(e.where("value > 90").select("event_id", "task_name", F.lit(True).alias("ok"), F.lit("").alias("preview")), path)
    return spark.read.schema("event_id long, task_name string, ok boolean, preview string").json(path)


@frame("snk07_replace_records", lambda d: "SELECT CASE WHEN n % 2 = 0 THEN concat('t', n) ELSE task_id END AS task_id, CASE WHEN n % 3 = 0 THEN 'edited' ELSE message END AS message, n FROM @v_tasks WHERE status = 'completed'".replace("CASE WHEN n % 2 = 0 THEN concat('t', n) ELSE task_id END", "task_id"))
def _snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of completed tasks, replaced where an edit gives new ones (SNK07)."""
    path = scratch(spark, "records")
    tasks = load(spark, sf_dir, "v_tasks").where("status = 'completed'").select("task_id", "message", "n")
    tasks.write.parquet(path)
    files.replace_records(spark, path, tasks.where("n % 3 = 0").withColumn("message", F.lit("edited")), "task_id")
    return spark.read.parquet(path).select("task_id", "message", "n")


@frame("src07_json_documents", lambda d: "SELECT o_orderkey AS record_id, o_orderstatus AS status, o_custkey AS customer FROM @orders")
def _src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-file JSON with a list at its top; a file with anything else there holds no record."""
    path = scratch(spark, "json")
    rows = load(spark, sf_dir, "orders").select(F.struct(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("r"), (F.col("o_orderkey") % 7).alias("f"))
    lists = rows.groupBy("f").agg(F.to_json(F.collect_list("r")).alias("value")).select("value")
    lists.unionByName(spark.createDataFrame([('{"record_id": 1}',)], "value string")).repartition(8).write.text(path)
    return files.read_lists(spark, path, "record_id long, status string, customer long")


@frame("src10_pdf_registry", lambda d: "SELECT concat('d', c_nationkey) AS doc_id, concat('a', min(c_custkey % 5), '.pdf') AS name FROM @customer GROUP BY c_nationkey")
def _src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first PDF by name of each folder of a registry (folders are written here first)."""
    path = scratch(spark, "registry")
    names = load(spark, sf_dir, "customer").selectExpr("c_nationkey AS doc", "c_custkey % 5 AS n").distinct()
    files.write_named(names.selectExpr("concat('d', doc, '/a', n, '.pdf') AS name", "concat('%PDF ', n) AS body").unionByName(names.selectExpr("concat('d', doc, '/0.txt') AS name", "'no pdf' AS body")), path)
    return files.registry(spark, path).select("doc_id", F.element_at(F.split("path", "/"), -1).alias("name"))


def cached_ranges(requests: DataFrame, entries: int = 4, pages: int = 64) -> DataFrame:
    """(session, seq, hit): which page-range requests a cache answers that keeps the last used
    ``entries`` ranges (SRC04).  A range of more than ``pages`` pages, or with a failed page, is
    never kept.  requests: session, seq, key, n_pages, failed."""

    def run(pdf):
        kept: dict = {}
        hits = []
        for key, n, failed in zip(pdf["key"], pdf["n_pages"], pdf["failed"]):
            hit = key in kept
            hits.append(hit)
            if hit:
                kept[key] = kept.pop(key)
            elif n <= pages and not failed:
                kept[key] = True
                if len(kept) > entries:
                    del kept[next(iter(kept))]
        return pdf[["session", "seq"]].assign(hit=hits)

    keyed = requests.select("session", "seq", "key", "n_pages", "failed")
    return keyed.groupBy("session").applyInPandas(lambda pdf: run(pdf.sort_values("seq")), "session long, seq long, hit boolean")


#: A key is kept if it was asked for before and fewer than 4 other cacheable keys were used since.
CACHE = """WITH r AS (SELECT o_custkey % 100 AS session, o_orderkey AS seq, o_custkey % 7 AS key, o_custkey % 7 <> 3 AS good FROM @orders),
p AS (SELECT *, max(CASE WHEN good THEN seq END) OVER (PARTITION BY session, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r)
SELECT session, seq, good AND last IS NOT NULL AND (SELECT count(DISTINCT o.key) FROM r o WHERE o.session = p.session AND o.good AND o.key <> p.key AND o.seq > p.last AND o.seq < p.seq) < 4 AS hit FROM p"""


@frame("src04_range_cache", lambda d: CACHE)
def _src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    key = F.col("o_custkey") % 7
    return cached_ranges(o.select((F.col("o_custkey") % 100).alias("session"), F.col("o_orderkey").alias("seq"), key.alias("key"), F.when(key == 3, 65).otherwise(5).alias("n_pages"), F.lit(False).alias("failed")))


def missing_plans(documents: DataFrame, plans: DataFrame, key: str = "key") -> DataFrame:
    """Documents without a readable plan in the cache (SRC17): a plan that is no JSON is a miss."""
    good = plans.where(F.col("plan").isNotNull() & (F.get_json_object("plan", "$.pages").isNotNull())).select(key)
    return documents.join(good, key, "left_anti")


@frame("src17_plan_cache", lambda d: "SELECT doc_id FROM @documents WHERE NOT (lang = 'en' AND doc_id % 3 = 0)")
def _src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans are written to a table and read back; those of every third English document are good,
    those of other English documents are broken."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.to_json(F.struct(F.col("lang"), F.col("doc_id").alias("path"))), 256).alias("key"))
    plans = written(docs.where("lang = 'en'").select("key", F.when(F.col("doc_id") % 3 == 0, F.lit('{"pages": [1]}')).otherwise("{broken").alias("plan")), "plans")
    return missing_plans(docs, plans).select("doc_id")


def polled(jobs: DataFrame, states: DataFrame, timeout: int) -> DataFrame:
    """(job, outcome, page, text): a job is followed until it is completed or failed; past the timeout
    it has timed out; pages are shifted by the job's offset (SRC18).  jobs: job, offset; states: job,
    at (seconds), state, texts (array)."""
    last = states.where((F.col("at") <= timeout) & F.col("state").isin("completed", "failed")).groupBy("job").agg(F.min_by(F.struct("state", "texts"), "at").alias("end"))
    df = jobs.join(last, "job", "left").select("job", "offset", F.coalesce("end.state", F.lit("timeout")).alias("outcome"), F.when(F.col("end.state") == "completed", F.col("end.texts")).alias("texts"))
    return df.select("job", "offset", "outcome", F.posexplode_outer("texts").alias("i", "text")).select("job", "outcome", (F.col("offset") + F.col("i")).cast("long").alias("page"), "text")


@frame("src18_job_polling", lambda d: "SELECT o_orderkey AS job, CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'timeout' ELSE 'completed' END AS outcome, CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_custkey + i END AS page, CASE WHEN o_orderkey % 4 IN (0, 3) THEN concat('t', i) END AS text FROM @orders CROSS JOIN (VALUES (0), (1)) v(i) WHERE i = 0 OR o_orderkey % 4 IN (0, 3)")
def _src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("offset"))
    n = F.col("job") % 4
    first = o.select("job", F.lit(2).alias("at"), F.lit("running").alias("state"), F.array(F.lit("early")).alias("texts"))
    end = o.select("job", F.when(n == 2, 900).otherwise(4).alias("at"), F.when(n == 1, "failed").otherwise("completed").alias("state"), F.array(F.lit("t0"), F.lit("t1")).alias("texts"))
    late = o.where(n == 3).select("job", F.lit(6).alias("at"), F.lit("failed").alias("state"), F.array(F.lit("late")).alias("texts"))
    return polled(o, first.unionByName(end).unionByName(late), 360)


# -- streams -----------------------------------------------------------------------------------


@frame("sm05_stale_stream", lambda d: "SELECT user_id, max(event_id) AS last_event FROM @events GROUP BY user_id")
def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept by a stream over the event files."""
    return state.drained(state.latest_status(state.events_stream(spark, f"{sf_dir}/event[s].parquet")), "complete").select("user_id", "last_event")


@frame("sm10_stream_deliveries", lambda d: "SELECT event_id, min(user_id) AS user_id FROM @events GROUP BY event_id")
def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, though the stream brings every one twice."""
    events = state.events_stream(spark, f"{sf_dir}/event[s].parquet").select("event_id", "user_id", "ts")
    return state.drained(state.deliveries(events.unionByName(events)), "append").select("event_id", "user_id")


# -- injected functions ------------------------------------------------------------------------


def with_context(records: DataFrame, builder: Callable[[str], str]) -> DataFrame:
    """(raw, context): a builder's text for each record, "" where it fails (UD02)."""

    def one(r):
        try:
            yield r["raw"], builder(r["raw"]) or ""
        except Exception:  # noqa: BLE001  whatever an injected builder raises
            yield r["raw"], ""

    return rows_of(records.select("raw"), one, "raw string, context string")


def _context(raw: str) -> str:
    if raw.startswith("("):
        raise ValueError("no brackets")
    return f"seen as {raw}"


@frame("ud02_context_builder", lambda d: "SELECT raw_id AS raw, CASE WHEN raw_id LIKE '(%' THEN '' ELSE concat('seen as ', raw_id) END AS context FROM (SELECT DISTINCT raw_id FROM @v_assay_long) t")
def _ud02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(load(spark, sf_dir, "v_assay_long").select(F.col("raw_id").alias("raw")).distinct(), _context)


@frame("ud01_injected_resolver", lambda d: "SELECT raw, CASE WHEN source <> 'unresolved' THEN canonical WHEN raw LIKE '(%' THEN '' ELSE concat('R', raw) END AS canonical, CASE WHEN source <> 'unresolved' THEN source WHEN raw LIKE '(%' THEN 'llm_error' ELSE 'llm_few_shot' END AS source FROM @v_resolved")
def _ud01(spark: SparkSession, sf_dir: str) -> DataFrame:
    def resolver(raw: str) -> str:
        if raw.startswith("("):
            raise RuntimeError("no answer")
        return f"R{raw}"

    return resolve(load(spark, sf_dir, "v_resolved"), resolver)


def _length(text: str) -> dict:
    if len(text) % 5 == 0:
        raise ValueError("a length that the parser refuses")
    return {"n": len(text)}


@frame("ud03_injected_extractor", lambda d: "SELECT p_partkey AS id, length(p_name) % 5 <> 0 AS ok, CASE WHEN length(p_name) % 5 <> 0 THEN concat('{\"n\": ', length(p_name), '}') ELSE '' END AS payload, CASE WHEN length(p_name) % 5 <> 0 THEN '' ELSE 'contract' END AS error_type FROM @part")
def _ud03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected extractor (UD03) and parser (UD04) over every row."""
    jobs = load(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS prompt")
    return run_task(jobs, operation=lambda p: p, parser=_length, retry=1).select("id", "ok", "payload", "error_type")


# -- tiles -------------------------------------------------------------------------------------


def tiled(boxes: DataFrame, height: int, width: int, most: int = 80) -> DataFrame:
    """Candidates of every tile in page coordinates, clipped to the page, the best ``most`` of a page
    (SP06).  boxes: page, tile_y, tile_x, y1, x1, y2, x2 (within the tile), score, box_id."""
    clip = lambda c, shift, top: F.greatest(F.lit(0), F.least(F.lit(top), F.col(c) + F.col(shift)))
    df = boxes.select("page", "box_id", "score", clip("y1", "tile_y", height).alias("y1"), clip("x1", "tile_x", width).alias("x1"), clip("y2", "tile_y", height).alias("y2"), clip("x2", "tile_x", width).alias("x2"))
    df = df.where((F.col("y2") > F.col("y1")) & (F.col("x2") > F.col("x1")))
    place = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "box_id", "y1", "x1"))
    return df.withColumn("place", place).where(F.col("place") <= most).drop("place")


@frame("sp06_tiling", lambda d: "SELECT page, box_id, CAST(y1 AS BIGINT) AS y1, CAST(x1 AS BIGINT) AS x1, CAST(y2 AS BIGINT) AS y2, CAST(x2 AS BIGINT) AS x2 FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, box_id, y1, x1) AS place FROM (SELECT page, box_id, score, least(700, b.y1 + dy) AS y1, least(500, b.x1 + dx) AS x1, least(700, b.y2 + dy) AS y2, least(500, b.x2 + dx) AS x2 FROM @v_boxes b CROSS JOIN (VALUES (0, 0), (0, 240), (350, 0), (350, 240)) t(dy, dx)) c WHERE y2 > y1 AND x2 > x1) p WHERE place <= 80")
def _sp06(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = spark.createDataFrame([(0, 0), (0, 240), (350, 0), (350, 240)], "tile_y long, tile_x long")
    out = tiled(load(spark, sf_dir, "v_boxes").crossJoin(F.broadcast(tiles)), 700, 500)
    return out.select("page", "box_id", *[F.col(c).cast("long").alias(c) for c in ("y1", "x1", "y2", "x2")])
