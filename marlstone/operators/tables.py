"""Operators over several tables, written with the DataFrame API; their SQL is written apart, from
what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import catalogue
from ..plans.views import ORD

frame = catalogue.frame


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalogue.load(spark, sf_dir, name)


# -- pivots ------------------------------------------------------------------------------------


def assay_names(values: DataFrame, assay: str = "assay") -> list[str]:
    """The assays of a table, in order: as many as the result has columns."""
    return [r[0] for r in values.select(assay).where(F.col(assay).isNotNull()).distinct().orderBy(assay).collect()]


def assay_pivot(values: DataFrame, names: list[str] | None = None, id_col: str = "canonical", assay: str = "assay", value: str = "value", order: str = "ord") -> DataFrame:
    """One row for each compound, one column for each assay; the last writer wins (AG01).  Without
    names the columns are the assays that the table holds."""
    names = assay_names(values, assay) if names is None else names
    return values.groupBy(id_col).agg(*[F.max_by(F.when(F.col(assay) == n, F.col(value)), F.when(F.col(assay) == n, F.col(order))).alias(n) for n in names])


def pipeline_merge(structures: DataFrame, values: DataFrame, names: list[str] | None = None, norm: str = "norm", id_col: str = "canonical") -> DataFrame:
    """Every structure with the assay values of its canonical id (JN01)."""
    wide = assay_pivot(values, names, id_col)
    return structures.join(wide, F.col(norm) == F.col(id_col), "left").drop(id_col)


CELLS = ", ".join(f"max(CASE WHEN assay = 'IC{k}' THEN value END) AS IC{k}" for k in range(1, 8))
#: The last row of each compound and assay, by rank; then one row for each compound.
LAST = f"SELECT canonical, {CELLS} FROM (SELECT canonical, assay, value, row_number() OVER (PARTITION BY canonical, assay ORDER BY ord DESC) AS n FROM @v_remapped) t WHERE n = 1 GROUP BY canonical"


@frame("ag01_assay_pivot", lambda d: LAST)
def _ag01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assay_pivot(load(spark, sf_dir, "v_remapped"), [f"IC{k}" for k in range(1, 8)])


@frame("ag01_dynamic_columns", lambda d: f"SELECT CAST(c AS VARCHAR) AS assay, CAST(n AS BIGINT) AS compounds FROM (UNPIVOT (SELECT {', '.join(f'count(IC{k}) AS IC{k}' for k in range(1, 8))} FROM ({LAST}) w) ON COLUMNS(*) INTO NAME c VALUE n) u")
def _ag01_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the pivot finds by itself, and how many compounds each has."""
    wide = assay_pivot(load(spark, sf_dir, "v_remapped"))
    names = [c for c in wide.columns if c != "canonical"]
    return wide.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "assay", "compounds")


@frame("jn01_pipeline_merge", lambda d: f"SELECT s.ord, s.compound_id, s.smiles, {', '.join(f'w.IC{k}' for k in range(1, 8))} FROM @v_structures s JOIN @v_named n ON n.ord = s.ord LEFT JOIN ({LAST}) w ON n.norm = w.canonical")
def _jn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = catalogue.run(spark, catalogue.views["v_named_wide"], lambda n: load(spark, sf_dir, n))
    return pipeline_merge(named, load(spark, sf_dir, "v_remapped"), [f"IC{k}" for k in range(1, 8)]).drop("norm")


# -- queues ------------------------------------------------------------------------------------


def fair_places(queue: DataFrame, order: str = "seq", partition: str = "partition_ord") -> DataFrame:
    """Each job's place in the fair order (WN04): first jobs of all partitions, then second ones...
    The place is the number of jobs of earlier turns and of earlier partitions in the same turn, from
    two tables that have a row for each turn; no window spans the jobs."""
    turned = queue.withColumn("turn", F.row_number().over(Window.partitionBy(partition).orderBy(order)))
    within = F.row_number().over(Window.partitionBy("turn").orderBy(partition))
    turns = turned.groupBy("turn").agg(F.count("*").alias("jobs"))
    before = turns.withColumn("before", F.sum("jobs").over(Window.orderBy("turn")) - F.col("jobs")).select("turn", "before")
    return turned.withColumn("within", within).join(before, "turn").withColumn("place", (F.col("before") + F.col("within")).cast("int")).drop("before", "within")


@frame("wn04_fair_queue", lambda d: "SELECT task_id, CAST(row_number() OVER (ORDER BY turn, partition_ord) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY partition_ord ORDER BY seq) AS turn FROM @v_queue) q")
def _wn04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_places(load(spark, sf_dir, "v_queue")).select("task_id", "place")


def pop_next(queue: DataFrame, order: str = "seq", partition: str = "partition_ord") -> DataFrame:
    """The head of the fair order (SM02): the smallest partition's first job."""
    return queue.orderBy(partition, order).limit(1)


@frame("sm02_pop_next", lambda d: "SELECT task_id FROM @v_queue ORDER BY partition_ord, seq LIMIT 1")
def _sm02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pop_next(load(spark, sf_dir, "v_queue")).select("task_id")


def admitted(queue: DataFrame, inflight: DataFrame, heavy: list[str], most: int, most_heavy: int, order: str = "seq", partition: str = "partition_ord") -> DataFrame:
    """Jobs that may start now (SM04), in the fair order and as far as there is room beside what is
    running; a heavy job at the heavy cap stops everything behind it.  The window spans the free
    places only."""
    is_heavy = F.col("task_name").isin(heavy)
    running = inflight.agg(F.count("*").alias("n"), F.count(F.when(is_heavy, 1)).alias("heavy")).first()
    room = max(0, most - running["n"])
    turned = queue.join(inflight.select("task_id"), "task_id", "left_anti").withColumn("turn", F.row_number().over(Window.partitionBy(partition).orderBy(order)))
    head = turned.orderBy("turn", partition).limit(room)
    upto = Window.orderBy("turn", partition).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stops = is_heavy & (F.count(F.when(is_heavy, 1)).over(upto) + running["heavy"] > most_heavy)
    return head.withColumn("stop", stops.cast("int")).withColumn("stop", F.max("stop").over(upto)).where("stop = 0").drop("stop", "turn")


@frame("sm04_admission", lambda d: "WITH busy AS (SELECT * FROM @v_queue WHERE seq < 10), turned AS (SELECT *, row_number() OVER (PARTITION BY partition_ord ORDER BY seq) AS turn FROM @v_queue WHERE seq >= 10), placed AS (SELECT *, row_number() OVER (ORDER BY turn, partition_ord) AS place, sum(CASE WHEN task_name = 'structure' THEN 1 ELSE 0 END) OVER (ORDER BY turn, partition_ord) AS heavy FROM turned), stop AS (SELECT min(place) AS place FROM placed WHERE task_name = 'structure' AND heavy + (SELECT count(*) FROM busy WHERE task_name = 'structure') > 6) SELECT task_id FROM placed WHERE place <= 40 - (SELECT count(*) FROM busy) AND place < coalesce((SELECT place FROM stop), 1000000)")
def _sm04(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = load(spark, sf_dir, "v_queue")
    return admitted(queue, queue.where("seq < 10"), ["structure"], 40, 6).select("task_id")


def task_page(tasks: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """A page of sorted tasks with their places (SO02); a page past the end is the last one.  Sorting
    stops at the page's end, and the window spans the rows up to there."""
    last = -(-tasks.count() // size)
    page = max(1, min(max(page, 1), last))
    head = tasks.orderBy(*order).limit(page * size)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > (page - 1) * size)


@frame("so02_paging", lambda d: "SELECT task_id, place FROM (SELECT task_id, CAST(row_number() OVER (ORDER BY updated_at DESC, n) AS INT) AS place FROM @v_tasks) t WHERE place BETWEEN 41 AND 60")
def _so02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_page(load(spark, sf_dir, "v_tasks"), 3, 20, F.desc("updated_at"), F.asc("n")).select("task_id", "place")


@frame("sm11_reassembly", lambda d: "SELECT doc_id, ord, CAST((SELECT count(*) FROM @v_assay_long b WHERE b.flag = 'R' AND b.doc_id = a.doc_id AND (b.page < a.page OR b.page = a.page AND b.ord <= a.ord)) AS INT) AS place FROM @v_assay_long a WHERE a.flag = 'R'")
def _sm11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that came back in any order, put in the order of their pages, document by document."""
    done = load(spark, sf_dir, "v_assay_long").where("flag = 'R'")
    return done.select("doc_id", "ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")).alias("place"))


@frame("sm12_membership", lambda d: "SELECT task_id, task_id IN (SELECT task_id FROM @v_queue WHERE seq < 10) AS inflight, partition_ord IN (SELECT partition_ord FROM @v_queue WHERE seq < 10) AS busy FROM @v_queue")
def _sm12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job is running, and whether its partition has one running."""
    queue = load(spark, sf_dir, "v_queue")
    running = queue.where("seq < 10")
    named = queue.join(running.select(F.col("task_id"), F.lit(True).alias("inflight")), "task_id", "left")
    return named.join(running.select("partition_ord", F.lit(True).alias("busy")).distinct(), "partition_ord", "left").select("task_id", F.coalesce("inflight", F.lit(False)).alias("inflight"), F.coalesce("busy", F.lit(False)).alias("busy"))


# -- scopes and candidates ---------------------------------------------------------------------


@frame("fl11_markush_candidates", lambda d: "SELECT page, ref, structure_type FROM @v_candidates c WHERE structure_type <> 'complete' AND (SELECT count(*) FROM @v_candidates o WHERE o.structure_type <> 'complete' AND o.k <= c.k) <= 80")
def _fl11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 80 candidates (the rule's own limit) that can take part in an assembly."""
    return load(spark, sf_dir, "v_candidates").where("structure_type IN ('markush', 'fragment', 'text_substituent')").orderBy("k").limit(80).select("page", "ref", "structure_type")


def back_references(candidates: DataFrame, most: int = 8) -> DataFrame:
    """For each page the last ``most`` scaffolds of earlier pages (WN10).  No page can give more than
    its own last ones, so pages meet only these."""
    own = Window.partitionBy("page").orderBy(F.desc("k"))
    last = candidates.where("structure_type = 'markush'").withColumn("n", F.row_number().over(own)).where(F.col("n") <= most)
    met = candidates.select(F.col("page").alias("grp")).distinct().join(last, F.col("page") < F.col("grp"))
    best = Window.partitionBy("grp").orderBy(F.desc("page"), F.desc("k"))
    return met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("grp", "ref")


@frame("wn10_back_references", lambda d: "SELECT g.page AS grp, c.ref FROM (SELECT DISTINCT page FROM @v_candidates) g JOIN @v_candidates c ON c.structure_type = 'markush' AND c.page < g.page WHERE (SELECT count(*) FROM @v_candidates o WHERE o.structure_type = 'markush' AND o.page < g.page AND (o.page > c.page OR o.page = c.page AND o.k > c.k)) < 8")
def _wn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return back_references(load(spark, sf_dir, "v_candidates"))


def assembly_blockers(relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_id, reasons): why a relation can't be assembled, in order and each once (FL12).
    relations: record_id, compound_id, scaffold_ref, fragment_refs, variable_positions (arrays),
    assembly_status, pose_consistency, review_status (null without a review); candidates: ref,
    structure_type."""
    ready = (F.col("assembly_status") == "ready") & (F.col("pose_consistency") == "consistent")
    twice = relations.where(ready).select("compound_id", F.explode("variable_positions").alias("position")).groupBy("compound_id", "position").count().where("count > 1").select("compound_id", "position", F.lit(True).alias("ambiguous"))
    found = candidates.groupBy("ref").agg(F.max("structure_type").alias("kind"))
    parts = relations.select("record_id", F.explode("fragment_refs").alias("ref")).join(found, "ref", "left").groupBy("record_id").agg(F.max(F.col("kind").isNull()).alias("lost"), F.max(F.col("kind") == "markush").alias("generic"), F.max(F.col("kind") == "text_substituent").alias("textual"))
    scaffolds = found.select(F.col("ref").alias("scaffold_ref"), F.col("kind").alias("scaffold_kind"))
    df = relations.join(scaffolds, "scaffold_ref", "left").join(parts, "record_id", "left")
    one = F.when(F.size("variable_positions") == 1, F.element_at("variable_positions", 1))
    df = df.withColumn("position", one).join(twice, ["compound_id", "position"], "left")
    there = F.coalesce(F.col("scaffold_ref"), F.lit("")) != ""
    n, m = F.size("fragment_refs"), F.size("variable_positions")
    checks = [
        (~there, F.lit("missing_scaffold_ref")), (n == 0, F.lit("missing_fragment_ref")), (m == 0, F.lit("missing_variable_position")),
        ((m > 1) & (n != m), F.lit("multi_substituent_mapping_incomplete")), (n != m, F.lit("variable_fragment_count_mismatch")),
        (F.col("ambiguous"), F.lit("ambiguous_compound_variable_mapping")), (F.size(F.array_distinct("fragment_refs")) != n, F.lit("duplicate_fragment_ref_for_distinct_positions")),
        (F.col("assembly_status") != "ready", F.concat(F.lit("relationship_not_ready:"), "assembly_status")),
        (F.col("pose_consistency") != "consistent", F.concat(F.lit("pose_not_consistent:"), "pose_consistency")),
        (F.col("review_status") != "ready", F.lit("visual_review_not_ready")),
        (there & F.col("scaffold_kind").isNull(), F.lit("scaffold_candidate_not_found")), (F.col("lost"), F.lit("fragment_candidate_not_found")),
        (F.col("scaffold_kind") != "markush", F.lit("scaffold_candidate_not_markush")), (F.col("generic"), F.lit("fragment_ref_points_to_markush_scaffold")),
        (F.col("textual"), F.lit("text_substituent_requires_structure_evidence")),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), r) for c, r in checks]))
    # several fragments without a fault are an assembly that isn't made
    reasons = F.when((F.size(reasons) == 0) & (n > 1), F.array(F.lit("multi_substituent_rdkit_assembly_not_implemented"))).otherwise(reasons)
    return df.select("record_id", reasons.alias("reasons"))


@catalogue.view("v_assemblies")
def _assemblies(d):
    ref = "concat('p', CAST(p.p_size AS STRING), '/s', CAST(l_partkey AS STRING))"
    return f"""SELECT {ORD} AS record_id, concat('Example ', CAST(l_suppkey AS STRING)) AS compound_id, CASE WHEN l_quantity < 5 THEN '' ELSE {ref} END AS scaffold_ref, l_linenumber AS n,
concat('p', CAST(p.p_size AS STRING), '/s', CAST(l_partkey + (l_linenumber % 3) * 2000 AS STRING)) AS frag, concat('R', CAST(l_linenumber AS STRING)) AS pos,
CASE WHEN l_returnflag = 'R' THEN 'ready' ELSE 'partial' END AS assembly_status, CASE WHEN l_linestatus = 'O' THEN 'consistent' ELSE 'unknown' END AS pose_consistency, CASE WHEN l_tax < 0.02 THEN 'uncertain' WHEN l_tax < 0.05 THEN 'ready' END AS review_status FROM @lineitem JOIN @part p ON l_partkey = p.p_partkey"""


def _assembly_sql(d) -> str:
    rows = "SELECT *, CASE WHEN n = 1 THEN 0 WHEN n < 5 THEN 1 ELSE 2 END AS f, CASE WHEN n = 2 THEN 0 WHEN n = 7 THEN 2 ELSE 1 END AS v FROM @v_assemblies"
    twice = "SELECT compound_id, pos FROM (SELECT compound_id, pos FROM r WHERE assembly_status = 'ready' AND pose_consistency = 'consistent' AND v >= 1 UNION ALL SELECT compound_id, 'R9' FROM r WHERE assembly_status = 'ready' AND pose_consistency = 'consistent' AND v = 2) z GROUP BY compound_id, pos HAVING count(*) > 1"
    checks = [
        ("scaffold_ref = ''", "'missing_scaffold_ref'"), ("f = 0", "'missing_fragment_ref'"), ("v = 0", "'missing_variable_position'"), ("v = 2 AND f <> 2", "'multi_substituent_mapping_incomplete'"), ("f <> v", "'variable_fragment_count_mismatch'"),
        ("v = 1 AND t.pos IS NOT NULL", "'ambiguous_compound_variable_mapping'"), ("f = 2", "'duplicate_fragment_ref_for_distinct_positions'"), ("assembly_status <> 'ready'", "'relationship_not_ready:partial'"),
        ("pose_consistency <> 'consistent'", "'pose_not_consistent:unknown'"), ("review_status = 'uncertain'", "'visual_review_not_ready'"), ("scaffold_ref <> '' AND s.ref IS NULL", "'scaffold_candidate_not_found'"),
        ("f > 0 AND c.ref IS NULL", "'fragment_candidate_not_found'"), ("s.structure_type <> 'markush'", "'scaffold_candidate_not_markush'"), ("f > 0 AND c.structure_type = 'markush'", "'fragment_ref_points_to_markush_scaffold'"),
        ("f > 0 AND c.structure_type = 'text_substituent'", "'text_substituent_requires_structure_evidence'"),
    ]
    parts = ", ".join(f"CASE WHEN {c} THEN {r} END" for c, r in checks)
    return f"WITH r AS ({rows}), t AS ({twice}) SELECT record_id, CASE WHEN joined = '' AND f > 1 THEN 'multi_substituent_rdkit_assembly_not_implemented' ELSE joined END AS reasons FROM (SELECT r.record_id, f, concat_ws('; ', {parts}) AS joined FROM r LEFT JOIN t ON t.compound_id = r.compound_id AND t.pos = r.pos LEFT JOIN @v_candidates s ON s.ref = r.scaffold_ref LEFT JOIN @v_candidates c ON c.ref = r.frag) x"


@frame("fl12_assembly_blockers", _assembly_sql)
def _fl12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "v_assemblies")
    refs = F.expr("CASE WHEN n = 1 THEN array() WHEN n < 5 THEN array(frag) ELSE array(frag, frag) END").cast("array<string>")
    spots = F.expr("CASE WHEN n = 2 THEN array() WHEN n = 7 THEN array(pos, 'R9') ELSE array(pos) END").cast("array<string>")
    relations = rows.withColumn("fragment_refs", refs).withColumn("variable_positions", spots)
    return assembly_blockers(relations, load(spark, sf_dir, "v_candidates")).select("record_id", F.array_join("reasons", "; ").alias("reasons"))


def downgraded(relations: DataFrame, most: int = 8) -> DataFrame:
    """(record_id, status, reason) after the gates of the visual review, the first that fails deciding
    (FL13).  Per plan at most ``most`` relations are reviewed; those past that wait for context.
    relations: plan, ord, assembly_status, scaffold_kind, fragment_kind (null if not found),
    has_image, review_status (null where the call failed)."""
    ready = F.col("assembly_status") == "ready"
    gate = (
        F.when(F.col("scaffold_kind").isNull(), "no matching scaffold candidate").when(F.col("scaffold_kind") != "markush", "scaffold is not a markush structure")
        .when(F.col("fragment_kind").isNull(), "no matching fragment candidate").when(~F.col("has_image"), "red-box image not found")
    )
    asked = ready & gate.isNull()
    turn = F.count(F.when(asked, 1)).over(Window.partitionBy("plan").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = asked & (turn > most)
    review = F.coalesce("review_status", F.lit("uncertain"))
    status = F.when(~ready, F.col("assembly_status")).when(gate.isNotNull() | over, "needs_context").otherwise(review)
    reason = F.when(~ready, "").when(gate.isNotNull(), gate).when(over, "visual review limit reached").when(review == "ready", "visual review: ready").otherwise(F.concat(F.lit("visual review: "), review))
    return relations.select("plan", "ord", status.alias("status"), reason.alias("reason"))


@frame("fl13_downgrade", lambda d: "WITH r AS (SELECT a.record_id AS ord, a.record_id // 8000000000000 AS plan, a.assembly_status, a.n, a.review_status, CASE WHEN s.ref IS NULL THEN 'no matching scaffold candidate' WHEN s.structure_type <> 'markush' THEN 'scaffold is not a markush structure' WHEN c.ref IS NULL THEN 'no matching fragment candidate' WHEN a.n = 6 THEN 'red-box image not found' END AS gate FROM @v_assemblies a LEFT JOIN @v_candidates s ON s.ref = a.scaffold_ref LEFT JOIN @v_candidates c ON c.ref = a.frag), x AS (SELECT *, sum(CASE WHEN assembly_status = 'ready' AND gate IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY plan ORDER BY ord) AS turn FROM r) SELECT CAST(plan AS BIGINT) AS plan, ord, CASE WHEN assembly_status <> 'ready' THEN assembly_status WHEN gate IS NOT NULL OR turn > 2 THEN 'needs_context' ELSE coalesce(review_status, 'uncertain') END AS status, CASE WHEN assembly_status <> 'ready' THEN '' WHEN gate IS NOT NULL THEN gate WHEN turn > 2 THEN 'visual review limit reached' ELSE 'visual review: ' || coalesce(review_status, 'uncertain') END AS reason FROM x")
def _fl13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = load(spark, sf_dir, "v_candidates").select("ref", "structure_type")
    df = load(spark, sf_dir, "v_assemblies")
    df = df.join(kinds.select(F.col("ref").alias("scaffold_ref"), F.col("structure_type").alias("scaffold_kind")), "scaffold_ref", "left")
    df = df.join(kinds.select(F.col("ref").alias("frag"), F.col("structure_type").alias("fragment_kind")), "frag", "left")
    df = df.select(F.floor(F.col("record_id") / 8000000000000).cast("long").alias("plan"), F.col("record_id").alias("ord"), "assembly_status", "scaffold_kind", "fragment_kind", (F.col("n") != 6).alias("has_image"), "review_status")
    return downgraded(df, 2)


# -- passes, metrics, merges ---------------------------------------------------------------------


def overlaid(first: DataFrame, *passes: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, id, initial_id, confidence) after up to four passes over the ids of structures (ML10):
    the last pass with an id wins, the first answer is kept beside it."""
    df = first.select(key, F.col("id").alias("id_0"), F.col("confidence").alias("c_0"))
    for k, p in enumerate(passes, 1):
        df = df.join(p.select(key, F.col("id").alias(f"id_{k}"), F.col("confidence").alias(f"c_{k}")), key, "left")
    order = range(len(passes), -1, -1)
    conf = F.coalesce(*[F.when(F.col(f"id_{k}").isNotNull(), F.col(f"c_{k}")) for k in order], F.lit("medium"))
    return df.select(key, F.coalesce(*[F.col(f"id_{k}") for k in order]).alias("id"), F.col("id_0").alias("initial_id"), conf.alias("confidence"))


@frame("ml10_id_passes", lambda d: "SELECT event_id, CASE WHEN event_type = 'click' THEN concat('r', event_id) WHEN value > 50 THEN 'label' WHEN event_id % 7 < 3 THEN 'first' END AS id, CASE WHEN event_id % 7 < 3 THEN 'first' END AS initial_id, CASE WHEN event_type = 'click' THEN 'high' WHEN value > 50 THEN 'low' ELSE 'medium' END AS confidence FROM @events")
def _ml10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    first = e.select("event_id", F.when(F.col("event_id") % 7 < 3, F.lit("first")).alias("id"), F.lit("medium").alias("confidence"))
    label = e.where("value > 50").select("event_id", F.lit("label").alias("id"), F.lit("low").alias("confidence"))
    review = e.where("event_type = 'click'").select("event_id", F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.lit("high").alias("confidence"))
    return overlaid(first, label, review)


def match_metrics(pairs: DataFrame, *group: str) -> DataFrame:
    """Shares of valid and of equal predictions, without chirality and without cis and trans, and the
    share and accuracy of chiral ones, -1 if there are none (AG10).  Canonical forms are texts here.
    pairs: gold, pred and group columns."""
    flat = lambda c: F.regexp_replace(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("<empty>")), "@", "")
    straight = lambda c: F.regexp_replace(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("<empty>")), r"[/\\]", "")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    chiral = straight("gold").contains("@")
    return pairs.groupBy(*group).agg(
        F.count("*").alias("n"), share(F.coalesce(F.col("pred"), F.lit("")) != "").alias("valid"), share(F.coalesce(F.nullif(F.col("gold"), F.lit("")), F.lit("<empty>")) == F.coalesce(F.col("pred"), F.lit(""))).alias("exact"),
        share(flat("gold") == flat("pred")).alias("graph"), share(straight("gold") == straight("pred")).alias("no_cistrans"),
        share(chiral).alias("chiral_ratio"), F.coalesce(F.round(F.avg(F.when(chiral, (straight("gold") == straight("pred")).cast("double"))), 6), F.lit(-1.0)).alias("chiral"),
    )


#: (gold, predicted) and which of the measures (valid, exact, graph, no cis/trans) the pair meets.
PAIRS = [("C[C@H]O", "C[C@H]O", "1111"), ("C[C@H]O", "C[C@@H]O", "1010"), ("F/C=C/F", "F\\C=C/F", "1001"), ("CCO", "", "0000"), ("", "", "0011"), ("CC", "CN", "1000")]


def _metrics_sql(d) -> str:
    rows = ", ".join(f"({i}, {', '.join(m)}, {int('@' in g)})" for i, (g, _, m) in enumerate(PAIRS))
    return f"SELECT p_brand AS brand, count(*) AS n, round(avg(a), 6) AS valid, round(avg(b), 6) AS exact, round(avg(c), 6) AS graph, round(avg(e), 6) AS no_cistrans, round(avg(ch), 6) AS chiral_ratio, coalesce(round(avg(CASE WHEN ch = 1 THEN e END), 6), -1) AS chiral FROM @part JOIN (VALUES {rows}) v(i, a, b, c, e, ch) ON p_partkey % {len(PAIRS)} = v.i GROUP BY p_brand"


@frame("ag10_match_metrics", _metrics_sql)
def _ag10(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_partkey") % len(PAIRS)).cast("int") + 1
    part = load(spark, sf_dir, "part")
    pairs = part.select(F.col("p_brand").alias("brand"), F.element_at(F.array(*[F.lit(g) for g, _, _ in PAIRS]), at).alias("gold"), F.element_at(F.array(*[F.lit(p) for _, p, _ in PAIRS]), at).alias("pred"))
    return match_metrics(pairs, "brand")


@frame("ag15_fill_ratio", lambda d: "SELECT p_brand AS brand, round(count(*) FILTER (p_size > 10) / count(*), 6) AS success, count(*) FILTER (p_size <= 10) AS replaced, min(CASE WHEN p_size > 10 THEN concat('InChI=', p_size) ELSE p_name END) AS lowest FROM @part GROUP BY p_brand")
def _ag15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A converter's success, and its filler replaced from a second list (AG15)."""
    made = F.when(F.col("p_size") > 10, F.concat(F.lit("InChI="), F.col("p_size").cast("string")))  # a converter that fails on small ones
    filler = "InChI=1S/H2O/h1H2"
    part = load(spark, sf_dir, "part").withColumn("made", F.coalesce(made, F.lit(filler)))
    filled = F.col("made") == filler
    return part.groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.avg((~filled).cast("double")), 6).alias("success"), F.count(F.when(filled, 1)).alias("replaced"), F.min(F.when(filled, F.col("p_name")).otherwise(F.col("made"))).alias("lowest"))


def merged_records(base: DataFrame, extras: DataFrame, key: str, order: str) -> DataFrame:
    """Two lists of assay records as one (AG08): records of one compound are overlaid, later fields
    over earlier ones; a record without a compound stays alone."""
    both = base.withColumn("_list", F.lit(0)).unionByName(extras.withColumn("_list", F.lit(1)))
    alone = F.when(F.trim(F.coalesce(F.col(key), F.lit(""))) == "", F.concat_ws("_", "_list", order)).otherwise("")
    fields = [c for c in base.columns if c not in (key, order)]
    rank = F.struct("_list", order)
    return both.groupBy(F.trim(F.coalesce(F.col(key), F.lit(""))).alias(key), alone.alias("alone")).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fields])


@frame("ag08_list_merges", lambda d: "SELECT name AS compound, CASE WHEN name = '' THEN concat('0_', k) ELSE '' END AS alone, CASE WHEN name <> '' AND k % 2 = 0 THEN concat('new ', k) ELSE kind END AS a, CASE WHEN name <> '' AND k % 2 = 0 AND k % 4 = 0 THEN NULL ELSE brand END AS b FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Example ', p_partkey) END AS name, p_type AS kind, p_brand AS brand FROM @part) t UNION ALL SELECT '', concat('1_', p_partkey), concat('new ', p_partkey), CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END FROM @part WHERE p_partkey % 10 = 0".replace("CASE WHEN name <> '' AND k % 2 = 0 AND k % 4 = 0 THEN NULL ELSE brand END", "brand"))
def _ag08(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" Example "), F.col("p_partkey").cast("string")))
    base = part.select(F.col("p_partkey").alias("k"), name.alias("compound"), F.col("p_type").alias("a"), F.col("p_brand").alias("b"))
    extras = base.where("k % 2 = 0").withColumn("a", F.concat(F.lit("new "), F.col("k").cast("string"))).withColumn("b", F.when(F.col("k") % 4 != 0, F.col("b")))
    return merged_records(base, extras, "compound", "k")


def linked_task(metadata: Column, params: Column, key: str = "structure_task_id") -> Column:
    """The task that a task is linked to: by its metadata, else by its parameters (JN16)."""
    said = lambda c: F.nullif(F.trim(F.get_json_object(c, f"$.{key}")), F.lit(""))
    return F.coalesce(said(metadata), said(params), F.lit(""))


def verified_names(diagnostics: DataFrame, key: str) -> DataFrame:
    """(key, name, place): the verified assay names of a document, or the page names if there are none;
    names that differ in case or blanks are one (JN16).  diagnostics: key, ord, verified and paged
    (arrays of names)."""
    each = diagnostics.select(key, "ord", F.lit(0).alias("level"), F.posexplode("verified").alias("at", "name")).unionByName(
        diagnostics.select(key, "ord", F.lit(1).alias("level"), F.posexplode("paged").alias("at", "name")))
    each = each.withColumn("name", F.trim("name")).where("name <> ''")
    level = F.min("level").over(Window.partitionBy(key))
    same = F.lower(F.regexp_replace("name", r"\s+", " "))
    first = F.row_number().over(Window.partitionBy(key, same).orderBy("ord", "at"))
    kept = each.withColumn("best", level).where("level = best").withColumn("n", first).where("n = 1")
    return kept.select(key, "name", F.row_number().over(Window.partitionBy(key).orderBy("ord", "at")).alias("place"))


@frame("jn16_linked_task", lambda d: "SELECT task_id, CASE n % 4 WHEN 0 THEN concat('m', n) WHEN 1 THEN concat('p', n) WHEN 2 THEN '' ELSE concat('p', n) END AS linked FROM @v_tasks")
def _jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n").cast("string")
    at = (F.col("n") % 4).cast("int")
    meta = F.when(at == 0, F.concat(F.lit('{"structure_task_id": " m'), n, F.lit('"}'))).when(at == 1, F.lit('{"structure_task_id": "  "}'))
    params = F.when(at != 2, F.concat(F.lit('{"structure_task_id": "p'), n, F.lit('"}'))).otherwise(F.lit("{}"))
    return load(spark, sf_dir, "v_tasks").select("task_id", linked_task(meta, params).alias("linked"))


@frame("jn16_verified_names", lambda d: "SELECT CAST(k AS BIGINT) AS k, name, CAST(place AS INT) AS place FROM (SELECT p_partkey AS k, 'IC 50' AS name, 1 AS place FROM @part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, concat('Ki ', p_partkey), 2 FROM @part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'Kd', 1 FROM @part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'page', 2 FROM @part WHERE p_partkey % 3 = 1) t")
def _jn16_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    own = F.expr("CASE WHEN k % 3 = 0 THEN array('IC 50', concat('Ki ', k), ' ic  50', '') ELSE array('', ' ') END")
    paged = F.expr("CASE WHEN k % 3 = 2 THEN array() ELSE array('Kd', 'page', 'KD') END").cast("array<string>")
    return verified_names(part.select("k", F.lit(1).alias("ord"), own.alias("verified"), paged.alias("paged")), "k")
