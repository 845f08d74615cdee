"""The pipeline's stages, each judged on its own input."""

from collections import defaultdict

import corpus_pipeline
import pytest
from marlstone.llm import common, simhash, suffix_dedup, toxicity


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "suffix_array_dedup", "packing"]
    docs = common.read(spark, sf, "documents").selectExpr("*", "1 AS sequence_id")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(common.materialise(stage(spark, kept[-1], sf), name))
    tox, sim, suf, packed = kept[1:]
    assert tox.columns == sim.columns == suf.columns == docs.columns
    model = toxicity.train(docs, common.read(spark, sf, "labels"))
    want = {r["doc_id"] for r in docs.collect() if model.score(r["text"]) < 0.5}
    assert {r["doc_id"] for r in tox.collect()} == want
    groups = defaultdict(list)
    for r in simhash.near_duplicates(tox).collect():
        groups[r["component_id"]].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in sim.collect()) == sorted(min(g) for g in groups.values())
    cut = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.removals(sim).collect()}
    before = {r["doc_id"]: r["text"] for r in sim.collect()}
    for r in suf.collect():
        n, rest = cut[r["doc_id"]]
        assert r["text"] == (before[r["doc_id"]] if not n else rest.decode("utf-8", "ignore")) and (not n or r["n_chars"] == len(r["text"]))
    assert suf.count() == sim.count()
    pieces = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in pieces} == set(before) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def test_odd_rows(spark):
    """Repeated and null ids: each row keeps its own text and stays one row."""
    line = "this passage of well over fifty bytes stands in more than one of the documents "
    rows = [(1, line), (7, "a" + line), (7, line + "b"), (7, "nothing here is a repeat"), (7, "a" + line)]
    rows += [(None, line + f"tail {k}") for k in range(6)] + [(None, "alone"), (None, None), ((1 << 63) - 1, "c" + line)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_removed long").repartition(3)
    got = {r["n_removed"]: (r["doc_id"], r["text"]) for r in suffix_dedup.deduplicated(df).collect()}
    assert suffix_dedup.deduplicated(df).count() == len(rows) == len(got)
    want = {0: line, 1: "a", 2: "b", 3: rows[3][1], 4: "a", 11: "alone", 12: None, 13: "c"} | {5 + k: f"tail {k}" for k in range(6)}
    assert got == {k: (rows[k][0], t) for k, t in want.items()}


def test_odd_rows_simhash(spark):
    """A row goes by its own group; a group without ids keeps one row."""
    one, two, three = ("".join(f"{w}{k} " for k in range(40)) for w in ("red", "blue", "green"))
    rows = [(3, one), (7, one), (7, two), (None, one), (None, three), (None, three), (None, three.upper()), (None, "other words"), (9, three + "and quite a few more words that differ")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp long").repartition(3)
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"].lower()) for r in got.collect()) == sorted((str(i), t) for i, t in [(3, one), (7, two), (None, three), (None, "other words"), rows[8]])


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


KINDS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, sf, stage):
    assert stage(spark, spark.createDataFrame([], KINDS), sf).count() == 0


def test_stages_on_repeated_rows_nulls_and_clashing_names(spark, sf):
    shared = "a passage of well over fifty bytes that stands in several of these rows, as it is "
    rows = [(1, shared + "one"), (2, shared + "two"), (2, shared + "three"), (2, shared + "three"), (None, shared + "four"), (None, shared + "four"), (2**63 - 1, shared + "five"), (5, None), (6, ""), (7, "quite another text")]
    clash = ["n_removed", "_row_key", "_cut_key", "_kept_key", "_toxicity_score", "fp", "score", "key"]
    df = spark.createDataFrame([(i, t, "en", "s", 3, *range(len(clash))) for i, t in rows], KINDS + "".join(f", {c} int" for c in clash))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, df, sf)
    assert clean.columns == df.columns and clean.count() == len(rows)
    once = stages["simhash_dedup"](spark, df, sf)
    assert once.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in once.collect()) == sorted(map(str, [1, 2, 2, None, 5, 7, 2**63 - 1]))
    cut = stages["suffix_array_dedup"](spark, df, sf)
    assert cut.columns == df.columns and cut.dtypes == df.dtypes
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_removed"]) for r in cut.collect()), key=str)
    want = [(i is None, i or 0, t if i in (1, 5, 6, 7) else t[len(shared) :], 0) for i, t in rows]
    assert got == sorted(want, key=str)
    assert spark.catalog.listTables() == []
    packed = stages["packing"](spark, df, sf)
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in rows})
