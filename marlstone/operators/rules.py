"""Queries of the rules in ``marlstone.functions``: each lays its cases over a whole table, and its
SQL holds what must come out, written by hand and not made from the rule.

In a case, {k} stands for the row's key, so that rows differ.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as H
from ..functions import columns as C
from ..functions import payloads as P
from ..functions import raster as R
from ..plans.dialect import catalogue
from ..sources.shipping import ship

Value = str | int | float | bool | None


def _lit(x: Value) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def _sql_type(values: list[Value]) -> str:
    kinds = {type(v) for v in values if v is not None} or {str}
    return {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE"}.get(kinds.pop() if len(kinds) == 1 else str, "VARCHAR")


def laid_out(df: DataFrame, key: str, names: list[str], cases: list[tuple]) -> DataFrame:
    """(k, *names): the inputs of case ``key mod n`` for each row of a table."""
    i = F.pmod(F.col(key), F.lit(len(cases))).cast("int") + 1
    kinds = {"VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}
    cells = []
    for at, name in enumerate(names):
        kind = kinds[_sql_type([c[0][at] for c in cases])]
        cell = F.element_at(F.array(*[F.lit(c[0][at]).cast(kind) for c in cases]), i)
        cells.append((F.replace(cell, F.lit("{k}"), F.col(key).cast("string")) if kind == "string" else cell).alias(name))
    return df.select(F.col(key).cast("long").alias("k"), *cells)


def golden(name: str, names: list[str], outputs: list[str], cases: list[tuple], rule: Callable[..., list[Column]], table: str = "part", key: str = "p_partkey") -> None:
    """Register a rule: cases are (inputs, what comes out)."""

    def query(spark, sf_dir: str) -> DataFrame:
        df = laid_out(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key, names, cases)
        return df.select("k", *[c.alias(o) for c, o in zip(rule(*map(F.col, names)), outputs)])

    kinds = [_sql_type([c[1][j] for c in cases]) for j in range(len(outputs))]
    rows = ", ".join(f"({i}, {', '.join(f'CAST({_lit(v)} AS {t})' for v, t in zip(out, kinds))})" for i, (_, out) in enumerate(cases))
    cells = ", ".join(f"replace(g.\"{o}\", '{{k}}', CAST({key} AS VARCHAR)) AS \"{o}\"" if t == "VARCHAR" else f'g."{o}" AS "{o}"' for o, t in zip(outputs, kinds))
    sql = f"SELECT CAST({key} AS BIGINT) AS k, {cells} FROM {table} JOIN (VALUES {rows}) g(i, {', '.join(f'"{o}"' for o in outputs)}) ON {key} % {len(cases)} = g.i"
    catalogue.frame(name)(query)
    catalogue.sql[name] = sql  # as it stands: its texts may hold "@"


def joined(array: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


golden("tx36_atom_symbols", ["s"], ["atom"], [
    (("[nH]",), ("N",)), (("[OMe]",), ("O",)), (("R{k}",), ("R{k}",)), (("[2*]",), ("2*",)), (("[C@@H]",), ("C",)), (("13C",), ("C",)), (("[Cl-]",), ("Cl",)), (("Br",), ("Br",)),
    (("H",), ("H",)), (("*",), ("*",)), (("[Na+]",), ("Na",)), (("",), ("",)), ((None,), ("",)), (("[15nH+]",), ("N",)), (("SiH3",), ("Si",)), (("?x",), ("?x",)), (("se",), ("S",)),
], lambda s: [C.atom_symbol(s)])

golden("tx21_flatten", ["name", "raw"], ["value", "unit", "method", "confidence"], [
    (("IC50 (n=3) (nM)", "{k}"), ("{k}", "nM", "IC50 (n=3) (nM)", "")),
    (("IC50 (n=3)", "{k} nM"), ("{k}", "nM", "IC50 (n=3)", "")),
    (("Ki (12)", "ND"), ("ND", "", "Ki (12)", "")),
    (("Ki (%)", "< {k}.5 µM"), ("<{k}.5", "µM", "Ki (%)", "")),
    (("Kd", '{"value": "{k} nM", "confidence": "high"}'), ("{k}", "nM", "Kd", "high")),
    (("Kd (pM)", '{"VALUE": "{k} nM", "UNIT": "[mM]", "METHOD": " SPR "}'), ("{k}", "mM", "SPR", "")),
    (("Kd (pM)", '{"value": null, "unit": "", "method": ""}'), ("", "pM", "Kd (pM)", "")),
    (("", "++"), ("++", "", "", "")),
    ((None, None), ("", "", "", "")),
    (("EC50 [x]", "1.2 x 10^-3 M"), ("1.2x10^-3", "M", "EC50 [x]", "")),
], lambda n, v: [C.flattened(n, v)[f] for f in ("value", "unit", "method", "confidence")])

golden("tx29_markush_tokens", ["s", "cell"], ["tokens", "positions"], [
    (("r1 and R 1, Ar or het, X r2 {k}", "R9"), ("R1 AR Het X R2", "R9 R1")),
    (("no variables in {k}", ""), ("", "")),
    (("X1 Y2 z 3 Z", " Ar "), ("X1 Y2 Z3 Z", "Ar")),
    (("R1 R2 R3 R4 R5 R6 R7 R8 R9 R10 R11 R12 R13", None), ("R1 R2 R3 R4 R5 R6 R7 R8 R9 R10 R11 R12", "R1 R2 R3 R4 R5 R6 R7 R8 R9 R10 R11 R12 R13")),
    (("CC([3*])N[12*]", "R3"), ("", "R3 R12")),
    ((None, None), ("", "")),
], lambda s, cell: [F.array_join(C.markush_tokens(s), " "), F.array_join(C.variable_positions(cell, s), " ")])

golden("tx05_truncate", ["s"], ["short", "marked", "preview"], [
    (("abcdefghijklmnopqrstuvwxyz",), ("abcdefghij", "abcdefghij[truncated]", "abcdefghij...")),
    (("abcdefghij",), ("abcdefghij", "abcdefghij", "abcdefghij")),
    (("",), ("", "", "")), ((None,), ("", "", "")),
], lambda s: [C.truncated(s, 10, ""), C.truncated(s, 10, "[truncated]"), C.truncated(s, 10)])

golden("tx24_model_text", ["s"], ["payload"], [
    (('<think>a {"x": 1}</think> so {"id": {k}} end',), ('{"id": {k}}',)),
    (('```json\n{"id": {k}}\n``` and more',), ('{"id": {k}}',)),
    (('first ``` {"id": {k}} ``` last',), ('{"id": {k}}',)),
    (('“json {"id": {k}} ”',), ('{"id": {k}}',)),
    (('<|begin_of_box|>{"a": {"b": {k}}}<|end_of_box|>',), ('{"a": {"b": {k}}}',)),
    (("nothing {k}",), (None,)), (("} {",), (None,)), (("",), (None,)), ((None,), (None,)),
], lambda s: [C.model_json(s)])

golden("id12_allow_list", ["payload"], ["id", "error"], [
    (('{"COMPOUND_ID": "Example {k}", "CONFIDENCE": "high", "REASON": "seen"}',), (None, "id outside the allow-list")),
    (('{"COMPOUND_ID": " 12a ", "CONFIDENCE": "Medium", "REASON": "seen"}',), ("12a", None)),
    (('{"COMPOUND_ID": "12a", "CONFIDENCE": "low", "REASON": "seen"}',), (None, None)),
    (('{"COMPOUND_ID": "N/A", "CONFIDENCE": "high", "REASON": "seen"}',), (None, None)),
    (('{"COMPOUND_ID": "12a", "CONFIDENCE": "sure", "REASON": "seen"}',), (None, "bad confidence")),
    (('{"COMPOUND_ID": "12a", "CONFIDENCE": "high", "REASON": " "}',), (None, "empty reason")),
    (('{"CONFIDENCE": "high", "REASON": "seen"}',), (None, "null id")),
    (('{"COMPOUND_ID": "", "CONFIDENCE": "high", "REASON": "seen"}',), (None, "empty id")),
    (("not json",), (None, "bad confidence")), ((None,), (None, "bad confidence")),
], lambda p: [C.allowed_id(p, F.array(F.lit("12a"), F.lit(" 13 ")))[f] for f in ("id", "error")])

golden("id13_record_pages", ["a", "b", "c", "pages"], ["found"], [
    (("3", None, "", "pages 7, 5 and 7"), ("3,5,7",)), (("4.9", "x", "2", None), ("2,4",)), ((None, None, None, None), ("",)), (("", "", "", "[12, 1]"), ("1,12",)),
], lambda a, b, c, p: [joined(C.record_pages([a, b, c], p))])

golden("tx01_pages_cli", ["s"], ["pages", "error"], [
    (("1-3,5",), ("1,2,3,5", None)), (("5-3",), ("", None)), (("-3",), ("-3", None)), (("7, 7,2",), ("2,7", None)), (("0",), ("0", None)),
    (("1-2-3",), (None, "Invalid page range format: 1-2-3")), (("x",), (None, "Invalid page number: x")), (("1,,2",), (None, "Invalid page number: ")), (("2 - 4",), ("2,3,4", None)),
    (("4,a-b,y",), (None, "Invalid page range format: a-b")),
], lambda s: [joined(C.cli_pages(s)["pages"]), C.cli_pages(s)["error"]])

golden("so04_even_tiles", ["n"], ["origins"], [
    ((500,), ("0",)), ((760,), ("0",)), ((1000,), ("0,240",)), ((1702,), ("0,471,942",)), ((4000,), ("0,942,1884,2355,3240",)),
], lambda n: [joined(C.tile_origins(n, 760, 471, 5))])

golden("sp08_resize", ["h", "w"], ["scale", "new_h", "new_w", "top", "left"], [
    ((1000, 500), (1.024, 1024, 512, 0, 256)), ((300, 800), (1.28, 384, 1024, 320, 0)), ((1024, 1024), (1.0, 1024, 1024, 0, 0)), ((2048, 512), (0.5, 1024, 256, 0, 384)),
], lambda h, w: [C.fitted(h, w, 1024)[f] for f in ("scale", "new_h", "new_w", "top", "left")])

golden("tx30_title_levels", ["s"], ["levels"], [
    (("40 38 34 30 30 24",), ("1,1,2,2,2,3",)), (("12",), ("1",)), (("90 80 70 60 50 40 30 20",), ("1,2,3,4,5,6,6,6",)), (("20 15 14",), ("1,1,2",)),
], lambda s: [joined(C.title_levels(F.transform(F.split(s, " "), lambda x: x.cast("double")), 5))])

golden("fl05_strictness", ["kind", "complete", "touched", "crop", "review", "again", "level"], ["structure_type", "kept"], [
    (("complete_compound", True, False, None, None, None, "strict"), ("complete_compound", True)),
    (("complete_compound", True, True, "not_cropped", "complete_compound", True, "strict"), ("complete_compound", True)),
    (("complete_compound", True, True, "fragment", "complete_compound", True, "strict"), ("fragment", False)),
    (("complete_compound", True, True, "uncertain", "markush", False, "balanced"), ("markush", False)),
    (("complete_compound", True, True, None, None, None, "strict"), ("uncertain", False)),
    (("complete_compound", True, True, None, None, None, "balanced"), ("uncertain", False)),
    (("complete_compound", True, True, None, "complete_compound", True, "balanced"), ("complete_compound", True)),
    (("complete_compound", True, True, "fragment", None, None, " Permissive "), ("complete_compound", True)),
    (("markush", False, True, "fragment", "complete_compound", True, "strict"), ("markush", False)),
    (("complete_compound", True, True, "not_cropped", None, None, "other"), ("complete_compound", True)),
    (("complete_compound", True, True, "not_cropped", "fragment", False, "strict"), ("fragment", False)),
], lambda *c: [C.strictness_decision(*c)[f] for f in ("structure_type", "complete")])

golden("fl03_acceptance", ["kind", "complete", "status", "single", "whole", "confidence", "reason"], ["side", "why"], [
    (("complete_compound", True, "complete_single_structure", True, True, "high", ""), ("kept", "")),
    (("complete_compound", True, "complete_single_structure", True, True, "low", "r{k}"), ("filtered", "r{k}; box gate rejected candidate: complete_single_structure; seen")),
    (("complete_compound", True, "multiple_structures", False, True, "high", ""), ("filtered", "box gate rejected candidate: multiple_structures; seen")),
    (("markush", False, "complete_single_structure", True, True, " Medium", "generic"), ("filtered", "generic")),
    (("fragment", False, "cut", True, False, "high", "part"), ("filtered", "part; box gate rejected candidate: cut; seen")),
    (("reaction", False, "cut", True, False, "high", "an arrow"), ("filtered", "an arrow")),
    (("complete_compound", True, None, None, None, None, None), ("filtered", "box gate rejected candidate: ; seen")),
], lambda k, c, st, si, wh, co, re: [C.box_gate(k, c, st, si, wh, co, re, F.lit("seen"))[f] for f in ("side", "reason")])

golden("fl04_final_gate", ["id", "role", "reason"], ["side", "why"], [
    (("Example {k}", "final_product", "ok"), ("kept", "ok")), (("Example {k}", " Intermediate ", "ok"), ("filtered", "ok; role Intermediate")), (("Intermediate {k}", "", None), ("filtered", "unusable id")),
    (("n/a", None, ""), ("filtered", "unusable id")), (("error: no id", None, ""), ("filtered", "unusable id")), ((None, None, None), ("filtered", "unusable id")),
    (("(12a)", "reagent_or_condition", None), ("filtered", "role reagent_or_condition")), (("12a", "product", None), ("kept", "")),
], lambda i, r, s: [C.final_gate(i, r, s)[f] for f in ("side", "reason")])

golden("tx37_artifact_paths", ["path"], ["full", "inside"], [
    (("a/{k}.pdf",), ("/root/out/a/{k}.pdf", True)), (("../{k}.pdf",), ("/root/{k}.pdf", False)), (("/root/out/./a/../b.csv",), ("/root/out/b.csv", True)),
    (("/root/output/{k}",), ("/root/output/{k}", False)), (("",), ("/root/out", True)), (("../../../../etc/x",), ("/etc/x", False)),
], lambda p: [C.inside_root(p, "/root/out")[f] for f in ("path", "inside")])

golden("ml15_request_schema", ["asked", "pages", "names", "level"], ["auto", "cleaned", "strictness", "error"], [
    ((False, "1-3", " a |b|", "Strict "), (False, "a|b", "strict", None)), ((True, "1-3", "", "balanced"), (True, "", "balanced", None)), ((None, "", " | ", None), (True, "", "strict", None)),
    ((False, None, "c", "loose"), (True, "c", None, "unsupported strictness")),
], lambda a, p, n, s: [
    C.auto_detect(a, p, F.lit(None).cast("array<int>")), F.array_join(C.cleaned_names(F.split(n, r"\|")), "|"),
    F.when(F.lower(F.trim(F.coalesce(s, F.lit("strict")))).isin("strict", "balanced", "permissive"), F.lower(F.trim(F.coalesce(s, F.lit("strict"))))),
    F.when(~F.lower(F.trim(F.coalesce(s, F.lit("strict")))).isin("strict", "balanced", "permissive"), "unsupported strictness"),
])


# -- rules in plain Python over Arrow batches --------------------------------------------------


def rows_by(df: DataFrame, rule: Callable[..., tuple], schema: str) -> DataFrame:
    """(k, *what the rule gives) for each row: its first column is the key, the others are the
    rule's arguments, nulls as None."""
    ship(df.sparkSession)
    outputs = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            args = [[None if pd.isna(v) else v for v in pdf[c]] for c in pdf.columns[1:]]
            out = [rule(*a) for a in zip(*args)] if args else []
            frame = pd.DataFrame(out, columns=outputs, dtype=object)
            frame.insert(0, "k", pdf[pdf.columns[0]].to_numpy())
            yield frame

    return df.mapInPandas(run, f"k long, {schema}")


def golden_rows(name: str, names: list[str], schema: str, cases: list[tuple], rule: Callable[..., tuple], table: str = "part", key: str = "p_partkey") -> None:
    """As golden(), for a rule in plain Python that gives a tuple."""
    outputs = [c.split()[0] for c in schema.split(", ")]
    golden(name, names, outputs, cases, lambda *c: [], table, key)
    catalogue.frames[name] = lambda spark, sf_dir: rows_by(laid_out(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key, names, cases), rule, schema)


golden_rows("id10_model_ids", ["s"], "id string, role string, source string, confidence string", [
    (('{"COMPOUND_ID": "Example {k}", "VISUAL_ROLE": "product", "ID_SOURCE": "title", "CONFIDENCE": "high"}',), ("Example {k}", "product", "title", "high")),
    (('```json\n{"id": "12a"}\n```',), ("12a", "", "", "medium")),
    (('{"answer": "{\\"ID\\": \\" 7  b \\"}"}',), ("7 b", "", "", "medium")),
    (('{"VALUE": "None", "confidence": "low"}',), (None, "", "", "low")),
    (('{"value": "error: no box"}',), (None, "", "", "medium")),
    (("Example {k}",), (None, "", "", "")), (("",), (None, "", "", "")), ((None,), (None, "", "", "")),
], lambda s: tuple(P.structure_id(s)[f] for f in ("compound_id", "visual_role", "id_source", "confidence")))

golden_rows("id01_literal_unwrap", ["s"], "held string", [
    (("{'COMPOUND_ID': 'Example {k}'}",), ("Example {k}",)), (("['{k}']",), ("{k}",)), (("'{k}b'",), ("{k}b",)), (('{"other": "x{k}"}',), ("x{k}",)),
    (('```\n{"id": null, "answer": "9"}\n```',), ("9",)), (("[null, 1, 2]",), ("1",)), (("{}",), ("{}",)), (('{"id": "None", "x": ["b{k}"]}',), ("b{k}",)), (("{broken",), ("{broken",)), ((" plain {k} ",), ("plain {k}",)), ((None,), ("",)),
], lambda s: (P.unwrapped(s),))

golden_rows("tx28_molblock", ["s"], "molblock string", [
    (("a\nb\nc\n  1  0  0  0  0  0            999 V2000\n nan 1.0\nM  END\nx{k}",), ("a\nb\nc\n  1  0  0  0  0  0            999 V2000\n 0.0000 1.0\nM  END",)),
    (('"x\\n  1  0  0  0  0  0  V2000\\nM  END"',), ("\n\nx\n  1  0  0  0  0  0  V2000\nM  END",)),
    (("t{k}\n  2  1  0  0  0  0\nM  END",), ("\n\nt{k}\n  2  1  0  0  0  0 V2000\nM  END",)),
    (("M  V30 BEGIN CTAB\nM  V30 END CTAB",), ("\n\n\n  0  0  0  0  0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 END CTAB\nM  END",)),
    (("é{k}\n$$$$\nrest",), ("{k}",)), (("",), ("",)), ((None,), ("",)),
], lambda s: (P.repaired_molblock(s),))

golden_rows("tx32_deep_merge", ["a", "b"], "merged string", [
    (('{"x": {"a": 1, "b": [1]}, "y": {k}}', '{"x": {"b": [2], "c": {}}}'), ('{"x": {"a": 1, "b": [2], "c": {}}, "y": {k}}',)),
    (('{"x": {"a": 1}}', '{"x": 5}'), ('{"x": 5}',)), (('{"x": 5}', '{"x": {"a": {"b": null}}}'), ('{"x": {"a": {"b": null}}}',)), ((None, '{"z": true}'), ('{"z": true}',)), (("{}", None), ("{}",)),
], lambda a, b: (P.merged_json(a, b),))

golden_rows("tx33_smiles_text", ["s", "f"], "marks string, turned string, atoms string, counts string", [
    (("C[C@H](N)[C@@H]1O", "C2H4O"), ("@ @@", "C[C@@H](N)[C@@H]1O", "C H H C H H O", "C2 H4 O1")),
    (("[C@@](F)(Cl)Br", "CH3"), ("@@", "[C@](F)(Cl)Br", "C H H H", "C1 H3")),
    (("CCO", "N(CH3)2"), ("", "CCO", "N [C H H H] [C H H H]", "C2 H6 N1")),
    (("", ""), ("", "", "", "")), (("c1ccccc1", "C3F7"), ("", "c1ccccc1", "C F F C F F C F F F", "C3 F7")),
], lambda s, f: _smiles_text(s or "", f or ""))

golden_rows("so07_largest_fragment", ["s"], "main string", [
    (("CCO.Cl",), ("CCO",)), (("Cl.[Na+].CC(=O)O",), ("CC(=O)O",)), (("CC.OO",), ("CC",)), (("BrC.CC",), ("BrC",)), (("",), ("",)), (("[13CH4].c1ccccc1.O",), ("c1ccccc1",)),
], lambda s: (H.main_fragment(s or ""),))

golden_rows("sp11_molecule_graph", ["s"], "n_atoms long, bonds string, hydrogens string", [
    (("CCO",), (3, "0-1:1 1-2:1", "3 2 1")), (("C=O",), (2, "0-1:2", "2 0")), (("CC(N)C#N",), (5, "0-1:1 1-2:1 1-3:1 3-4:3", "3 1 2 0 0")),
    (("C1CC1",), (3, "0-1:1 1-2:1 0-2:1", "2 2 2")), (("[Na+].Cl",), (2, "", "0 1")), (("",), (0, "", "")),
    (("c1ccccc1",), (6, "0-1:4 1-2:4 2-3:4 3-4:4 4-5:4 0-5:4", "1 1 1 1 1 1")),
], lambda s: _graph_text(s or ""))

golden_rows("sp11_substituent_join", ["a", "b"], "joined string", [
    (("CC([1*])N", "[1*]O"), ("CC(O)N",)), (("c1ccc(*)cc1", "*CC"), ("c1ccc(CC)cc1",)), (("*C", "[3*]Cl"), ("ClC",)),
], lambda a, b: (H.joined(a, b),))

golden_rows("ml04_payload_rules", ["s", "c"], "structure_type string, complete boolean, confidence string, error string, crop_error string", [
    (('{"structure_type": " Complete_Compound", "is_complete_compound": true, "confidence": "HIGH"}', '{"crop_status": "not_cropped", "is_cropped": false}'), ("complete_compound", True, "high", "", "")),
    (('{"structure_type": "markush", "is_complete_compound": true}', '{"crop_status": "fragment", "is_cropped": false}'), ("markush", True, "", "complete_compound and is_complete_compound disagree", "fragment disagrees with is_cropped")),
    (('{"structure_type": "complete_compound", "is_complete_compound": false}', '{"crop_status": "not_cropped", "is_cropped": true}'), ("complete_compound", False, "", "complete_compound and is_complete_compound disagree", "not_cropped disagrees with is_cropped")),
    (('{"structure_type": "fragment", "is_complete_compound": "no"}', '{"crop_status": "uncertain", "is_cropped": true}'), ("fragment", None, "", "is_complete_compound must be boolean", "")),
    (("[]", None), (None, None, None, "not an object", "not an object")),
    (('{"structure_type": "fragment", "is_complete_compound": false, "confidence": null}', '{"crop_status": "fragment", "is_cropped": true}'), ("fragment", False, "", "", "")),
], lambda s, c: (lambda x: (x.get("structure_type"), x.get("complete"), x.get("confidence"), x["error"], P.crop_check(c)["error"]))(P.classification(s)))

#: A page decision's contract: (kind, key, allowed values, value of "keep" under which it holds).
PAGE_CONTRACT = [
    ("required", "keep", None, None), ("boolean", "keep", None, None), ("required", "confidence", None, None), ("allowed", "confidence", ("low", "medium", "high"), None),
    ("nullable_integer", "source_page", None, None), ("required", "pages", None, True), ("integer_list", "pages", None, True), ("non_empty_list", "pages", None, True),
    ("required", "reason", None, False), ("non_empty_string", "reason", None, False),
]
golden_rows("ml03_decision_contract", ["s"], "faults string", [
    (('{"keep": true, "confidence": "High", "pages": [1, {k}]}',), ("",)),
    (('{"keep": "true", "confidence": "sure"}',), ("keep must be boolean; confidence is not allowed",)),
    (('{"keep": true, "confidence": "low", "pages": [], "source_page": null}',), ("pages must be non empty list",)),
    (('{"keep": true, "confidence": "low", "pages": ["1"], "source_page": "4"}',), ("source_page must be integer; pages must be integer list",)),
    (('{"keep": false, "confidence": "low", "reason": " "}',), ("reason must be non empty string",)),
    (('{"keep": false}',), ("missing confidence; missing reason",)), (("{}",), ("missing keep; missing confidence",)), (("[1]",), ("not an object",)), ((None,), ("not an object",)),
], lambda s: ("; ".join(P.violations(s, PAGE_CONTRACT)),))

golden_rows("ml05_assay_payload", ["s"], "plain string, rich string", [
    (('{"IC50": {" 1 ": {"value": "{k}", "unit": "nM", "METHOD": "SPR"}, "": "3", "2": " 4 ", "5": null}, "other": {"1": "9"}}',), ("IC50|1|{k}|nM|SPR IC50|2|4||", "")),
    (('{"Ki": {"1": {"VALUE": 7, "confidence": "high", "assay_match": {"compatible": true, "reason": "same", "best_requested_assay": "Ki"}}}}',), ("Ki|1|7||Ki", "Ki|1|7||Ki")),
    (('{"Ki": {"1": {"value": 7, "confidence": "high", "assay_match": {"compatible": true, "reason": "same", "best_requested_assay": "IC50"}}}}',), ("Ki|1|7||Ki", "")),
    (('{"Ki": [1]}',), ("", "")), (("no json",), ("", "")), ((None,), ("", "")),
], lambda s: tuple(" ".join("|".join(r) for r in P.assay_values(s, ("IC50", "Ki"), rich)) for rich in (False, True)))

golden_rows("tx22_context_lines", ["s", "key", "value"], "context string", [
    (("l1\nl2 has compound {k}\nl3\nl4\nl5", "compound {k}", ""), ("l1|l2 has compound {k}|l3",)),
    (("| 12 | 5 nM |\nx\ny\nz 12", "12", None), ("| 12 | 5 nM ||x|y|z 12",)),
    (("a 123\nb\nc", "12", "99"), ("a 123|b|c",)),
    (("1\n2\n3\n4\n5\n6\n7\n8\n9\n10", "nothing", "none"), ("1|2|3|4|5|6|7|8",)),
    (("p\n\nq 5 NM\nr\ns", "", "5 nM"), ("p|q 5 NM|r",)), ((None, "a", "b"), ("",)),
], lambda s, key, value: ("|".join(P.context_lines(s, key, value)),))

golden_rows("so08_beam_decode", ["odds", "width"], "tokens string, score double", [
    (("-0.1 -2.4 -9|-2 -0.2 -9|-9 -9 -0.1", 1), ("0 1 2", -0.4)), (("-0.7 -0.69 -9|-0.1 -3 -9", 1), ("1 0", -0.79)),
    (("-0.7 -0.69 -9|-0.1 -3 -9", 2), ("1 0", -0.79)), (("-9 -9 -0.1|-0.1 -9 -9", 2), ("2", -0.1)), (("-1 -1 -9", 1), ("0", -1.0)),
], lambda odds, width: (lambda best: (" ".join(map(str, best[0])), round(best[1], 6)))(P.beams([[float(x) for x in s.split()] for s in odds.split("|")], width, 2)[0]))

golden_rows("tx45_json_safe", ["n", "s"], "payload string", [
    ((1, "a"), ('{"at": "1998-01-02T00:00:00", "id": 1, "set": ["1", "a"], "x": null}',)), ((2, None), ('{"at": "1998-01-02T00:00:00", "id": 2, "set": ["2", null], "x": null}',)),
], lambda n, s: (json.dumps(P.json_safe({"id": n, "at": datetime.datetime(1998, 1, 2), "set": {str(n), s}, "x": float("nan")}), sort_keys=True),))


def _nested(item) -> str:
    return "[" + " ".join(map(_nested, item)) + "]" if isinstance(item, list) else item


def _smiles_text(s: str, f: str) -> tuple:
    marks, parts = H.stereo_marks(s), H.formula(f)
    counts = H.counted(parts)
    return " ".join(marks), H.flipped(s, [0]) if marks else s, " ".join(map(_nested, H.expanded(parts))), " ".join(f"{e}{counts[e]}" for e in sorted(counts))


def _graph_text(s: str) -> tuple:
    atoms, bonds = H.graph(s)
    return len(atoms), " ".join(f"{min(a, b)}-{max(a, b)}:{o}" for a, b, o in bonds), " ".join(map(str, H.hydrogens(atoms, bonds)))


# -- rasters and layouts -----------------------------------------------------------------------


def _mask(text: str) -> np.ndarray:
    return np.array([[c == "#" for c in row] for row in (text or "").split("/")], bool)


golden_rows("sp04_components", ["s", "least"], "n long, sizes string, boxes string", [
    (("##.../##..#/....#", 1), (2, "4 2", "0,0,2,2 1,4,3,5")), (("#.#/.#./#.#", 1), (5, "1 1 1 1 1", "0,0,1,1 0,2,1,3 1,1,2,2 2,0,3,1 2,2,3,3")),
    (("###/#.#/###", 1), (1, "8", "0,0,3,3")), (("##../...#/....", 5), (1, "2", "0,0,1,2")), (("....", 1), (0, "", "")), (("#.##/####/#..#", 1), (1, "9", "0,0,3,4")),
], lambda s, least: (lambda c: (len(c), " ".join(str(int(m.sum())) for m in c), " ".join(",".join(map(str, R.box_of(m))) for m in c)))(R.components(_mask(s), least)))

golden_rows("sp05_mask_algebra", ["a", "b"], "iou double, coverage double, area long", [
    (("##../##..", ".##./.##."), (round(2 / 6, 6), 0.5, 4)), (("#.../....", "...#/...."), (0.0, 0.0, 1)), (("####/####", "####/...."), (0.5, 0.5, 8)), (("..../....", "####/####"), (0.0, 0.0, 0)),
], lambda a, b: (round(R.iou(_mask(a), _mask(b)), 6), round(R.coverage(_mask(a), _mask(b)), 6), int(_mask(a).sum())))

golden_rows("sp07_lines_and_growth", ["s", "seed"], "kept string, grown string, ratio double", [
    (("########/.#....../.#...#..", "......../......../.....#.."), ("......../.#....../.#...#..", "......../......../.....#..", round(8 / 11, 6))),
    (("##....../##....##/......##", "#......./......../........"), ("##....../##....##/......##", "##....../##....../........", 0.0)),
    (("......../......../........", "#......./......../........"), ("......../......../........", "......../......../........", 0.0)),
], lambda s, seed: (_drawn(R.without_rules(_mask(s), least=5)), _drawn(R.grown(_mask(s), _mask(seed))), round(R.ruling_ratio(_mask(s), share=0.9, least=5), 6)))

golden_rows("tx38_border_contact", ["s"], "left_share double, top_share double, sides string", [
    (("#.......#/........./.........",), (round(1 / 9, 6), round(2 / 27, 6), "left,right,top,bottom")), (("........./....#..../.........",), (0.0, round(1 / 27, 6), "top,bottom")), (("....",), (0.0, 0.0, "")),
    (("##########/##########",), (1.0, 1.0, "left,right,top,bottom")),
], lambda s: (lambda r: (round(r["left"], 6), round(r["top"], 6), ",".join(k for k, v in r.items() if v >= 0.035)))(R.border_contact(np.where(_mask(s), 0, 255))))

golden_rows("fl02_final_candidates", ["h", "w", "what"], "fault string", [
    ((40, 40, "block"), ("",)), ((10, 40, "block"), ("small",)), ((30, 40, "block"), ("small",)), ((200, 200, "block"), ("page",)), ((40, 40, "rules"), ("ruling lines",)), ((40, 40, "blank"), ("little ink",)), ((40, 160, "dots"), ("",)),
    ((20, 160, "dots"), ("long and thin",)),
], lambda h, w, what: (_candidate(h, w, what),))

golden_rows("sp03_aggregate_suppression", ["s"], "gathers string", [
    (("0,0,100,100 5,5,45,95 55,5,95,95",), ("1 0 0",)), (("0,0,100,100 5,5,45,95",), ("0 0",)), (("0,0,100,100 0,0,20,20 30,30,50,50",), ("0 0 0",)), (("0,0,100,100 0,0,30,30 70,70,100,100",), ("1 0 0",)),
    (("0,0,100,100 0,0,19,19 81,81,100,100",), ("0 0 0",)), (("0,0,100,100 -3,0,50,50 50,0,103,50",), ("1 0 0",)), (("0,0,100,100 0,0,90,90 5,5,95,95",), ("0 0 0",)),
], lambda s: (" ".join(str(int(x)) for x in R.aggregates([tuple(map(int, b.split(","))) for b in s.split()])),))

golden_rows("sp10_rigid_pose", ["s", "f"], "degrees long, score double", [
    (("0,0 1,0", "2,0 3,0"), (0, 0.0)), (("0,0 1,0", "2,0 1,0"), (45, 0.011781)), (("0,0 0,1 0,2", "0,3 0,4"), (0, 0.0)),
], lambda s, f: _pose(s, f))

golden_rows("wn08_spanning_tables", ["s"], "tables string", [
    (("0,100:id|ic50;1|2 5,95:id|ic50;3|4",), ("0,100:id|ic50;1|2;3|4",)), (("0,100:id|ic50;1|2 5,95:7|8;3|4",), ("0,100:id|ic50;1|2;7|8;3|4",)),
    (("0,100:id|ic50;1|2 50,95:id|ic50;3|4",), ("0,100:id|ic50;1|2 50,95:id|ic50;3|4",)), (("0,100:a|b|c;1|2|3 0,100:a|b;1|2",), ("0,100:a|b|c;1|2|3 0,100:a|b;1|2",)),
    (("0,100:id|x;1|2 0,0: 0,100:id|x;3|4",), ("0,100:id|x;1|2 0,0: 0,100:id|x;3|4",)),
], lambda s: (_spanned(s),))


def _drawn(mask: np.ndarray) -> str:
    return "/".join("".join("#" if x else "." for x in row) for row in mask)


def _candidate(h: int, w: int, what: str) -> str:
    grey = np.full((200, 200), 255)
    box = (0, 0, h, w)
    if what == "block":
        for k in range(0, h, 3):  # a drawing of short strokes
            grey[k, k % 7 : w : 4] = 0
    elif what == "rules":
        grey[5:h:10, :w] = 0
    elif what == "dots":
        grey[2:h:5, 1:w:5] = 0
    mask = np.zeros((200, 200), bool)
    mask[:h, :w] = True
    return R.final_candidate(mask, grey, box)


def _points(text: str) -> np.ndarray:
    return np.array([[float(x) for x in p.split(",")] for p in text.split()])


def _pose(s: str, f: str) -> tuple:
    scaffold, fragment = _points(s), _points(f)
    degrees, score = R.best_turn(scaffold, fragment, len(scaffold) - 1, 0, 1.0)
    return degrees, round(score, 6)


def _spanned(s: str) -> str:
    tables = []
    for t in s.split(" "):
        edges, _, rows = t.partition(":")
        x0, x1 = map(int, edges.split(","))
        tables.append({"x0": x0, "x1": x1, "rows": [r.split("|") for r in rows.split(";")] if rows else []})
    return " ".join(f"{t['x0']},{t['x1']}:" + ";".join("|".join(r) for r in t["rows"]) for t in P.spanning_tables(tables))

golden("tx35_grid_codec", ["x", "y"], ["x_id", "y_id", "bx", "by", "apart_y"], [
    ((0.0, 1.0), (4, 67, 0.0, 1.0, 131)), ((0.5, 0.25), (36, 20, round(32 / 63, 6), round(16 / 63, 6), 84)), ((1 / 63, 0.0), (5, 4, round(1 / 63, 6), 0.0, 68)), ((1.0, 0.5), (67, 36, 1.0, round(32 / 63, 6), 100)),
], lambda x, y: [*[C.grid_ids(x, y, 64, 64, 4)[f] for f in ("x_id", "y_id", "x", "y")], C.grid_ids(x, y, 64, 64, 4, apart=True)["y_id"]])

golden("sm08_progress_map", ["phase", "part"], ["progress"], [
    (("structure", 0.5), (0.45,)), (("structure", 1.0), (0.85,)), (("assay", 0.2), (0.25,)), (("assay", 1.0), (0.85,)), (("detect_pages", 1.0), (0.68,)), (("detect_names", 2.0), (0.78,)), (("merge", 0.5), (0.5,)), (("other", 0.5), (None,)), (("merge", -1.0), (0.2,)),
], lambda p, f: [F.round(C.progress(p, f), 6)])

golden_rows("tx18_envelope", ["chunk", "doc", "cont", "most"], "content string", [
    (("c{k}", "", " ", 900), ("c{k}",)), (("c", "d" * 130, "", 391), ('<DOCUMENT>\n' + "d" * 130 + '\n</DOCUMENT>\n\n<CHUNK page="7">\nc\n</CHUNK>',)),
    (("c", "d" * 130, "", 381), ('<CHUNK page="7">\nc\n</CHUNK>',)), (("c", "d" * 300, "e" * 100 + "f" * 200, 261 + 400), ('<DOCUMENT>\n' + "d" * 200 + '\n</DOCUMENT>\n\n<CONTINUATION>\n' + "f" * 200 + '\n</CONTINUATION>\n\n<CHUNK page="7">\nc\n</CHUNK>',)),
], lambda chunk, doc, cont, most: (P.envelope(chunk or "", doc or "", cont or "", 7, most),))

golden_rows("tx09_header_rows", ["s"], "header string, valid boolean", [
    (("| Example | IC50 |\n|---|---|\n| {k} | 5 nM |",), ("pipe rows:\nExample | IC50", True)), (("| a | b |\n| c | d |\n| 1 | 5 nM |\n| 2 | 7 nM |",), ("", True)), (("| a | b |\n| c | d |\n| e | f |",), ("", False)),
    (("| liquid | x |\n| 1 | 2 |\n| 3 | 4 |",), ("pipe rows:\nliquid | x", True)), (("| a | b |",), ("", False)), (("text\nmore",), ("", False)), (("| No. | x |\n| I D | y |\n| E C 50 | z |\n| K i | w |",), ("pipe rows:\nNo. | x\nE C 50 | z\nK i | w", True)),
], lambda s: (P.header_context((s or "").splitlines(), []), P.valid_block((s or "").splitlines())))

golden_rows("tx46_prompts", ["n", "s"], "filled string", [
    ((1, "page {k}"), ('Read page {k} for ["IC50", "Ki"] among ["c0"].',)), ((3, "{{IDS}}"), ('Read {{IDS}} for ["IC50", "Ki"] among ["c0", "c1", "c2"].',)), ((129, "x"), ('Read x for ["IC50", "Ki"] among .',)), ((0, ""), ('Read  for ["IC50", "Ki"] among [].',)),
], lambda n, s: (P.prompt("Read {{CONTENT}} for {{ASSAYS}} among {{IDS}}.", s or "", ["IC50", "Ki"], [f"c{k}" for k in range(n)]),))

golden_rows("ml06_planner_rules", ["s"], "sources string", [
    (('[{"page": 3, "use_context": true, "source_page": 1}, {"page": 2, "use_context": true, "source_page": 4}]',), ("1:- 2:- 3:1 5:-",)),
    (('[{"page": 5, "use_context": true, "source_page": 4}, {"page": 3, "use_context": false, "source_page": 2}]',), ("1:- 2:- 3:- 5:-",)),
    (('[{"page": 5, "use_context": true, "source_page": 3}, {"page": 5, "use_context": true, "source_page": 1}, {"page": 9, "use_context": true, "source_page": 1}]',), ("1:- 2:- 3:- 5:3",)),
    (("[]",), ("1:- 2:- 3:- 5:-",)),
], lambda s: (" ".join(f"{p}:{'-' if q is None else q}" for p, q in P.planned(json.loads(s), [1, 2, 3, 5]).items()),))


def document_keys(docs: DataFrame) -> DataFrame:
    """Keys of a document's text cache and of its detection plan, which depends on the sorted assay
    names, too (TX25).  docs: doc_id, path, size, mtime_ns, names (array)."""
    base = {"path": C.quoted(F.col("path")), "size": F.col("size").cast("string"), "mtime_ns": F.col("mtime_ns").cast("string")}
    names = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(C.cleaned_names(F.col("names"))), lambda x: C.quoted(x)), ", "), F.lit("]"))
    return docs.select("doc_id", C.hash_key(**base).alias("text_key"), C.hash_key(**base, assay_names=names, cache_version=F.lit("1")).alias("plan_key"))


@catalogue.frame("tx25_hash_keys", lambda d: """SELECT doc_id, sha256(concat('{"mtime_ns": ', doc_id * 7, ', "path": "/in/', doc_id, '.pdf", "size": ', n_chars, '}')) AS text_key, sha256(concat('{"assay_names": ["', least(lang, 'xx'), '", "', greatest(lang, 'xx'), '"], "cache_version": 1, "mtime_ns": ', doc_id * 7, ', "path": "/in/', doc_id, '.pdf", "size": ', n_chars, '}')) AS plan_key FROM @documents""")
def _tx25(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return document_keys(d.select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 7).alias("mtime_ns"), F.array(F.lit("xx "), F.lit(""), F.col("lang")).alias("names")))


def kept_fields(records: DataFrame, internal: tuple[str, ...] = ("CANDIDATE_SOURCE",), block: str = "MOLBLOCK", box: str | None = None) -> DataFrame:
    """Records without internal columns (TX44); a molblock loses the line ends at its end and nothing
    else, a box is read from the JSON that holds it."""
    out = records.drop(*internal).withColumn(block, F.regexp_replace(block, r"[\r\n]+$", ""))
    return out if box is None else out.withColumn("box", F.from_json(F.get_json_object(box, "$.box"), "array<long>"))


@catalogue.frame("tx44_preserve", lambda d: "SELECT p_partkey AS k, concat(p_name, ' ') AS \"MOLBLOCK\", concat(p_size, ',', p_partkey) AS box FROM @part")
def _tx44(spark, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = p.select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" \r\n\n")).alias("MOLBLOCK"), F.lit("detector").alias("CANDIDATE_SOURCE"), F.concat(F.lit('{"page_width": 9, "box": ['), F.col("p_size").cast("string"), F.lit(", "), F.col("p_partkey").cast("string"), F.lit("]}")).alias("j"))
    return kept_fields(made, box="j").select("k", "MOLBLOCK", joined(F.col("box")).alias("box"))


@catalogue.frame("tx44_documents", lambda d: "SELECT doc_id, rtrim(text, chr(13) || chr(10)) AS text FROM @documents")
def _tx44_documents(spark, sf_dir: str) -> DataFrame:
    return kept_fields(spark.read.parquet(f"{sf_dir}/documents.parquet"), block="text").select("doc_id", "text")


def scanned(pages: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, scanned): documents without a text layer, or with fewer than ``least`` letters (SRC11)."""
    return pages.groupBy("doc_id").agg((F.sum(F.length(F.coalesce("text", F.lit("")))) < least).alias("scanned"))


@catalogue.frame("src11_scanned_documents", lambda d: "SELECT doc_id, length(replace(coalesce(text, ''), chr(10), '')) < 100 AS scanned FROM @documents WHERE text IS NOT NULL")
def _src11(spark, sf_dir: str) -> DataFrame:
    return scanned(catalogue.load(spark, sf_dir, "v_lines"))


@catalogue.view("v_audit")
def _audit(d):
    return "SELECT event_type AS task_name, CASE WHEN user_id % 3 = 0 THEN 'vision' ELSE 'text' END AS channel, value > 50 AS ok, 1 + event_id % 3 AS attempts, CAST(round(value * 10) AS BIGINT) AS elapsed_ms FROM @events"


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Calls, shares of successes and retries, and times of each task and channel (AG16)."""
    return audit.groupBy("task_name", "channel").agg(
        F.count("*").alias("calls"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("ok_share"), F.sum(F.col("attempts") - 1).alias("retries"), F.max("elapsed_ms").alias("slowest"), F.round(F.percentile("elapsed_ms", F.lit(0.5)), 3).alias("median_ms"))


@catalogue.frame("ag16_audit_rollup", lambda d: "SELECT task_name, channel, count(*) AS calls, round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 6) AS ok_share, CAST(sum(attempts) - count(*) AS BIGINT) AS retries, max(elapsed_ms) AS slowest, round(quantile_cont(elapsed_ms, 0.5), 3) AS median_ms FROM @v_audit GROUP BY task_name, channel")
def _ag16(spark, sf_dir: str) -> DataFrame:
    return audit_rollup(catalogue.load(spark, sf_dir, "v_audit"))
