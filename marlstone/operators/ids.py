"""Identifiers: normal form, parts, alias dictionaries, resolution, predicates (ID01 to ID15)."""

from __future__ import annotations

from ..plans import views  # noqa: F401
from ..plans.dialect import Dialect, catalogue

add = catalogue.add

#: Words that introduce an identifier, and the shape of its core.
PREFIXES = ["Example", "Ex.", "Ex", "No.", "No", "Compound", "Embodiment", "Intermediate", "Int.", "Preparation", "Formula", "实施例", "化合物", "编号"]
TARGETS = ["Example", "Ex.", "Ex", "No.", "No", "Compound", "Formula", "实施例", "化合物", "编号"]
SUFFIX = "(?:[-–—][A-Za-z0-9]+)?"
CORE = f"(?:[A-Za-z]?[0-9]+[A-Za-z]?{SUFFIX}|[IVXLCM]+[A-Za-z]?{SUFFIX})"
PROSE = ["answer", "returned", "model", "label", "identifier", "id is", "was"]

_ANY = "|".join(p.replace(".", r"\.") for p in PREFIXES)
KEYWORD = rf"(?i)\b(?:{_ANY})\s*{CORE}\b"
PARTS = rf"(?i)({_ANY})\s*({CORE})"
SHORT = rf"(?i)^\(?\s*({CORE})\s*\)?$"
TAIL = rf"(?i)(\(?\s*(?:{CORE})\s*\)?)\s*$"
LABEL = r"^(?:\([A-Za-z0-9,+\-]+\)\s*[-–—]?\s*)?[A-Za-z0-9一-鿿][A-Za-z0-9一-鿿\s.\-–—_/()]*$"
KEYS = ["COMPOUND_ID", "compound_id", "VALUE", "value", "ID", "id", "answer", "Answer"]


def compact(d: Dialect, x: str) -> str:
    return f"trim({d.replace_all(x, r'\s+', ' ')})"


def concise(d: Dialect, v: str) -> str:
    """Whether a text with single spaces is a whole short label (ID02)."""
    prose = " AND ".join(f"NOT contains(lower({v}), '{t}')" for t in PROSE)
    return f"({v} <> '' AND length({v}) <= 64 AND {d.size(d.split(v, ' '))} <= 4 AND {d.matches(v, LABEL)} AND {d.matches(v, '(?i)[0-9IVXLCM]')} AND {prose})"


def normal(d: Dialect, x: str) -> str:
    """Normal form of an identifier (ID01, without the literal branch).  Each step is bound to a
    name, so that no step repeats another's expression."""
    keys = ", ".join(f"nullif({d.json('v_', k)}, '')" for k in KEYS)
    short = rf"(?i)\(?\s*{CORE}\s*\)?"
    pick = f"CASE WHEN {d.size('words_')} > 0 THEN {d.at('words_', -1)} WHEN {concise(d, 'c_')} THEN c_ WHEN {d.size('shorts_')} = 1 AND length({d.replace_all(d.at('shorts_', 1), '[^0-9A-Za-z一-鿿]', '')}) <= 6 THEN trim({d.at('shorts_', 1)}) ELSE c_ END"
    strip = f"trim(BOTH ' ,;:[]{{}}' FROM {compact(d, pick)})" if d.spark else f"trim({compact(d, pick)}, ' ,;:[]{{}}')"
    found = d.let(d.extract_all("c_", KEYWORD), "words_", d.let(d.extract_all("c_", short), "shorts_", strip))
    inner = d.let(compact(d, f"CASE WHEN {d.matches('v_', r'^[{].*[}]$')} THEN coalesce({keys}, v_) ELSE v_ END"), "c_", found)
    return d.let(f"trim(coalesce({x}, ''))", "v_", inner)


def normalised(d: Dialect, source: str, column: str) -> str:
    return f"SELECT *, {normal(d, column)} AS norm FROM ({source}) z"


def token(d: Dialect, x: str) -> str:
    """Alias token of a normalised identifier (ID03)."""
    return d.replace_all(f"lower({x})", "[^0-9a-z一-鿿]+", "")


def parted(d: Dialect, source: str) -> str:
    """Rows with ``norm`` and its ``prefix`` and ``core``, "" if none (ID04)."""
    core = f"CASE WHEN {d.matches('n_', PARTS)} THEN {d.extract('n_', PARTS, 2)} WHEN {d.matches('n_', SHORT)} THEN {d.extract('n_', SHORT, 1)} WHEN {concise(d, 'n_')} THEN '' ELSE {d.extract(f'trim({d.extract('n_', TAIL, 1)})', SHORT, 1)} END"
    return f"SELECT *, {d.extract('norm', PARTS, 1)} AS prefix, {d.let('norm', 'n_', core)} AS core FROM ({source}) y"


@catalogue.view("v_raw")
def _raw(d):
    k = "CAST(p_partkey AS STRING)"
    forms = [f"concat('Example ', {k})", f"concat('(', {k}, ')')", f"concat('  compound   ', {k}, ' ')", f"concat('{{\"COMPOUND_ID\": \"Example ', {k}, '\"}}')", f"concat('see Example 1 and Compound ', {k})", f"concat('the answer was ', {k})", "p_name", "''", f"concat('[', {k}, ']')", f"concat('No.', {k}, 'a')", "'IV'", f"concat({k}, '-b')"]
    case = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    return f"SELECT p_partkey AS k, CASE p_partkey % 12 {case} END AS raw FROM @part"


@catalogue.view("v_norm")
def _norm(d):
    return normalised(d, "SELECT k, raw FROM @v_raw", "raw")


@catalogue.view("v_named")
def _named(d):
    return normalised(d, "SELECT ord, compound_id FROM @v_structures", "compound_id")


@catalogue.view("v_named_wide")
def _named_wide(d):
    """Structures with their normal form, in one pass."""
    return normalised(d, "SELECT ord, compound_id, smiles FROM @v_structures", "compound_id")


@catalogue.view("v_official")
def _official(d):
    """Distinct officials in first-seen order, with their parts."""
    inner = "SELECT norm, min(ord) AS pos FROM @v_named s WHERE norm <> '' GROUP BY norm"
    named = f"SELECT norm AS official, pos, {token(d, 'norm')} AS own, prefix, core, {token(d, 'core')} AS core_token FROM ({parted(d, inner)}) o"
    return f"SELECT *, count(*) OVER (PARTITION BY core_token) AS n_core, count(CASE WHEN prefix <> '' THEN 1 END) OVER (PARTITION BY core_token) AS n_keyword, min(CASE WHEN prefix <> '' THEN official END) OVER (PARTITION BY core_token) AS keyword FROM ({named}) w"


@catalogue.view("v_alias")
def _alias(d):
    """Alias tokens: (alias, official, n): n over 1 is ambiguous (ID05)."""
    only = "CASE WHEN n_core = 1 AND core_token <> '' THEN {} END"
    variants = ["official", "CASE WHEN prefix <> '' THEN concat(prefix, core) END", *[only.format(v) for v in ["core", "concat('编号', core)", *[f"concat('{p} ', core)" for p in TARGETS]]]]
    spread = f"SELECT {token(d, 'v')} AS alias, official, pos FROM @v_official o {d.each(d.array(*variants), 'v')} WHERE v IS NOT NULL"
    return f"SELECT alias, min_by(official, pos) AS official, count(DISTINCT official) AS n FROM ({spread}) a WHERE alias <> '' GROUP BY alias"


@catalogue.view("v_preferred")
def _preferred(d):
    """Bare officials and the one keyword form that shares their core (ID06)."""
    return "SELECT own AS alias, official AS bare, keyword AS preferred FROM @v_official WHERE prefix = '' AND core_token <> '' AND n_keyword = 1"


@catalogue.view("v_resolved")
def _resolved(d):
    """Raw identifiers with canonical form and source (ID07)."""
    raws = normalised(d, "SELECT DISTINCT raw_id AS raw FROM @v_assay_long", "raw")
    keys = f"SELECT raw, norm, {token(d, 'norm')} AS alias FROM ({raws}) n"
    return f"""SELECT raw, norm, CASE WHEN norm = '' THEN '' ELSE coalesce(preferred, official, '') END AS canonical,
CASE WHEN norm = '' THEN 'empty' WHEN preferred IS NOT NULL THEN 'deterministic_preferred' WHEN official = norm THEN 'exact_match' WHEN official IS NOT NULL THEN 'deterministic_alias' ELSE 'unresolved' END AS source
FROM (SELECT x.raw, x.norm, p.preferred, a.official FROM ({keys}) x LEFT JOIN @v_preferred p ON x.alias = p.alias LEFT JOIN (SELECT alias, official FROM @v_alias WHERE n = 1) a ON x.alias = a.alias) r"""


add("id01_normalise", lambda d: "SELECT k, raw, norm FROM @v_norm")
add("id02_concise_label", lambda d: f"SELECT k, raw, {concise(d, 'c')} AS concise FROM (SELECT k, raw, {compact(d, 'raw')} AS c FROM @v_raw) r")
add("id03_alias_token", lambda d: f"SELECT k, {token(d, 'norm')} AS alias FROM @v_norm")
add("id04_parts", lambda d: f"SELECT k, norm, prefix, core, prefix <> '' AS has_keyword FROM ({parted(d, 'SELECT k, norm FROM @v_norm')}) p")
add("id05_alias_dictionary", lambda d: "SELECT alias, CASE WHEN n = 1 THEN official END AS official, n > 1 AS ambiguous FROM @v_alias")
add("id06_preferred", lambda d: "SELECT DISTINCT alias, bare, preferred FROM @v_preferred")
add("id07_resolve", lambda d: "SELECT raw, canonical, source FROM @v_resolved")
add("id08_canonicalise_records", lambda d: f"SELECT s.ord, s.norm AS raw_compound_id, coalesce(p.preferred, a.official, s.norm) AS canonical_compound_id FROM (SELECT ord, norm, {token(d, 'norm')} AS alias FROM @v_named z WHERE norm <> '') s LEFT JOIN (SELECT DISTINCT alias, preferred FROM @v_preferred) p ON s.alias = p.alias LEFT JOIN (SELECT alias, official FROM @v_alias WHERE n = 1) a ON s.alias = a.alias")


@catalogue.view("v_remapped")
def _remapped(d):
    """First raw key wins for each assay, page and official id (ID09)."""
    return "SELECT assay, page, canonical, value, ord FROM (SELECT l.assay, l.page, r.canonical, l.value, l.ord, row_number() OVER (PARTITION BY l.assay, l.page, r.canonical ORDER BY l.ord) AS k FROM @v_assay_long l JOIN @v_resolved r ON l.raw_id = r.raw WHERE r.source <> 'unresolved' AND r.canonical <> '') x WHERE k = 1"


add("id09_remap", lambda d: "SELECT assay, page, canonical, value, ord FROM @v_remapped")
add("id11_final_predicates", lambda d: f"SELECT ord, compound_id, {d.matches('compound_id', '(?i)^(intermediate|int[.]|preparation|embodiment)')} AS nonfinal, (compound_id <> '' AND lower(compound_id) NOT IN ('none', 'null', 'unknown') AND NOT {d.matches('compound_id', '(?i)^(intermediate|int[.]|preparation|embodiment)')}) AS usable FROM @v_structures")
add("id14_safe_casts", lambda d: "SELECT k, coalesce(TRY_CAST(raw AS INT), -1) AS as_int, CASE WHEN TRY_CAST(raw AS INT) > 0 THEN TRY_CAST(raw AS INT) ELSE 1 END AS positive, CASE WHEN lower(raw) IN ('yes', 'true', '1', 'y') THEN true WHEN lower(raw) IN ('no', 'false', '0', 'n') THEN false END AS as_bool FROM (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN 'yes' WHEN 2 THEN '-4' WHEN 3 THEN 'N' ELSE 'x1' END AS raw FROM @part) t")
add("id15_type_synonyms", lambda d: "SELECT k, CASE WHEN t IN ('complete', 'full', 'complete_compound') THEN 'complete_compound' WHEN t IN ('markush', 'generic') THEN 'markush' WHEN contains(t, 'fragment') OR contains(t, 'substituent') THEN 'fragment' WHEN contains(t, 'reaction') THEN 'reaction' ELSE 'uncertain' END AS structure_type FROM (SELECT k, lower(structure_type) AS t FROM @v_candidates) c")
add("jn04_dictionary_join", lambda d: f"SELECT l.ord, a.official FROM (SELECT ord, {token(d, 'norm')} AS alias FROM ({normalised(d, "SELECT ord, raw_id FROM @v_assay_long", "raw_id")}) n) l JOIN (SELECT alias, official FROM @v_alias WHERE n = 1) a ON l.alias = a.alias")
