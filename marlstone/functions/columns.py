"""Rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of a number with its unit, of a unit in a name, of bracketed tokens.
NUMBER = r"[<>≤≥~≈]?\s*-?\d+(?:\.\d+)?(?:\s*[x×]\s*10\^?-?\d+)?"
UNIT = r"[A-Za-zμµ%/][A-Za-z0-9μµ%/.\-]*"
NAME_UNIT = r"\(([^()]{1,24})\)"
MARKUSH = r"(?i)\b(?:R\s*\d+|X\s*\d*|Y\s*\d*|Z\s*\d*|Ar|Het)\b"
NONE_IDS = ("none", "null", "unknown", "n/a", "na")
NONFINAL_ROLES = ("reactant", "intermediate", "reagent_or_condition")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def clean_unit(c: Column) -> Column:
    return F.regexp_replace(text(c), r"^[\[\]() ]+|[\[\]() ]+$", "")


def number_of(value: Column) -> Column:
    """The number of "54 nM" without blanks; a text of another shape as it is (TX19)."""
    whole = rf"^({NUMBER})\s*({UNIT})$"
    return let(text(value), lambda v: F.when(F.regexp_like(v, F.lit(whole)), F.replace(F.regexp_extract(v, whole, 1), F.lit(" "), F.lit(""))).otherwise(v))


def unit_of(value: Column) -> Column:
    return let(text(value), lambda v: clean_unit(F.regexp_extract(v, rf"^({NUMBER})\s*({UNIT})$", 2)))


def unit_in_name(name: Column) -> Column:
    """The last short bracket of a name, if it has a letter or a percent sign."""
    def pick(found: Column) -> Column:
        last = strip(F.try_element_at(found, F.lit(-1)))
        return F.when(F.coalesce(F.regexp_like(last, F.lit("[A-Za-z%μµ]")), F.lit(False)), clean_unit(last)).otherwise("")

    return let(F.regexp_extract_all(text(name), F.lit(NAME_UNIT), F.lit(1)), pick)


def flattened(name: Column, value: Column) -> Column:
    """An assay value, a JSON object or a scalar, as value and metadata (TX21).  The unit is the
    object's own, else that of the value, else that of the name."""
    own = F.regexp_like(text(value), F.lit(r"(?s)^\{.*\}$"))

    def field(key: str) -> Column:
        return F.coalesce(F.nullif(F.get_json_object(value, f"$.{key}"), F.lit("")), F.get_json_object(value, f"$.{key.upper()}"))

    there = F.get_json_object(value, "$.value")
    raw = F.when(own, F.coalesce(there, F.get_json_object(value, "$.VALUE"), F.lit(""))).otherwise(F.coalesce(value, F.lit("")))

    def build(v: Column) -> Column:
        unit = F.coalesce(F.when(own, F.nullif(field("unit"), F.lit(""))), F.nullif(unit_of(v), F.lit("")), unit_in_name(name))
        part = lambda key, other: F.when(own, strip(F.coalesce(F.nullif(field(key), F.lit("")), other))).otherwise(other)
        none = F.lit("")
        return F.struct(
            number_of(v).alias("value"), clean_unit(unit).alias("unit"), part("method", text(name)).alias("method"),
            part("description", none).alias("description"), part("confidence", none).alias("confidence"), part("reason", none).alias("reason"),
        )

    return let(raw, build)


def atom_symbol(symbol: Column) -> Column:
    """An atom's element, without brackets, isotope, chirality and charge; wildcards and R groups as
    they stand (TX36)."""
    bare = let(text(symbol), lambda s: F.when(F.regexp_like(s, F.lit(r"(?s)^\[.*\]$")) & (F.length(s) > 1), F.regexp_replace(s, r"(?s)^\[(.*)\]$", "$1")).otherwise(s))

    def element(s: Column) -> Column:
        plain = F.replace(F.regexp_replace(s, r"^\d+", ""), F.lit("@"), F.lit(""))
        return F.when(s.isin("*", "H") | s.startswith("R") | s.endswith("*"), s).otherwise(let(plain, lambda p: (
            F.when(F.regexp_like(p, F.lit("^(Cl|Br|Si)")), F.substring(p, 1, 2))
            .when(F.regexp_like(p, F.lit("^[cnops]")), F.upper(F.substring(p, 1, 1)))
            .when(F.regexp_like(p, F.lit("^[A-Z]")), F.regexp_extract(p, "^[A-Z][a-z]?", 0))
            .otherwise(p)
        )))

    return let(bare, element)


def markush_tokens(c: Column, limit: int = 12) -> Column:
    """The variable tokens of a text in order of their first place (TX29): at most two letters in
    capitals, longer ones with a capital first."""
    tidy = lambda t: let(F.regexp_replace(t, r"\s+", ""), lambda x: F.when(F.length(x) <= 2, F.upper(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))))
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MARKUSH), F.lit(0)), tidy)), 1, limit)


def variable_positions(cell: Column, *texts: Column) -> Column:
    """A cell's own variable, then Rn for every "Rn" or "[n*]" of the texts (TX29)."""
    numbers = [F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\bR\s*\d+\b|\[\d+\*\]"), F.lit(0)), lambda x: F.concat(F.lit("R"), F.regexp_extract(x, r"\d+", 0))) for t in texts]
    return F.array_distinct(F.concat(F.filter(F.array(text(cell)), lambda x: x != ""), *numbers))


def truncated(c: Column, limit: int, marker: str = "...") -> Column:
    """At most ``limit`` characters, and a marker where something is missing (TX05)."""
    return let(F.coalesce(c, F.lit("")), lambda s: F.concat(F.substring(s, 1, limit), F.when(F.length(s) > limit, F.lit(marker)).otherwise("")))


def model_json(response: Column) -> Column:
    """The JSON text of a model's answer, null if there is none (TX24): think blocks and box marks
    go, then a fence, a curly-quoted block or the outermost braces."""
    s = F.regexp_replace(F.coalesce(response, F.lit("")), r"(?is)<think>.*?</think>", "")
    s = strip(F.regexp_replace(s, r"(?s)<\|begin_of_box\|>(.*?)<\|end_of_box\|>", "$1"))
    fence, quote = F.lit("```"), "“json"

    def pick(t: Column) -> Column:
        after = F.substring(t, F.locate("```json", t) + F.lit(7), F.length(t))
        quoted = strip(F.substring(t, F.locate(quote, t) + F.lit(5), F.length(t)))
        first, last = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
        return (
            F.when(F.contains(t, F.lit("```json")), strip(F.split_part(after, fence, F.lit(1))))
            .when(F.size(F.split(t, "```")) > 2, strip(F.split_part(t, fence, F.lit(2))))
            .when(F.contains(t, F.lit(quote)), strip(F.regexp_replace(quoted, "”$", "")))
            .when((first > 0) & F.contains(t, F.lit("}")) & (last > first), F.substring(t, first, last - first + 1))
        )

    return let(s, pick)


def allowed_id(payload: Column, allowed: Column | None = None) -> Column:
    """(id, error) of an id payload: low confidence and none-like ids give no id; a broken contract
    or an id outside the allow-list gives an error (ID12)."""
    conf = F.lower(text(F.get_json_object(payload, "$.CONFIDENCE")))
    reason, found = text(F.get_json_object(payload, "$.REASON")), F.get_json_object(payload, "$.COMPOUND_ID")

    def judge(i: Column) -> Column:
        none = F.lower(i).isin(*NONE_IDS) | (conf == "low")
        outside = F.lit(False) if allowed is None else ~F.array_contains(F.transform(allowed, lambda x: strip(x)), i)
        error = (
            F.when(~conf.isin("high", "medium", "low"), "bad confidence").when(reason == "", "empty reason")
            .when(found.isNull(), "null id").when(i == "", "empty id").when(~none & outside, "id outside the allow-list")
        )
        return F.struct(F.when(error.isNull() & ~none, i).alias("id"), error.alias("error"))

    return let(text(found), judge)


def whole(c: Column) -> Column:
    """A whole number from a text such as "3" or "3.7", cut towards zero; null if it is none."""
    return F.floor(F.abs(c.try_cast("double"))).cast("long") * F.signum(c.try_cast("double")).cast("long")


def record_pages(scalars: list[Column], source_pages: Column) -> Column:
    """Pages of a record: its scalar page fields and every number of its source pages (ID13)."""
    digits = F.transform(F.regexp_extract_all(F.coalesce(source_pages, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("long"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*[whole(s) for s in scalars]), digits))))


def cli_pages(pages: Column) -> Column:
    """(pages, error) of "1-3,5" (TX01): a reversed range gives nothing, a leading minus a negative
    page, and any other part that is no number or range an error."""
    parts = F.transform(F.split(pages, ","), lambda x: strip(x))
    single, pair = r"^[+-]?\d+$", r"^([+]?\d+)\s*-\s*([+]?\d+)$"
    ranged = lambda p: F.contains(p, F.lit("-")) & ~p.startswith("-")
    bad = F.filter(parts, lambda p: ~F.when(ranged(p), F.regexp_like(p, F.lit(pair))).otherwise(F.regexp_like(p, F.lit(single))))

    def spread(p: Column) -> Column:
        lo, hi = (F.regexp_extract(p, pair, k).cast("long") for k in (1, 2))
        return F.when(ranged(p), F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))).otherwise(F.array(p.cast("long")))

    error = let(F.try_element_at(bad, F.lit(1)), lambda p: F.when(p.isNull(), F.lit(None).cast("string")).when(ranged(p), F.concat(F.lit("Invalid page range format: "), p)).otherwise(F.concat(F.lit("Invalid page number: "), p)))
    good = F.when(F.size(bad) == 0, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, spread)))))
    return F.struct(good.alias("pages"), error.alias("error"))


def tile_origins(length: Column, tile: int, stride: int, most: int) -> Column:
    """Origins of tiles along a side: each stride, and one that ends with the side; if too many, evenly
    chosen ones (SO04)."""
    steps = F.sequence(F.lit(0).cast("long"), length - F.lit(tile), F.lit(stride).cast("long"))
    every = F.array_distinct(F.concat(steps, F.array(length - F.lit(tile))))

    def thin(o: Column) -> Column:
        picks = [F.element_at(o, (F.bround(F.lit(k) * (F.size(o) - 1) / F.lit(max(1, most - 1))) + 1).cast("int")) for k in range(most)]
        return F.when(F.size(o) <= most, o).otherwise(F.array(F.lit(0).cast("long")) if most <= 1 else F.array_distinct(F.array(*picks)))

    return F.when(length <= tile, F.array(F.lit(0).cast("long"))).otherwise(let(every, thin))


def fitted(height: Column, width: Column, side: int) -> Column:
    """Scale, new size and padding of a picture that is fitted in a square (SP08)."""
    scale = F.lit(float(side)) / F.greatest(height, width)
    new = lambda x: F.least(F.bround(x * scale), F.lit(side)).cast("long")
    gap = lambda x: F.floor((F.lit(side) - new(x)) / 2).cast("long")
    return F.struct(F.round(scale, 6).alias("scale"), new(height).alias("new_h"), new(width).alias("new_w"), gap(height).alias("top"), gap(width).alias("left"))


def title_levels(heights: Column, step: float) -> Column:
    """Levels of titles by height, the highest first: a drop of more than a step below the height at
    which the level began opens the next one, to six at most (TX30).  heights: array of numbers in
    falling order; gives an array of levels."""
    begin = F.struct(F.element_at(heights, 1).cast("double").alias("top"), F.lit(1).alias("level"), F.array().cast("array<int>").alias("out"))

    def follow(acc: Column, h: Column) -> Column:
        drop = acc["top"] - h > step
        level = acc["level"] + drop.cast("int")
        return F.struct(F.when(drop, h.cast("double")).otherwise(acc["top"]).alias("top"), level.alias("level"), F.concat(acc["out"], F.array(F.least(level, F.lit(6)))).alias("out"))

    return F.aggregate(heights, begin, follow, lambda acc: acc["out"])


def strictness_decision(kind: Column, complete: Column, suspicious: Column, crop: Column, review: Column, review_complete: Column, strictness: Column) -> Column:
    """(structure_type, complete) after the reviews that a touched border asks for (FL05).

    crop: not_cropped, fragment, another status, or null where the call failed; review: the type a
    second look gives, null where that failed.  Permissive asks for no review.
    """
    level = F.lower(strip(F.coalesce(strictness, F.lit("strict"))))
    level = F.when(level.isin("strict", "balanced", "permissive"), level).otherwise("strict")
    asked = (kind == "complete_compound") & suspicious & (level != "permissive")
    cut = asked & F.coalesce(crop == "fragment", F.lit(False))
    uncut = asked & F.coalesce(crop == "not_cropped", F.lit(False))
    second = asked & ~cut
    changed = second & review.isNotNull() & (review != "complete_compound")
    confirmed = uncut | second & F.coalesce(review == "complete_compound", F.lit(False))
    failed = asked & (crop.isNull() | second & review.isNull())
    open_ = second & ~changed & ~confirmed
    doubtful = open_ & (failed | (level == "strict"))
    # permissive asks nothing and doubts nothing; a failed call counts only where one was asked for
    out = F.when(cut, "fragment").when(changed, review).when(doubtful, "uncertain").otherwise(kind)
    yes = F.when(cut, F.lit(False)).when(changed, F.coalesce(review_complete, F.lit(False))).when(doubtful, F.lit(False)).otherwise(complete)
    return F.struct(out.alias("structure_type"), yes.alias("complete"))


def box_gate(kind: Column, complete: Column, status: Column, single: Column, whole_box: Column, confidence: Column, reason: Column, evidence: Column) -> Column:
    """(side, reason) of a structure (FL03): kept if it is a complete compound whose box review is
    complete, single and at least of medium confidence; else filtered, with the reasons."""
    allowed = (status == "complete_single_structure") & single & whole_box & F.lower(strip(confidence)).isin("high", "medium")
    allowed = F.coalesce(allowed, F.lit(False))
    reviewed = complete | kind.isin("markush", "fragment")
    said = F.concat(F.lit("box gate rejected candidate: "), F.coalesce(status, F.lit("")), F.lit("; "), F.coalesce(evidence, F.lit("")))
    parts = F.filter(F.array(F.coalesce(reason, F.lit("")), F.when(reviewed & ~allowed, said).otherwise("")), lambda x: x != "")
    return F.struct(F.when(complete & allowed, "kept").otherwise("filtered").alias("side"), F.array_join(parts, "; ").alias("reason"))


def final_gate(compound_id: Column, role: Column, reason: Column) -> Column:
    """(side, reason): structures of a non-final role or without a usable id go to the filtered side
    (FL04)."""
    bad_role = F.lower(text(role)).isin(*NONFINAL_ROLES)
    name = F.regexp_replace(text(compound_id), r"\s+", " ")
    unusable = (name == "") | F.lower(name).isin(*NONE_IDS) | F.lower(name).startswith("error:") | F.regexp_like(name, F.lit(r"(?i)^\(?\s*(intermediate|int\.?|preparation|prep\.?|embodiment)\b"))
    said = F.when(bad_role, F.concat(F.lit("role "), text(role))).when(unusable, F.lit("unusable id")).otherwise("")
    parts = F.filter(F.array(text(reason), said), lambda x: x != "")
    return F.struct(F.when(bad_role | unusable, "filtered").otherwise("kept").alias("side"), F.when(bad_role | unusable, F.array_join(parts, "; ")).otherwise(text(reason)).alias("reason"))


def inside_root(path: Column, root: str) -> Column:
    """(path, inside): a path with its ".." resolved, and whether it lies in the root (TX37)."""
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    solved = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/"))
    base = root.rstrip("/")
    return let(solved, lambda s: F.struct(s.alias("path"), ((s == base) | s.startswith(base + "/")).alias("inside")))


def auto_detect(asked: Column, pages: Column, numbers: Column) -> Column:
    """Whether pages are detected: if asked for, or if none are given (ML15)."""
    given = (F.coalesce(pages, F.lit("")) != "") | (F.coalesce(F.size(numbers), F.lit(0)) > 0)
    return F.coalesce(asked, F.lit(False)) | ~given


def cleaned_names(names: Column) -> Column:
    return F.filter(F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: strip(x)), lambda x: x != "")


def grid_ids(x: Column, y: Column, size_x: int, size_y: int, offset: int = 0, apart: bool = False) -> Column:
    """Vocabulary ids of coordinates in [0, 1], and the coordinates that they stand for (TX35).  The
    ids of y follow those of x where the axes are kept apart."""
    gap = size_x if apart else 0
    ix, iy = F.bround(x * (size_x - 1)).cast("long"), F.bround(y * (size_y - 1)).cast("long")
    return F.struct((ix + offset).alias("x_id"), (iy + offset + gap).alias("y_id"), F.round(ix / F.lit(float(size_x - 1)), 6).alias("x"), F.round(iy / F.lit(float(size_y - 1)), 6).alias("y"))


def hash_key(**fields: Column) -> Column:
    """sha256 of the fields as one JSON object with sorted keys (TX25); "key": value, parted by ", "."""
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"(?s)^\[(.*)\]$", "$1")


#: Phase, where its progress begins, how far it goes, and its cap.
PHASES = [("structure", 0.05, 0.8, 0.85), ("assay", 0.1, 0.75, 0.85), ("detect_pages", 0.52, 0.16, 0.78), ("detect_names", 0.68, 0.10, 0.78), ("merge", 0.2, 0.6, 1.0)]


def progress(phase: Column, fraction: Column) -> Column:
    """A task's progress from that of its phase (SM08)."""
    out = None
    for name, base, width, cap in PHASES:
        part = F.least(F.lit(cap), F.lit(base) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * F.lit(width))
        out = F.when(phase == name, part) if out is None else out.when(phase == name, part)
    return out
