"""Rules over single texts and JSON payloads whose next step depends on the last, in plain Python.
They run over Arrow batches; none keeps state between rows."""

from __future__ import annotations

import ast
import datetime
import json
import math
import re
from collections.abc import Callable, Iterable, Sequence

#: Keys that hold an identifier, in order, and answers that mean "none".
ID_KEYS = ("COMPOUND_ID", "compound_id", "VALUE", "value", "ID", "id", "answer", "Answer")
NONE_IDS = {"none", "null", "unknown", "n/a", "na"}
CONFIDENCES = {"high", "medium", "low"}


def _object(text: str):
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def fenced(value: str) -> str:
    """The first JSON object among a text's fenced parts, else the text."""
    if "```" not in value:
        return value
    for part in value.split("```"):
        part = part.strip()
        for body in (part, part.partition("\n")[2].strip()):
            if body.startswith("{") and body.endswith("}"):
                return body
    return value


def compound_id(value) -> str | None:
    """The id of a model's answer, unwrapped as often as it is wrapped (ID10)."""
    if value is None:
        return None
    text = fenced(str(value).strip())
    payload = _object(text)
    if payload is not None:
        for key in ID_KEYS:
            if payload.get(key) is not None:
                return compound_id(str(payload[key]))
    text = " ".join(text.split())
    return None if not text or text.lower() in ("none", "null") or text.lower().startswith("error:") else text


def structure_id(value) -> dict[str, str | None]:
    """A structured answer: id, role, source, evidence, confidence (medium where none is given)."""
    payload = _object(fenced(str(value or "").strip()))
    if payload is None:
        return {"compound_id": None, "visual_role": "", "id_source": "", "evidence": "", "confidence": ""}
    first = next((k for k in ID_KEYS if k in payload), None)
    said = lambda key, other="": str(payload.get(key.upper()) or payload.get(key) or other).strip()
    return {
        "compound_id": compound_id(payload.get(first)) if first else None, "visual_role": said("visual_role"), "id_source": said("id_source"),
        "evidence": said("evidence"), "confidence": said("confidence", "medium"),
    }


def unwrapped(text: str | None) -> str:
    """The text that a fence, JSON or a Python literal holds (the unwrapping step of ID01): of an object
    the first id key with a text, else any value; of a list its first text; "none" and "null" are no
    texts.  A text that holds nothing is itself."""
    value = fenced((text or "").strip())
    found: object = None
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(value)
            break
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    if isinstance(found, dict):
        items = [found[k] for k in ID_KEYS if k in found] + list(found.values())
    else:
        items = list(found) if isinstance(found, (list, tuple)) else [found] if isinstance(found, str) else []
    for item in items:
        inner = "" if item is None else unwrapped(str(item))
        if inner and inner.lower() not in ("none", "null"):
            return inner
    return value


def repaired_molblock(raw: str | None) -> str:
    """A molblock that readers accept (TX28): unquoted, real line ends, printable ASCII, cut at its
    end, numbers for nan and inf, three header lines before the version line."""
    text = (raw or "").strip().lstrip("﻿")
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1].strip()
    for mark in ("\\r\\n", "\\n", "\\r", "\r\n", "\r"):
        text = text.replace(mark, "\n")
    text = "".join(c for c in text.replace("\t", " ") if c == "\n" or " " <= c < "\x7f" or c == "\x7f")
    if "$MOL" in text:
        text = text.split("$MOL", 1)[1].lstrip("\n")
    if "$$$$" in text:
        text = text.split("$$$$", 1)[0].rstrip()
    if "M  END" in text:
        text = text[: text.index("M  END") + 6]
    elif "M  V30 END CTAB" in text:
        text = text.rstrip() + "\nM  END"
    text = re.sub(r"(?i)(?<!\S)[+-]?(?:nan|inf|1\.#ind|1\.#inf)(?!\S)", "0.0000", text)
    lines = text.splitlines()
    extended = any("M  V30" in x for x in lines)
    at = next((k for k, x in enumerate(lines) if "V2000" in x or "V3000" in x), None)
    if at is None:
        at = next((k for k, x in enumerate(lines) if re.match(r"\s*\d+(\s+\d+){5}", x) and "." not in x), None)
        if at is not None:
            lines[at] = f"{lines[at].rstrip()} {'V3000' if extended else 'V2000'}"
    if at is not None:
        head = lines[max(0, at - 3) : at]
        return "\n".join([""] * (3 - len(head)) + head + lines[at:])
    return "\n".join(["", "", "", "  0  0  0  0  0  0            999 V3000", *lines]) if extended else text


def merged(base, override):
    """Objects merged key by key, the second wins; lists and scalars are replaced (TX32)."""
    if isinstance(base, dict) and isinstance(override, dict):
        return {**base, **{k: merged(base.get(k), v) for k, v in override.items()}}
    return override


def merged_json(base: str | None, override: str | None) -> str:
    a, b = json.loads(base or "{}"), json.loads(override or "{}")
    if not isinstance(a, dict) or not isinstance(b, dict):
        raise ValueError("both sides must be JSON objects")
    return json.dumps(merged(a, b), sort_keys=True)


def json_safe(value):
    """Anything as JSON: times in ISO form, sets and tuples as lists, other things as text (TX45)."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((json_safe(v) for v in value), key=str)
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return json_safe(value.item()) if hasattr(value, "item") else str(value)


# -- contracts ------------------------------------------------------------------------------

_KINDS: dict[str, Callable[[object], bool]] = {
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
    "list": lambda v: isinstance(v, list),
    "integer_list": lambda v: isinstance(v, list) and all(isinstance(x, int) and not isinstance(x, bool) for x in v),
    "string_list": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v),
    "non_empty_string": lambda v: isinstance(v, str) and bool(v.strip()),
    "non_empty_list": lambda v: isinstance(v, list) and bool(v),
    "non_empty_string_list": lambda v: isinstance(v, list) and all(isinstance(x, str) and x.strip() for x in v),
}


def violations(payload: str | None, rules: Iterable[Sequence], condition: str = "keep") -> list[str]:
    """What breaks a contract (ML03).  rules: (kind, key, allowed, when): kind is required, allowed or
    one of the kinds of value, nullable_ before it lets null pass; ``when`` is null, or the value of
    the condition's key under which the rule holds."""
    found = _object(payload or "")
    if found is None:
        return ["not an object"]
    out = []
    state = found.get(condition)
    for kind, key, allowed, when in rules:
        if when is not None and state is not when:
            continue
        there, value = key in found, found.get(key)
        if kind == "required":
            if not there:
                out.append(f"missing {key}")
            continue
        if not there or kind.startswith("nullable_") and value is None:
            continue
        if kind == "allowed":
            if str(value).strip().lower() not in allowed:
                out.append(f"{key} is not allowed")
        elif not _KINDS[kind.removeprefix("nullable_")](value):
            out.append(f"{key} must be {kind.removeprefix('nullable_').replace('_', ' ')}")
    return out


def classification(payload: str | None) -> dict:
    """A structure's class (ML04): complete if and only if its type says so."""
    p = _object(payload or "")
    if p is None:
        return {"error": "not an object"}
    kind, complete = str(p.get("structure_type") or "").strip().lower(), p.get("is_complete_compound")
    said = {"structure_type": kind, "complete": complete, "confidence": str(p.get("confidence") or "").strip().lower()}
    if not isinstance(complete, bool):
        return said | {"complete": None, "error": "is_complete_compound must be boolean"}
    if complete != (kind == "complete_compound"):
        return said | {"error": "complete_compound and is_complete_compound disagree"}
    return said | {"error": ""}


def crop_check(payload: str | None) -> dict:
    """A crop's status (ML04): a fragment is cropped, what isn't cropped is not."""
    p = _object(payload or "")
    if p is None:
        return {"error": "not an object"}
    status, cropped = str(p.get("crop_status") or "").strip().lower(), p.get("is_cropped")
    wrong = status == "fragment" and not cropped or status == "not_cropped" and cropped
    return {"crop_status": status, "is_cropped": bool(cropped), "error": f"{status} disagrees with is_cropped" if wrong else ""}


def assay_values(payload: str | None, names: Sequence[str], rich: bool = False) -> list[tuple[str, str, str, str, str]]:
    """(assay, compound, value, unit, method) of a nested answer (ML05), blank keys and values left
    out.  ``rich`` asks every value for a confidence and a compatible match with its own assay."""
    top = _object(payload or "") or {}
    out = []
    for name in names:
        inner = top.get(name)
        for key, raw in (inner.items() if isinstance(inner, dict) else ()):
            own = raw if isinstance(raw, dict) else {}
            said = lambda f, other="", own=own: str(own.get(f) or own.get(f.upper()) or other).strip()
            value = own.get("value", own.get("VALUE")) if isinstance(raw, dict) else raw
            value = "" if value is None else str(value).strip()
            if not key.strip() or not value:
                continue
            if rich:
                match = own.get("assay_match") or own.get("ASSAY_MATCH") or {}
                fits = isinstance(match, dict) and match.get("compatible") is True and str(match.get("reason") or "").strip() and str(match.get("best_requested_assay") or "").strip() == name
                if said("confidence").lower() not in CONFIDENCES or not fits:
                    continue
            out.append((name, key.strip(), value, said("unit"), said("method", name) if own else ""))
    return out


def context_lines(chunk: str | None, key: str | None, value: str | None, most: int = 8) -> list[str]:
    """The first two lines that hold the key or the value, each with its neighbours; else the first
    lines (TX22).  A key of up to four letters must stand as a cell, in brackets or at an end."""
    lines = [x.strip() for x in (chunk or "").splitlines() if x.strip()]
    key, value = (key or "").strip(), (value or "").strip()

    def hit(x: str) -> bool:
        if value and value.lower() in x.lower():
            return True
        if not key:
            return False
        if len(key) > 4:
            return key.lower() in x.lower()
        return f"| {key} |" in f" {x} " or f"({key})" in x or x.startswith(key + " ") or x.endswith(" " + key)

    hits = [k for k, x in enumerate(lines) if hit(x)][:2]
    if not hits:
        return lines[:most]
    near = dict.fromkeys(j for k in hits for j in (k - 1, k, k + 1) if 0 <= j < len(lines))
    return [lines[j] for j in near][:most]


# -- tables ---------------------------------------------------------------------------------


def indel_ratio(a: str, b: str) -> float:
    """1 less the share of letters to insert or delete: twice the longest common subsequence over
    both lengths."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return 2 * row[-1] / (len(a) + len(b))


def spanning_tables(tables: list[dict], reach: int = 20, least: float = 0.7) -> list[dict]:
    """Tables on neighbouring places with as many columns and the same edges are one (WN08).  A
    later header that differs from the first one's is a row of data.  Tables: x0, x1, rows (the
    first is the header), in reading order; anything without rows stands between tables."""
    out: list[dict] = []
    for t in tables:
        last = out[-1] if out else None
        same = (
            last is not None and last["rows"] and t["rows"] and len(last["rows"][0]) == len(t["rows"][0])
            and abs(last["x0"] - t["x0"]) <= reach and abs(last["x1"] - t["x1"]) <= reach
        )
        if not same:
            out.append({**t, "rows": list(t["rows"])})
            continue
        alike = all(indel_ratio(a, b) >= least for a, b in zip(last["rows"][0], t["rows"][0]))
        last["rows"] += t["rows"][1:] if alike else t["rows"]
        last["x0"], last["x1"] = min(last["x0"], t["x0"]), max(last["x1"], t["x1"])
    return out


# -- decoding -------------------------------------------------------------------------------


def beams(steps: list[list[float]], width: int, end: int) -> list[tuple[list[int], float]]:
    """The best sequences over log-probabilities of each step; one that reaches ``end`` stands, the
    others go on (SO08; width 1 is greedy)."""
    live: list[tuple[list[int], float]] = [([], 0.0)]
    for odds in steps:
        grown = []
        for tokens, score in live:
            if tokens and tokens[-1] == end:
                grown.append((tokens, score))
            else:
                grown += [([*tokens, k], score + p) for k, p in enumerate(odds)]
        live = sorted(grown, key=lambda x: (-x[1], x[0]))[:width]
    return live


#: Words that make a line a table's header, and those that count without blanks.
HEADER_WORDS = ("example", "compound", "formula", "id", "no.", "tr-fret", "ec50", "ic50", "assay", "activity", "inhibition", "实施例", "化合物", "编号")
HEADER_TIGHT = ("ec50", "ic50", "ed50", "ki", "kd")
ROW_ID = re.compile(r"(?:[A-Za-z]{0,4}\s*)?\d+[A-Za-z]?(?:[-–]\d+[A-Za-z]?)?")
MEASURE = re.compile(r"(?i)\d+(?:\.\d+)?\s*(?:nM|uM|µM|mM|%|ng/mL|ug/mL|µg/mL)\b")


def cells_of(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def is_rule(line: str) -> bool:
    """A line of dashes between a table's header and its rows."""
    cells = [c for c in cells_of(line) if c]
    return bool(cells) and all(re.fullmatch(r":?-{2,}:?", c) for c in cells)


def is_header(line: str) -> bool:
    """Whether a line may be a header: any of the words as a substring (TX09)."""
    low = line.lower()
    tight = "".join(low.split())
    return any(w in low for w in HEADER_WORDS) or any(w in tight for w in HEADER_TIGHT)


def is_data(line: str) -> bool:
    cells = [c for c in cells_of(line) if c]
    return len(cells) > 1 and (bool(ROW_ID.fullmatch(cells[0])) or any(MEASURE.search(c) for c in cells[1:]))


def valid_block(lines: Sequence[str]) -> bool:
    """Whether pipe lines are a table (TX11): at least two, the commonest number of cells in half of
    them, and a rule among the first three, else three lines with a header or two data rows."""
    rows = [x for x in lines if x.count("|") >= 2 and not x.lstrip().startswith(("#", "* "))]
    counts = [len(cells_of(x)) for x in rows if not is_rule(x)]
    if len(rows) < 2 or not counts or max(counts) < 2:
        return False
    if max(counts.count(c) for c in set(counts)) < max(2, len(counts) // 2):
        return False
    if any(map(is_rule, rows[:3])):
        return True
    return len(rows) >= 3 and (is_header(rows[0]) or sum(map(is_data, rows)) >= 2)


def header_context(lines: Sequence[str], grids: Sequence[Sequence[Sequence[str]]], most: int = 900) -> str:
    """The header rows of a page (TX09): up to three of its pipe rows, then of each grid the first
    header among eight rows with the two rows below it, cut to ``most`` letters."""
    parts = []
    piped = [" | ".join(cells_of(x)) for x in (y.strip() for y in lines) if x.startswith("|") and x.endswith("|") and not is_rule(x) and is_header(x)][:3]
    if piped:
        parts.append("pipe rows:\n" + "\n".join(piped))
    for k, grid in enumerate(grids, 1):
        rows = [" | ".join(c.strip() for c in row if c and c.strip()) for row in grid]
        at = next((j for j, x in enumerate(rows[:8]) if x and is_header(x)), None)
        if at is not None:
            parts.append(f"table {k}:\n" + "\n".join(x for x in rows[at : at + 3] if x))
        if len("\n\n".join(parts)) >= most:
            break
    return "\n\n".join(parts).strip()[: max(0, most)].rstrip()


def envelope(chunk: str, document: str, continuation: str, page: int, most: int, overhead: int = 260, least: int = 120) -> str:
    """A chunk with its contexts in tagged blocks (TX18): what the chunk leaves of the budget goes half
    to the end of the continuation and the rest to the document; blocks of at most ``least`` letters
    are left out."""
    document, continuation = document.strip(), continuation.strip()
    if not document and not continuation:
        return chunk
    room = max(0, most - len(chunk) - overhead)
    tail = min(len(continuation), room // 2)
    head = room - tail
    parts = []
    if document and head > least:
        parts.append(f"<DOCUMENT>\n{document[:head].rstrip()}\n</DOCUMENT>")
    if continuation and tail > least:
        parts.append(f"<CONTINUATION>\n{continuation[-tail:].lstrip()}\n</CONTINUATION>")
    return "\n\n".join([*parts, f'<CHUNK page="{page}">\n{chunk}\n</CHUNK>'])


def prompt(template: str, content: str, assays: Sequence[str], ids: Sequence[str], most_ids: int = 128) -> str:
    """A task's prompt: the template's marks filled with JSON blocks; a list of more than ``most_ids``
    ids is left out (TX46)."""
    blocks = {"{{CONTENT}}": content, "{{ASSAYS}}": json.dumps(list(assays)), "{{IDS}}": json.dumps(list(ids)) if len(ids) <= most_ids else ""}
    return re.sub("|".join(map(re.escape, blocks)), lambda m: blocks[m[0]], template)


def planned(decisions: Iterable[dict], pages: Sequence[int]) -> dict[int, int | None]:
    """Per page the earlier page whose context it takes over (ML06): a source must be a page of the
    document before this one; pages without a decision have none; the first decision counts."""
    known = set(pages)
    out: dict[int, int | None] = {p: None for p in pages}
    seen = set()
    for d in decisions:
        page, source = d.get("page"), d.get("source_page")
        if page in known and page not in seen:
            seen.add(page)
            if d.get("use_context") is True and isinstance(source, int) and not isinstance(source, bool) and source in known and source < page:
                out[page] = source
    return out


# -- markdown, locks, steps ---------------------------------------------------------------------

#: Signs that Markdown would read as marks.
MARKS = re.compile(r"[\\`*_#|>\-$+]")


def escaped(text: str) -> str:
    """A text whose signs and numbered beginnings Markdown leaves alone (SNK09)."""
    return re.sub(r"(\d+)\.", r"\1\\.", MARKS.sub(lambda m: "\\" + m[0], text))


def markdown(blocks: Iterable[dict], footers: bool = False) -> str:
    """Blocks as Markdown, in order (SNK09): titles with their level, tables and figures as they are
    given, footers only if wanted, anything else escaped."""
    out = []
    for b in blocks:
        kind, text = b.get("type"), b.get("text") or ""
        if kind == "title":
            out.append("\n" + "#" * min(6, max(1, int(b.get("level") or 1))) + " " + " ".join(text.split("\n")) + "\n")
        elif kind == "table":
            out.append(text + "\n")
        elif kind == "figure":
            out.append(f"![{b.get('name') or 'figure'}]({b.get('name') or 'figure'})\n")
        elif kind == "footer":
            out.append(text if footers else escaped(text) + "\n")
        else:
            out.append(escaped(text) + "\n")
    return "".join(out)


def leases(events: Iterable[tuple[float, str, str, str, float]], least: float = 60) -> list[bool]:
    """Whether each lock event takes effect (SM06).  Events, by time: (time, "acquire" or "release",
    task, token, seconds).  A lock is free if nobody holds it or its time is over; it is held for at
    least ``least`` seconds, and given back only by the token that holds it (an empty token: by
    anyone)."""
    held: dict[str, tuple[str, float]] = {}
    out = []
    for at, what, task, token, seconds in events:
        owner, until = held.get(task, ("", -math.inf))
        free = at >= until
        if what == "acquire":
            out.append(free)
            if free:
                held[task] = (token, at + max(least, seconds))
        else:
            gives = not free and token in ("", owner)
            out.append(gives)
            if gives:
                del held[task]
    return out


def interruptible(step: Callable[[], object], timeout: float = 0, heartbeat: float = 1.0, cancelled: Callable[[], bool] = lambda: False, beat: Callable[[float], None] = lambda seconds: None, clock=None, wait=None):
    """(outcome, value) of a step that runs beside its watcher (SM09): done, failed, cancelled or timeout.
    The watcher looks for an end or a cancel at least every heartbeat; a step that is given up may
    finish later, unheard."""
    import queue
    import threading
    import time

    clock, results = clock or time.monotonic, queue.Queue(1)

    def run() -> None:
        try:
            results.put(("done", step()))
        except Exception as e:  # noqa: BLE001  the step's own failure is its outcome
            results.put(("failed", f"{type(e).__name__}: {e}"))

    threading.Thread(target=run, daemon=True).start()
    began = last = clock()
    while True:
        try:
            return results.get(timeout=min(heartbeat, 0.05) if wait is None else wait)
        except queue.Empty:
            pass
        now = clock()
        if cancelled():
            return "cancelled", None
        if timeout > 0 and now - began > timeout:
            return "timeout", None
        if now - last >= heartbeat:
            beat(now - began)
            last = now
