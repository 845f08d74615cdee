"""Rasters as small boolean arrays: components, masks, border contact, growth, tiles, poses."""

from __future__ import annotations

import numpy as np


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Four-connected components, numbered in reading order from 1 (SP04)."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        low = np.where(mask, label, mask.size + 1)
        new = low.copy()
        new[1:] = np.minimum(new[1:], low[:-1])
        new[:-1] = np.minimum(new[:-1], low[1:])
        new[:, 1:] = np.minimum(new[:, 1:], low[:, :-1])
        new[:, :-1] = np.minimum(new[:, :-1], low[:, 1:])
        new = np.where(mask, new, 0)
        # jump to the label of the pixel that the label names
        flat = new.ravel()
        new = np.where(mask, flat[np.maximum(new, 1) - 1], 0)
        if (new == label).all():
            break
        label = new
    names = np.unique(label[mask])
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.searchsorted(names, label[mask]) + 1
    return out, len(names)


def components(mask: np.ndarray, least: int = 50, share: float = 0.08) -> list[np.ndarray]:
    """The components of at least so many pixels and that share of the largest; the largest one if
    none is (SP04)."""
    label, n = labelled(mask)
    if n <= 1:
        return [mask] if n else []
    sizes = np.bincount(label.ravel(), minlength=n + 1)[1:]
    floor = max(least, int(sizes.max() * share))
    kept = [k + 1 for k in range(n) if sizes[k] >= floor] or [int(sizes.argmax()) + 1]
    return [label == k for k in kept]


def box_of(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    ys, xs = np.nonzero(mask)
    return None if not len(ys) else (int(ys.min()), int(xs.min()), int(ys.max()) + 1, int(xs.max()) + 1)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    both = int((a & b).sum())
    return both / int((a | b).sum()) if both else 0.0


def coverage(a: np.ndarray, b: np.ndarray) -> float:
    return int((a & b).sum()) / int(a.sum()) if a.any() else 0.0


def border_contact(grey: np.ndarray, dark: int = 245, band: int = 4, ratio: float = 0.035) -> dict[str, float]:
    """The share of dark pixels in a band along each side (TX38); a side is suspicious from
    ``ratio`` on."""
    h, w = grey.shape
    if not h or not w:
        return {}
    n = max(1, min(band, w, h))
    sides = {"left": grey[:, :n], "right": grey[:, w - n :], "top": grey[:n], "bottom": grey[h - n :]}
    return {k: float((v < dark).mean()) for k, v in sides.items()}


def opened(mask: np.ndarray, length: int, axis: int) -> np.ndarray:
    """The pixels of runs of at least ``length`` along an axis: an opening by a line."""
    m = mask if axis == 1 else mask.T
    out = np.zeros_like(m)
    for row, line in enumerate(m):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= length:
                out[row, a:b] = True
    return out if axis == 1 else out.T


def without_rules(mask: np.ndarray, wide: float = 0.55, high: float = 0.18, least: int = 20) -> np.ndarray:
    """The foreground without long ruling lines (SP07)."""
    h, w = mask.shape
    return mask & ~(opened(mask, max(least, int(w * wide)), 1) | opened(mask, max(least, int(h * high)), 0))


def ruling_ratio(mask: np.ndarray, share: float = 0.45, least: int = 8) -> float:
    """The share of the ink that lies in long straight runs (FL02's feature)."""
    h, w = mask.shape
    if not mask.any():
        return 0.0
    lines = opened(mask, max(least, int(w * share)), 1) | opened(mask, max(least, int(h * share)), 0)
    return int(lines.sum()) / int(mask.sum())


def grown(mask: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The components of the foreground that a seed touches (SP07's region growing)."""
    label, _ = labelled(mask)
    hit = np.unique(label[seed & mask])
    return np.isin(label, hit[hit > 0])


def final_candidate(mask: np.ndarray, grey: np.ndarray, box: tuple[int, int, int, int], side: int = 18, area: int = 450, ink: int = 35, density: float = 0.018, rules: float = 0.38, page: float = 0.92) -> str:
    """Why a candidate is dropped, "" if it stays (FL02): size, share of the page, mask, ruling lines,
    ink, shape."""
    y1, x1, y2, x2 = box
    h, w = max(0, y2 - y1), max(0, x2 - x1)
    if h < side or w < side or h * w < area or min(h, w) < 32 and h * w < 1600:
        return "small"
    if h * w / max(1, grey.size) > page:
        return "page"
    if int(mask.sum()) < max(18, int(h * w * 0.006)):
        return "thin mask"
    dark = grey[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] < 205
    if not dark.size:
        return "outside"
    if ruling_ratio(dark) > rules:
        return "ruling lines"
    inked = int(dark.sum())
    if inked < ink or inked / (h * w) < density:
        return "little ink"
    return "long and thin" if max(w / h, h / w) > 6 and inked / (h * w) < 0.08 else ""


def aggregates(boxes: list[tuple[int, int, int, int]], ratio: float = 1.75, tolerance: float = 0.04, least: int = 400, children: int = 2, span: float = 0.70, union: float = 0.45, same: float = 0.85, fill: float = 0.82, masks: list[np.ndarray] | None = None) -> list[bool]:
    """For each box whether it only gathers others (SP03): at least two contained children, each much
    smaller and no copy of it, that together span or cover it.  With masks, one whose own ink is a
    single block that fills its box stays."""
    out = []
    area = [max(0, y2 - y1) * max(0, x2 - x1) for y1, x1, y2, x2 in boxes]
    for k, b in enumerate(boxes):
        own = []
        dy, dx = tolerance * (b[2] - b[0]), tolerance * (b[3] - b[1])
        for j, c in enumerate(boxes):
            inside = c[0] >= b[0] - dy and c[1] >= b[1] - dx and c[2] <= b[2] + dy and c[3] <= b[3] + dx
            if j == k or area[j] < least or area[k] < area[j] * ratio or not inside:
                continue
            if masks is not None and iou(masks[k], masks[j]) >= same:
                continue
            own.append(j)
        if len(own) < children or not area[k]:
            out.append(False)
            continue
        y1, x1, y2, x2 = (f(boxes[j][i] for j in own) for i, f in enumerate((min, min, max, max)))
        spans = (y2 - y1) * (x2 - x1) / area[k]
        if masks is None:
            covered = np.zeros((b[2] - b[0], b[3] - b[1]), bool)
            for j in own:
                c = boxes[j]
                covered[max(0, c[0] - b[0]) : max(0, c[2] - b[0]), max(0, c[1] - b[1]) : max(0, c[3] - b[1])] = True
            covers = float(covered.mean())
        else:
            whole = box_of(masks[k])
            if len([m for m in components(masks[k])]) <= 1 and whole and (whole[2] - whole[0]) * (whole[3] - whole[1]) / area[k] >= fill:
                out.append(False)
                continue
            covers = int(np.logical_or.reduce([masks[j] for j in own]).sum()) / max(1, int(masks[k].sum()))
        out.append(spans >= span or covers >= union)
    return out


def posed(fragment: np.ndarray, anchor: np.ndarray, towards: np.ndarray, place: np.ndarray, direction: np.ndarray, bond: float, length: float) -> np.ndarray:
    """A fragment's points turned, scaled (0.15 to 5) and moved so that its attachment bond lies along
    the scaffold's (SP10)."""
    own = anchor - towards
    turn = np.arctan2(direction[1], direction[0]) - np.arctan2(own[1], own[0])
    scale = min(5.0, max(0.15, length / bond)) if bond > 0 else 1.0
    c, s = np.cos(turn), np.sin(turn)
    return (fragment - anchor) @ np.array([[c, s], [-s, c]]) * scale + place


#: The turns that are tried, in degrees and in order; earlier ones win ties.
TURNS = (0, 15, -15, 30, -30, 45, -45, 60, -60, 75, -75, 90, -90, 120, -120, 150, -150, 180)


def collision(scaffold: np.ndarray, fragment: np.ndarray, joint: int, anchor: int, bond: float) -> float:
    """How badly a fragment lies on a scaffold (SP10): ten for squared shortfalls of distances below
    0.55 bonds (the joint itself aside), one for each square bond that both boxes share, three for
    the bonds by which the fragment's middle fails to lie outward."""
    bond = max(bond, 1.0)
    least = 0.55 * bond
    far = np.sqrt(((scaffold[:, None] - fragment[None]) ** 2).sum(-1))
    short = np.clip(least - far, 0, None) / least
    short[joint, anchor] = 0
    sides = np.minimum(scaffold.max(0), fragment.max(0)) - np.maximum(scaffold.min(0), fragment.min(0))
    shared = float(np.clip(sides, 0, None).prod())
    out = fragment[anchor] - scaffold[joint]
    size = float(np.hypot(*out))
    out = out / size if size > 1e-9 else np.array([1.0, 0.0])
    reach = float(((fragment - scaffold[joint]) @ out).mean())
    return float(10 * (short**2).sum() + shared / bond**2 + 3 * max(0.0, 0.4 * bond - reach) / bond)


def best_turn(scaffold: np.ndarray, fragment: np.ndarray, joint: int, anchor: int, bond: float) -> tuple[int, float]:
    """(degrees, score) of the turn about the anchor with the least collision, wide turns at a small
    price."""
    best, least = 0, np.inf
    for degrees in TURNS:
        t = np.radians(degrees)
        r = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        score = collision(scaffold, (fragment - fragment[anchor]) @ r + fragment[anchor], joint, anchor, bond) + 0.015 * abs(t)
        if score < least - 1e-12:
            best, least = degrees, score
    return best, float(least)
