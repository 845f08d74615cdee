"""Near-duplicate vectors by NN-descent.

Equal vectors are one vector with a weight.  Each keeps a list of its nearest neighbours found so
far (those with a cosine of at least ``threshold - MARGIN``).  Vectors meet first in groups of
equal signs under random hyperplanes; there are as many tables of them as a pair that is just at
the threshold needs to share a group in one of them but for a chance of ``MISS``, so pairs without
other neighbours are found in a table of any size.  A group is compared whole, by tiles, and gives
a spanning forest of its links next to the lists, so that no full list can hide a link between two
groups.  The lists are then refined: for every vector, its neighbours and those that have it as a
neighbour are compared with each other (neighbours of neighbours), and better ones are kept, until
a round adds hardly any.

The connected parts of lists and forests bound where links can be, so the links are then taken
inside each part, exactly and in double precision, by tiles: a pair of tiles gives a count for each
vector and a spanning forest of the links, never the pairs themselves.

All vectors are compared with all, by the same tiles, where the groups would compare several times
as many pairs, and where the audit asks for it: it compares fixed rows with all rows and takes the mean share of
links found for each row, apart for rows with few and with many of them; below ``RECALL`` the
search is given up for the exact comparison.

Cases: vectors that are null, empty or zero or hold null or non-finite components link with nothing;
vectors of different lengths never link, and those of other lengths than the commonest are compared
with all of their own length; equal vectors link with cosine one; rows with one
vec_id are separate rows of one vector id; an empty table gives no row; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finished, materialise, ship_code
from .components import connected_components, forest

MARGIN = 0.1
NEIGHBOURS = 12
GROWN = 48
GROUP = 2048  #: vectors of a group, about
TILE = 2048
MISS = 0.001  #: chance that a pair at the threshold shares no group
SAMPLE = 1024  #: vectors of the audit, of either kind,
ENOUGH = 32  #: and more until so many of them have links,
AUDIT = 8192  #: or these are compared
RECALL = 0.99
WASTE = 4  #: times all pairs that the groups may compare; beyond it their signs tell vectors too little apart


def unit(values) -> np.ndarray | None:
    """The vector at length one in double precision; None if it can link with nothing."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, unit as bytes) of every vector; the bytes are null for those out of play."""
    ship_code(vectors.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for pdf in frames:
            made = [unit(v) for v in pdf["v"]]
            out = pd.DataFrame({"row": np.arange(first, first + len(pdf)), "vec_id": pdf["vec_id"].astype("Int64"), "unit": [None if u is None else u.tobytes() for u in made]})
            first += len(pdf)
            yield out

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInPandas(run, "row long, vec_id long, unit binary")


def _matrix(cells) -> np.ndarray:
    return np.stack([np.frombuffer(bytes(c), np.float64) for c in cells])


def _best(rows: np.ndarray, x: np.ndarray, least: float, keep: int) -> pd.DataFrame:
    """For each of the vectors, its nearest among the others with at least that cosine."""
    out = []
    for k in range(0, len(rows), 256):
        sims = x[k : k + 256] @ x.T
        sims[np.arange(len(sims)), np.arange(k, k + len(sims))] = -2
        if sims.shape[1] > keep:
            part = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        else:
            part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
        found = np.take_along_axis(sims, part, 1)
        i, j = np.nonzero(found >= least)
        out.append(pd.DataFrame({"u": rows[i + k], "v": rows[part[i, j]], "sim": found[i, j]}))
    return pd.concat(out)


def tables_for(count: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes of a table, and tables."""
    bits = max(0, int(np.log2(max(count, 1) / GROUP)))
    shared = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return bits, 1 if shared >= 1 - MISS else int(np.ceil(np.log(MISS) / np.log1p(-shared)))


def _buckets(units_: DataFrame, bits: int, tables: int) -> DataFrame:
    """(row, root): the groups of equal signs of each row, one for each table."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = _matrix(pdf["unit"])
                for table in range(tables):
                    planes = np.random.default_rng(1000 + table).standard_normal((x.shape[1], bits))
                    yield pd.DataFrame({"row": pdf["row"], "root": (x @ planes > 0) @ (1 << np.arange(bits)) + (table << 40)})

    return materialise(units_.select("row", "unit").mapInPandas(keys, "row long, root long"), "buckets")


def _top(edges: DataFrame, threshold: float) -> DataFrame:
    """Each vector's list: NEIGHBOURS of them, or GROWN where the list is full of links."""
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("place", F.row_number().over(w))
    return ranked.where((F.col("place") <= NEIGHBOURS) | (F.col("sim") >= threshold) & (F.col("place") <= GROWN)).drop("place")


def _descend(graph: DataFrame, units_: DataFrame, least: float, threshold: float, rounds: int) -> DataFrame:
    """Rounds of neighbours-of-neighbours until one adds less than a thousandth."""
    size = graph.count()

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("v")
        return _best(pdf["v"].to_numpy(), _matrix(pdf["unit"]), least, NEIGHBOURS)

    for _ in range(rounds):
        if not size:
            break
        both = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        both = both.unionByName(both.select("u", F.col("u").alias("v")).distinct())
        # a vector that very many have as neighbour is met in parts, told apart before vectors are loaded
        sizes = both.groupBy("u").agg(F.ceil(F.count("*") / F.lit(4 * GROWN)).alias("parts"))
        parted = both.join(sizes, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"))
        wide = parted.join(units_.select(F.col("row").alias("v"), "unit"), "v")
        found = wide.groupBy("u", "part").applyInPandas(local, "u long, v long, sim double")
        graph = materialise(_top(graph.unionByName(found), threshold), "graph")
        before, size = size, graph.count()
        if size - before < before / 1000:
            break
    return graph


def _exact(parts: DataFrame, threshold: float, least: float | None = None) -> DataFrame:
    """(row, n, other, sim) of all pairs within each part, by tiles: how many links a row has,
    forest edges of the links (n null), and given ``least``, lists of nearest neighbours (with
    sim).  parts: (row, unit, weight, root)."""
    sizes = parts.groupBy("root").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("tiles"))
    tiled = parts.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("row", F.lit(3)), F.col("tiles")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [pdf["row"].to_numpy(np.int64).tobytes(), pdf["weight"].to_numpy(np.int64).tobytes(), b"".join(map(bytes, pdf["unit"]))]
        return pd.DataFrame([(pdf["root"].iloc[0], pdf["tile"].iloc[0], *cells)], columns=["root", "tile", "rows", "weights", "units"])

    tiles = tiled.select("root", "tile", "row", "weight", "unit").groupBy("root", "tile").applyInPandas(pack, "root long, tile long, rows binary, weights binary, units binary")
    tiles = materialise(tiles, "vector-tiles")
    cells = F.struct("rows", "weights", "units")
    right = tiles.select("root", F.col("tile").alias("other"), cells.alias("right"))
    pairs = tiles.select("root", "tile", cells.alias("left")).join(right, "root").where("tile <= other")
    pairs = pairs.select("left.*", *[F.col(f"right.{c}").alias(f"right_{c}") for c in ("rows", "weights", "units")], (F.col("tile") == F.col("other")).alias("same"))

    def frame(rows, n=None, other=None, sim=None) -> pd.DataFrame:
        gaps = [None] * len(rows)
        return pd.DataFrame({"row": rows, "n": pd.array(gaps if n is None else n, "Int64"), "other": pd.array(gaps if other is None else other, "Int64"), "sim": np.full(len(rows), np.nan) if sim is None else sim})

    def nearest(sims: np.ndarray, rows: np.ndarray, others: np.ndarray) -> pd.DataFrame:
        some = np.flatnonzero((sims >= least).any(1))
        rows, sims = rows[some], sims[some]
        keep = min(NEIGHBOURS, sims.shape[1])
        part = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        found = np.take_along_axis(sims, part, 1)
        i, j = np.nonzero(found >= least)
        return frame(rows[i], other=others[part[i, j]], sim=found[i, j])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples():
                a, b, v, w = (np.frombuffer(bytes(c), np.int64) for c in (t.rows, t.right_rows, t.weights, t.right_weights))
                x, y = (np.frombuffer(bytes(c), np.float64).reshape(len(r), -1) for c, r in ((t.units, a), (t.right_units, b)))
                sims = x @ y.T
                if t.same:
                    np.fill_diagonal(sims, -2)
                near = sims >= threshold
                if near.any() and least is None:
                    counts = [(a, near @ w)] if t.same else [(a, near @ w), (b, v @ near)]
                    for rows, n in counts:
                        yield frame(rows[n > 0], n=n[n > 0])
                if near.any():
                    i, j = np.nonzero(np.triu(near) if t.same else near)
                    nodes = a if t.same else np.concatenate([a, b])
                    j = j if t.same else j + len(a)
                    if len(i) >= len(nodes):
                        i, j = forest(i, j, len(nodes))
                    yield frame(nodes[i], other=nodes[j])
                if least is not None and (sims >= least).any():
                    yield nearest(sims, a, b)
                    if not t.same:
                        yield nearest(sims.T, b, a)

    return materialise(pairs.mapInPandas(run, "row long, n long, other long, sim double"), "links")


def _counts(links: DataFrame) -> DataFrame:
    return links.where("n IS NOT NULL").groupBy("row").agg(F.sum("n").alias("n_links"))


def recall(units_: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Mean share of its true links that a row was given, over fixed rows that have some: the
    lower of the means for rows with few links or none and for those with more.  units_: (row,
    unit, weight)."""
    found = units_.join(counts, "row", "left").withColumn("n", F.coalesce("n_links", F.lit(0)))
    lowest = 1.0
    for kind in (F.col("n") <= NEIGHBOURS, F.col("n") > NEIGHBOURS):
        size = SAMPLE
        while True:
            got = found.where(kind).orderBy(F.xxhash64("row"), "row").limit(size).select("row", "unit", "n").collect()  # AUDIT rows at most
            if not got:
                break
            rows, x, n = np.array([r["row"] for r in got]), _matrix([r["unit"] for r in got]), np.array([r["n"] for r in got])

            def run(frames: Iterator[pd.DataFrame], rows=rows, x=x) -> Iterator[pd.DataFrame]:
                true = np.zeros(len(rows), np.int64)
                for pdf in frames:
                    for k in range(0, len(pdf), TILE):
                        some = pdf[k : k + TILE]
                        near = x @ _matrix(some["unit"]).T >= threshold
                        near &= rows[:, None] != some["row"].to_numpy()[None, :]
                        true += near @ some["weight"].to_numpy()
                at = np.flatnonzero(true)
                yield pd.DataFrame({"at": at, "n": true[at]})

            sums = units_.select("row", "unit", "weight").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
            if len(sums) >= ENOUGH or size >= AUDIT or len(got) < size:
                break
            size *= 2
        if got and sums:
            lowest = min(lowest, float(np.mean([min(1.0, n[r["at"]] / r["n"]) for r in sums])))
    return lowest


def _searched(live: DataFrame, buckets: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """Links, from lists and forests of the groups, descent, and exact counting in the parts."""
    least = threshold - MARGIN
    found = _exact(buckets.join(live, "row"), threshold, least)
    graph = found.where("sim IS NOT NULL AND NOT isnan(sim)").select(F.col("row").alias("u"), F.col("other").alias("v"), "sim")
    graph = _descend(materialise(_top(graph, threshold), "graph"), live, least, threshold, rounds)
    bonds = found.where("sim IS NULL OR isnan(sim)").select(F.col("row").alias("u"), F.col("other").alias("v"))
    parts = connected_components(graph.select("u", "v").unionByName(bonds), "u", "v")
    return _exact(parts.join(live, parts["node"] == live["row"]).select("row", "unit", "weight", "root"), threshold)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row, and the recall that the audit measured for
    the whole table (1 where all vectors were compared)."""
    return finished("near-vectors", lambda: _near_duplicates(vectors, threshold, rounds, id_col, vector_col))


def _near_duplicates(vectors: DataFrame, threshold: float, rounds: int, id_col: str, vector_col: str) -> DataFrame:
    whole = materialise(units(vectors, id_col, vector_col), "units")
    reps = whole.where("unit IS NOT NULL").groupBy("unit").agg(F.min("row").alias("row"), F.count("*").alias("weight"), F.min("vec_id").alias("low_id"))
    reps = materialise(reps, "distinct-units")
    # the commonest length is searched; vectors of any other length are compared with all of theirs
    length = reps.groupBy(F.length("unit").alias("n")).count().orderBy(F.desc("count"), "n").first()
    common = F.length("unit") == (length["n"] if length else 0)
    live = reps.where(common).select("row", "unit", "weight")
    odd = reps.where(~common).select("row", "unit", "weight", F.length("unit").cast("long").alias("root"))
    count = live.count()
    bits, tables = tables_for(count, threshold)
    buckets = _buckets(live, bits, tables)
    met = buckets.groupBy("root").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    links, measured = None, 1.0
    if met <= WASTE * float(count) ** 2:
        links = _searched(live, buckets, threshold, rounds)
        measured = recall(live, _counts(links), threshold)
        if measured < RECALL:
            links, measured = None, 1.0
    if links is None:
        links = _exact(live.withColumn("root", F.lit(0).cast("long")), threshold)
    if not odd.isEmpty():
        links = links.unionByName(_exact(odd, threshold))
    roots = connected_components(links.where("other IS NOT NULL"), "row", "other").withColumnRenamed("node", "row")
    lowest = roots.join(reps, "row").groupBy("root").agg(F.min("low_id").alias("component_id"))
    member = reps.join(roots.join(lowest, "root"), "row", "left").join(_counts(links), "row", "left")
    member = member.select("unit", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "low_id").alias("component_id"))
    out = whole.join(member, "unit", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("recall", F.lit(measured))
