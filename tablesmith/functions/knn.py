"""Exact k nearest neighbours as a partitioned join.

Donors are split into cells around pivot points (Voronoi cells; see Lu, Shen, Chen, Ooi,
"Efficient processing of k nearest neighbor joins using MapReduce", 2012). A query first
visits the cells nearest to it, which bounds its k-th distance; it then visits only those
other cells that the triangle inequality cannot rule out. Cells and the queries sent to
them are cut into chunks of bounded size, so dense regions spread over many tasks; a task puts its donors into boxes of few
points and sees only those within a query's bound. Of donors
at the same point only the first k keys are kept, which cannot change any answer, and queries at the same point are searched once.
Tasks emit k rows per query, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .numbers import hash_key
from .schema import col

DONORS_PER_CELL = 2_000
MAX_PIVOTS = 4_096
DONORS_PER_CHUNK = 50_000
QUERIES_PER_CHUNK = 100_000
BLOCK = 4_000_000
LEAF = 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature (the order a SQL formula uses)."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        out += np.square(a[:, f][:, None] - b[:, f][None, :])
    return out


def _blocks(rows: int, width: int):
    step = max(1, BLOCK // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def _leaves(b: np.ndarray) -> list[np.ndarray]:
    """Positions of the points, cut at the middle of the widest feature until at most LEAF are left; each in rising order."""
    out, todo = [], [np.flatnonzero(np.isfinite(b).all(axis=1))]
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            if len(part):
                out.append(np.sort(part))
            continue
        widest = int(np.ptp(b[part], axis=0).argmax())
        order, half = np.argpartition(b[part, widest], len(part) // 2), len(part) // 2
        todo += [part[order[:half]], part[order[half:]]]
    return out


def _nearest(a: np.ndarray, b: np.ndarray, take: int, parts: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, donor, squared distance) of the ``take`` nearest by (distance, position), donors of a query's own part left out.

    Donors lie in boxes of few points. A query sees its boxes from the nearest on, until the next is farther than the last one it keeps; all queries
    do their first box, then their second and so on, so the work for a query does not grow with the donors.
    """
    leaves = _leaves(b)
    none = np.zeros(0, dtype=np.int64)
    if not leaves:
        return none, none, np.zeros(0)
    low, high = np.array([b[x].min(axis=0) for x in leaves]), np.array([b[x].max(axis=0) for x in leaves])
    found = []
    for block in _blocks(len(a), max(len(leaves), LEAF)):
        points = a[block]
        gap = np.zeros((len(points), len(leaves)))
        for f in range(a.shape[1]):  # as distances are added, so that rounding cannot lift a box above its points
            x = points[:, f][:, None]
            gap += np.square(np.maximum(np.maximum(low[:, f][None, :] - x, x - high[:, f][None, :]), 0.0))
        order = np.argsort(gap, axis=1, kind="stable")
        bound = np.full(len(points), np.inf)
        have = (none, none, np.zeros(0))
        open_ = np.arange(len(points))
        for turn in range(len(leaves)):
            box = order[open_, turn]
            near = gap[open_, box] <= bound[open_]
            open_, box = open_[near], box[near]  # boxes come in order: a query that is done stays done
            if not len(open_):
                break
            by = np.argsort(box, kind="stable")
            new = [have]
            for group in np.split(open_[by], np.flatnonzero(np.diff(box[by])) + 1):
                leaf = leaves[order[group[0], turn]]
                dist = _distances(points[group], b[leaf])
                if parts:
                    dist[parts[0][block][group][:, None] == parts[1][leaf][None, :]] = np.inf
                edge = bound[group]
                if len(leaf) > take:
                    edge = np.minimum(edge, np.partition(dist, take - 1, axis=1)[:, take - 1])
                at, pick = np.nonzero((dist <= edge[:, None]) & (dist < np.inf))
                new.append((group[at], leaf[pick], dist[at, pick]))
            at, pick, dist = (np.concatenate(x) for x in zip(*new))
            sort = np.lexsort((pick, dist, at))
            at, pick, dist = at[sort], pick[sort], dist[sort]
            starts = np.r_[0, np.flatnonzero(np.diff(at)) + 1] if len(at) else none
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            last = rank == take - 1
            bound[at[last]] = dist[last]
            kept = rank < take
            have = (at[kept], pick[kept], dist[kept])
            if turn >= 1:  # what belongs to queries that are done is put aside, so that later turns sort only what they change
                nexts = order[:, turn + 1] if turn + 1 < len(leaves) else None
                more = np.zeros(len(points), dtype=bool)
                if nexts is not None:
                    more[open_] = gap[open_, nexts[open_]] <= bound[open_]
                stays = more[have[0]]
                found.append((have[0][~stays] + block.start, have[1][~stays], have[2][~stays]))
                have = tuple(x[stays] for x in have)
        found.append((have[0] + block.start, have[1], have[2]))
    at, pick, dist = (np.concatenate(x) for x in zip(*found))
    return at, pick, dist


def knn_join(
    queries: DataFrame,
    donors: DataFrame,
    features: list[str],
    k: int,
    query_key: str,
    donor_key: str,
    payload: list[str] | None = None,
    exclude_self: bool = False,
    by: str | None = None,
    donors_per_cell: int | None = None,
    donors_per_chunk: int | None = None,
    queries_per_chunk: int | None = None,
    apart: str | None = None,
) -> DataFrame:
    """``(query_key, _rank, _donor, _distance, payload..)`` for ranks 1..k by (distance, donor key).

    ``by`` restricts neighbours to the same value of that column, ``apart`` to other values of one with few values, such as a fold (both
    are on both sides). Keys are bigints; rows with a NULL feature take no part.
    """
    payload = payload or []
    donors_per_cell = donors_per_cell or DONORS_PER_CELL
    donors_per_chunk = donors_per_chunk or DONORS_PER_CHUNK
    queries_per_chunk = queries_per_chunk or QUERIES_PER_CHUNK
    need = k + 1 if exclude_self else k
    xs = [f"_x{i}" for i in range(len(features))]
    whole = None
    for f in features:
        whole = col(f).isNotNull() if whole is None else whole & col(f).isNotNull()
    group = col(by).cast("string") if by else F.lit("")
    part = (F.coalesce(col(apart).cast("string"), F.lit("")) if apart else F.lit("")).alias("_f")
    feats = [col(f).cast("double").alias(x) for f, x in zip(features, xs)]
    q = queries.filter(whole).select(col(query_key).cast("long").alias("_q"), group.alias("_g"), part, *feats)
    d = donors.filter(whole).select(
        col(donor_key).cast("long").alias("_d"), group.alias("_g"), part, *feats, *[col(p) for p in payload]
    )
    same = Window.partitionBy("_g", "_f", *xs).orderBy("_d")
    # ranked once: counted, searched for pivots and located
    d = cut_lineage(d.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= need).drop("_copy"))
    at = ["_g", "_f", *xs]
    points = cut_lineage(q.select(*at).distinct())

    n_groups, n_donors = d.agg(F.count_distinct("_g"), F.count(F.lit(1))).first()
    if not n_donors:
        empty = ", ".join([f"`{query_key}` bigint", "_rank int", "_donor bigint", "_distance double"])
        extra = "".join(f", `{p}` {donors.schema[p].dataType.simpleString()}" for p in payload)
        return queries.sparkSession.createDataFrame([], empty + extra)
    pivots = _pivots(d, xs, int(n_groups), int(n_donors), donors_per_cell)
    located = _locate(d, pivots, xs, payload)
    if n_donors > donors_per_cell:
        # read by the cell statistics and by both rounds
        located = cut_lineage(located)
    many = points.count() > queries_per_chunk
    stats: dict[tuple, tuple[int, float]] = {}
    own: dict[tuple, int] = {}
    for r in located.groupBy("_g", "_cell", "_f").agg(F.count(F.lit(1)).alias("n"), F.max("_radius").alias("r")).collect():
        n, radius = stats.get((r["_g"], r["_cell"]), (0, 0.0))
        stats[r["_g"], r["_cell"]] = n + int(r["n"]), max(radius, float(r["r"]))
        own[r["_g"], r["_cell"], r["_f"]] = int(r["n"])
    cells = _Cells(pivots, stats, xs, need, donors_per_chunk, own if apart else {})
    donors_cut = located.withColumn("_chunk", F.pmod(F.xxhash64("_d"), _chunks(stats, donors_per_chunk))).drop("_radius")

    first = _visit(_route(points, cells, xs), donors_cut, xs, payload, need, queries_per_chunk if many else None, apart is not None)
    top = Window.partitionBy(*at).orderBy("_distance", "_donor")
    if len(stats) > 1:
        # The work of round one feeds both the bound of round two and the result.
        first = cut_lineage(first)
        ranked = first.withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= need)
        bound = ranked.groupBy(*at).agg(F.max(F.when(F.col("_rank") == need, F.col("_distance"))).alias("_bound"))
        second = _visit(
            _route(points.join(bound, at, "left"), cells, xs, bounded=True), donors_cut, xs, payload, need, queries_per_chunk if many else None, apart is not None
        )
        found = ranked.drop("_rank").unionByName(second)
    else:
        found = first
    near = found.withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= need).drop("_rank")
    found = q.join(near, at)
    if exclude_self:
        found = found.filter(F.col("_donor") != F.col("_q"))
    top = Window.partitionBy("_q").orderBy("_distance", "_donor")
    out = found.withColumn("_rank", F.row_number().over(top)).filter(F.col("_rank") <= k)
    return out.select(F.col("_q").alias(query_key), "_rank", "_donor", "_distance", *[col(p) for p in payload])


def _pivots(d: DataFrame, xs, n_groups: int, n_donors: int, donors_per_cell: int) -> dict[str, np.ndarray]:
    """Points drawn by hash, per group in equal number; at most MAX_PIVOTS in all (one per group at least)."""
    per_group = max(1, min(999, MAX_PIVOTS // n_groups, -(-n_donors // (donors_per_cell * n_groups))))
    spec = Window.partitionBy("_g").orderBy(hash_key(F.col("_d"), 7), "_d")
    rows = (
        d.select("_g", "_d", *xs)
        .withColumn("_i", F.row_number().over(spec))
        .filter(F.col("_i") <= per_group)
        .select("_g", *xs)
        .collect()
    )
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["_g"], []).append([r[x] for x in xs])
    return {g: np.array(sorted(points)) for g, points in out.items()}


def _locate(d: DataFrame, pivots, xs, payload) -> DataFrame:
    schema = T.StructType([*d.schema.fields, T.StructField("_cell", T.LongType()), T.StructField("_radius", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            cell, radius = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf))
            for g, index in pdf.groupby("_g").indices.items():
                points = pdf[xs].to_numpy(dtype=float)[index]
                for part in _blocks(len(points), len(pivots[g])):
                    dist = _distances(points[part], pivots[g])
                    nearest = dist.argmin(axis=1)
                    cell[index[part]] = nearest
                    radius[index[part]] = np.sqrt(dist[np.arange(len(nearest)), nearest])
            yield pdf.assign(_cell=cell, _radius=radius)

    return d.mapInPandas(run, schema)


def _chunks(stats, donors_per_chunk: int):
    """Number of donor chunks of the row's cell, as a column."""
    big = {key: -(-n // donors_per_chunk) for key, (n, _) in stats.items() if n > donors_per_chunk}
    out = F.lit(1)
    for (g, cell), parts in big.items():
        out = F.when((F.col("_g") == g) & (F.col("_cell") == cell), F.lit(parts)).otherwise(out)
    return out.cast("long")


class _Cells:
    """Which cells a query must visit. Holds at most MAX_PIVOTS cells."""

    def __init__(self, pivots, stats, xs, need, donors_per_chunk, own):
        self.pivots = pivots
        #: donors of a cell that a query of the same part leaves out
        self.own = {
            (g, f): np.array([own.get((g, j, f), 0) for j in range(len(p))]) for g, p in pivots.items() for f in {k[2] for k in own if k[0] == g}
        }
        self.xs = xs
        self.need = need
        self.count = {g: np.array([stats.get((g, j), (0, 0.0))[0] for j in range(len(p))]) for g, p in pivots.items()}
        self.radius = {g: np.array([stats.get((g, j), (0, 0.0))[1] for j in range(len(p))]) for g, p in pivots.items()}
        self.parts = {g: -(-c // donors_per_chunk) for g, c in self.count.items()}

    def _home(self, g: str, dist: np.ndarray, parts: np.ndarray) -> np.ndarray:
        order = np.argsort(dist, axis=1, kind="stable")
        usable = np.tile(self.count[g], (len(dist), 1))
        for f in set(parts.tolist()):
            if (g, f) in self.own:
                usable[parts == f] -= self.own[g, f]
        usable = np.take_along_axis(usable, order, axis=1)
        home = np.zeros(dist.shape, dtype=bool)
        np.put_along_axis(home, order, (np.cumsum(usable, axis=1) - usable) < self.need, axis=1)
        return home

    def visits(self, g: str, points: np.ndarray, bound: np.ndarray | None, parts: np.ndarray):
        """Boolean (query, cell): the nearest cells holding enough donors, or the rest within the bound."""
        dist = np.sqrt(_distances(points, self.pivots[g]))
        first = dist.argmin(axis=1)
        usable = self.count[g][first]
        for f in set(parts.tolist()):
            if (g, f) in self.own:
                here = parts == f
                usable[here] -= self.own[g, f][first[here]]
        home = np.zeros(dist.shape, dtype=bool)
        home[np.arange(len(points)), first] = True
        few = np.flatnonzero(usable < self.need)  # the nearest cell does not hold enough: all are ordered
        if len(few):
            home[few] = self._home(g, dist[few], parts[few])
        occupied = self.count[g][None, :] > 0
        if bound is None:
            return home & occupied
        least = np.maximum(dist - self.radius[g][None, :], (dist - dist.min(axis=1)[:, None]) / 2)
        reach = np.where(np.isnan(bound), np.inf, bound)[:, None]
        return ~home & occupied & (least <= reach * (1 + 1e-9) + 1e-12)


def _route(q: DataFrame, cells: _Cells, xs, bounded: bool = False) -> DataFrame:
    fields = [f for f in q.schema.fields if f.name != "_bound"]
    schema = T.StructType([*fields, T.StructField("_cell", T.LongType()), T.StructField("_chunk", T.LongType())])

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for g, index in pdf.groupby("_g").indices.items():
                if g not in cells.pivots:
                    continue
                rows = pdf.iloc[index].reset_index(drop=True)
                points = rows[xs].to_numpy(dtype=float)
                for part in _blocks(len(points), len(cells.pivots[g])):
                    bound = rows["_bound"].to_numpy(dtype=float)[part] if bounded else None
                    at, cell = np.nonzero(cells.visits(g, points[part], bound, rows["_f"].to_numpy()[part]))
                    parts = cells.parts[g][cell]
                    at, cell = np.repeat(at, parts), np.repeat(cell, parts)
                    first = np.repeat(np.cumsum(parts) - parts, parts)
                    out = rows.iloc[at + part.start].drop(columns="_bound", errors="ignore")
                    yield out.assign(_cell=cell, _chunk=np.arange(len(at)) - first)

    return q.mapInPandas(run, schema)


def _visit(routed: DataFrame, donors: DataFrame, xs, payload, need: int, queries_per_chunk: int | None, apart: bool = False) -> DataFrame:
    """Searches every (cell, donor chunk, query chunk) on its own. No limit: so few queries that no chunk can be too large."""
    place = ["_g", "_cell", "_chunk"]
    hot = []
    if queries_per_chunk:
        sizes = routed.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
        # at most one row per (cell, donor chunk) with more than queries_per_chunk queries
        hot = sizes.filter(F.col("n") > queries_per_chunk).collect()
    salts_q = F.lit(1)
    for r in hot:
        here = (F.col("_g") == r["_g"]) & (F.col("_cell") == r["_cell"]) & (F.col("_chunk") == r["_chunk"])
        salts_q = F.when(here, F.lit(-(-r["n"] // queries_per_chunk))).otherwise(salts_q)
    at = ["_g", "_f", *xs]
    left = routed.withColumn("_salt", F.pmod(F.xxhash64(*at), salts_q.cast("long")))
    right = donors.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts_q.cast("long") - 1)))
    fields = [T.StructField("_donor", T.LongType()), T.StructField("_distance", T.DoubleType())]
    schema = T.StructType([*[routed.schema[c] for c in at], *fields, *[donors.schema[p] for p in payload]])

    def nothing() -> pd.DataFrame:
        kinds = {"string": "str", "double": "float64", "float": "float32", "int": "int32", "boolean": "bool"}
        return pd.DataFrame(
            {f.name: np.array([], dtype=object if isinstance(f.dataType, T.StringType) else kinds.get(f.dataType.simpleString(), "int64")) for f in schema.fields}
        )

    def search(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ds):
            return nothing()
        # in key order, so that the smaller position wins a tie
        ds = ds.sort_values("_d", kind="stable").reset_index(drop=True)
        a, b = qs[xs].to_numpy(dtype=float), ds[xs].to_numpy(dtype=float)
        parts = (qs["_f"].to_numpy(), ds["_f"].to_numpy()) if apart else None
        asked, pick, dist = _nearest(a, b, need, parts)
        out = {**{c: qs[c].to_numpy()[asked] for c in at}, "_donor": ds["_d"].to_numpy()[pick], "_distance": np.sqrt(dist)}
        return pd.DataFrame({**out, **{p: ds[p].to_numpy()[pick] for p in payload}})

    keys = [*place, "_salt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)
