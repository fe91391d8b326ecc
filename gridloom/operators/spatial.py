"""Points in space: range and nearest-neighbour joins over hashed cells, centroids, mean shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.operators.skew import BROADCAST_BYTES
from gridloom.session import materialize

#: Edge of a cell in radii. Larger cells mean fewer copies of the left points and more candidates a point.
CELL_RADII = 2
#: What a point holds at most where a counted side is broadcast.
POINT_BYTES = 160
#: Levels by which cells of a descent are halved at most; beyond them coordinates have no more digits.
MOST_LEVELS = 60


def _cells(axes: Sequence[str], size: float, radius: float) -> Column:
    """Cells that the box of half edge ``radius`` around a point touches, as an array of structs c0, c1, ..."""

    def widen(arrays: Column, k: int, span: Column) -> Column:
        def one(s: Column) -> Column:
            return F.transform(span, lambda c: F.struct(*[s[f"c{i}"].alias(f"c{i}") for i in range(k)], c.alias(f"c{k}")))

        return F.flatten(F.transform(arrays, one))

    arrays = None
    for k, a in enumerate(axes):
        span = F.sequence(F.floor((F.col(a) - radius) / F.lit(size)).cast("long"), F.floor((F.col(a) + radius) / F.lit(size)).cast("long"))
        arrays = F.transform(span, lambda c: F.struct(c.alias("c0"))) if arrays is None else widen(arrays, k, span)
    return arrays


def _square(axes: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for a in axes:
        d = F.col(f"l.{a}") - F.col(f"r.{a}")
        total = total + d * d
    return total


def range_join(
    left: DataFrame, right: DataFrame, axes: Sequence[str], radius: float, keys: Sequence[str] = (), condition: Column | None = None,
    right_rows: int | None = None
) -> DataFrame:
    """Pairs within ``radius`` (included) and equal keys, as columns l and r (structs) and distance.

    Cells have an edge of CELL_RADII radii. Left points go to the cells that their box touches (at most two an axis), right
    points to their own; the equi-join on key and cell spreads even one key over as many tasks as it has cells, and AQE splits
    what is left of skew by the measured sizes. A right side counted by the caller (``right_rows``) may be broadcast. Points
    with null coordinates or keys pair with none.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    edge = CELL_RADII * radius
    ks = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull()
    a = left.where(ok).select(F.struct(*left.columns).alias("l"), *ks, F.explode(_cells(axes, edge, radius)).alias("__c"))
    b = right.where(ok).select(
        F.struct(*right.columns).alias("r"), *ks,
        F.struct(*[F.floor(F.col(x) / F.lit(edge)).cast("long").alias(f"c{i}") for i, x in enumerate(axes)]).alias("__c")
    )
    cells = [f"c{i}" for i in range(len(axes))]
    a = a.select("l", *names, *[F.col(f"__c.{c}").alias(f"__{c}") for c in cells])
    b = b.select("r", *names, *[F.col(f"__c.{c}").alias(f"__{c}") for c in cells])
    # what explode adds isn't in the optimizer's estimate, so only a counted side is broadcast
    small = right_rows is not None and right_rows * POINT_BYTES <= BROADCAST_BYTES
    j = a.join(F.broadcast(b) if small else b.hint("merge"), [*names, *[f"__{c}" for c in cells]])
    if condition is not None:
        j = j.where(condition)
    d2 = _square(axes)
    return j.where(d2 <= radius * radius).select("l", "r", F.sqrt(d2).alias("distance"))


def neighbour_counts(points: DataFrame, point_id: str, axes: Sequence[str], radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points within ``radius`` of each point, itself included: point_id, n_neighbours. Null coordinates: none."""
    j = range_join(points.select(point_id, *keys, *axes), points.select(*keys, *axes), axes, radius, keys)
    n = j.groupBy(F.col(f"l.{point_id}").alias(point_id)).agg(F.count(F.lit(1)).alias("n"))
    return points.select(point_id).join(n, point_id, "left").select(point_id, F.coalesce("n", F.lit(0)).cast("long").alias("n_neighbours"))


def nearest(
    queries: DataFrame, points: DataFrame, query_id: str, point_id: str, axes: Sequence[str], k: int, cell: float, max_rings: int = 3
) -> DataFrame:
    """The k nearest points of each query, ascending, ties by point id: query_id, point_id, distance, rank. Exact.

    Cells are hashed; the first round looks one cell around each query and is final for those whose k-th distance is within
    the reach; for the rest the reach doubles. Queries that ``max_rings`` rounds don't settle (far from most points, or in
    sparse places) descend a hierarchy of cells: see _descend(). With fewer than k points all are returned. Rows with null
    coordinates take no part. Runs jobs.
    """
    q, p = queries.select(F.col(query_id).alias("q"), *axes), points.select(F.col(point_id).alias("p"), *axes)
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull()
    q, p = q.where(ok), p.where(ok)
    top = W.partitionBy("q").orderBy("distance", "p")
    n_points, done, reach = p.count(), None, cell
    for _ in range(max_rings if n_points >= k else 0):
        got = range_join(q, p, axes, reach, right_rows=n_points).select(F.col("l.q").alias("q"), F.col("r.p").alias("p"), "distance")
        best = got.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        full = materialize(best.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("q"))).where(F.col("n") == k).drop("n"))
        done = full if done is None else done.unionAll(full)
        q = materialize(q.join(full.select("q").distinct(), "q", "left_anti"))
        if q.isEmpty():
            break
        reach *= 2
    else:
        found = _descend(q, p, axes, k, cell)
        rest = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        done = rest if done is None else done.unionAll(rest)
    return done.select(
        F.col("q").alias(query_id), F.col("p").alias(point_id + "_near" if point_id == query_id else point_id), "distance", "rank"
    )


def _descend(q: DataFrame, p: DataFrame, axes: Sequence[str], k: int, leaf: float) -> DataFrame:
    """q, p, distance of all points that can be among the k nearest of a query, and few others.

    The occupied cells of edge ``leaf`` and the counts of the cells of twice, four times ... their edge that hold them form a
    tree. Every query starts at the cell that holds all points and goes down level by level: a cell is kept if its least
    possible distance isn't above the distance within which cells known to it hold k points. So a query keeps about the cells
    of its k nearest points at each level, however far away or unevenly spread they are, and is compared with the points of
    its last cells only.
    """
    cells = [f"c{i}" for i in range(len(axes))]
    at = lambda x, size: F.floor(F.col(x) / F.lit(size)).cast("long")
    points = materialize(p.select("*", *[at(a, leaf).alias(c) for a, c in zip(axes, cells)]))
    levels = [materialize(points.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")))]
    if levels[0].isEmpty():
        return p.limit(0).select(F.lit(None).cast(q.schema["q"].dataType).alias("q"), "p", F.lit(0.0).alias("distance"))
    while len(levels) < MOST_LEVELS and levels[-1].count() > 1 << len(axes):
        up = levels[-1].select(*[F.floor(F.col(c) / 2).cast("long").alias(c) for c in cells], "n")
        levels.append(materialize(up.groupBy(*cells).agg(F.sum("n").alias("n"))))
    # the highest level has at most 2 ** axes cells (some more if the levels ended), with which every query starts
    top = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in (*cells, "n")]) for r in levels[-1].collect()])
    kept = q.withColumn("__top", F.explode(top)).select(*q.columns, "__top.*")
    for level in range(len(levels) - 1, -1, -1):
        edge = leaf * 2.0**level
        low = high = F.lit(0.0)
        for a, c in zip(axes, cells):
            near, far = F.col(c) * F.lit(edge) - F.col(a), (F.col(c) + 1) * F.lit(edge) - F.col(a)
            gap = F.greatest(near, -far, F.lit(0.0))
            low = low + gap * gap
            reach = F.greatest(F.abs(near), F.abs(far))
            high = high + reach * reach
        bounds = kept.select("q", *axes, *cells, "n", low.alias("low"), high.alias("high"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("q").orderBy("high", *cells).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        limit = F.min(F.when(F.col("before") + F.col("n") >= k, F.col("high"))).over(W.partitionBy("q"))
        # a hair of slack for the rounding of the bounds
        good = bounds.withColumn("before", before).withColumn("limit", limit).where(
            F.col("limit").isNull() | (F.col("low") <= F.col("limit") * (1 + 1e-9))
        )
        good = materialize(good.select("q", *axes, *cells))
        if level:
            below = levels[level - 1].select(
                *[F.col(c).alias(f"d{i}") for i, c in enumerate(cells)], *[F.floor(F.col(c) / 2).cast("long").alias(c) for c in cells], "n"
            )
            kept = good.join(below, cells).select("q", *axes, *[F.col(f"d{i}").alias(c) for i, c in enumerate(cells)], "n")
    a = good.select(F.struct("q", *axes).alias("l"), *cells)
    b = points.select(F.struct("p", *axes).alias("r"), *cells)
    return a.join(b, cells).select(F.col("l.q").alias("q"), F.col("r.p").alias("p"), F.sqrt(_square(axes)).alias("distance"))


def quantized_distinct(points: DataFrame, axes: Sequence[str], step: float) -> DataFrame:
    """One point for each occupied cube of edge ``step``, at the cube's lower corner."""
    return points.select(*[(F.floor(F.col(a) / F.lit(step)) * F.lit(step)).alias(a) for a in axes]).distinct()


def weighted_centroids(pairs: DataFrame, group: str, axes: Sequence[str], value: str, power: float, at: Sequence[str]) -> DataFrame:
    """Mean position of each group weighted by value^power; values that aren't positive weigh nothing, and a group without
    weight keeps the position in its columns ``at``."""
    w = F.when(F.col(value) > 0, F.pow(F.col(value), F.lit(float(power)))).otherwise(0.0)
    s = pairs.withColumn("__w", w).groupBy(group).agg(
        F.sum("__w").alias("__w"), *[F.sum(F.col("__w") * F.col(a)).alias(f"__s{i}") for i, a in enumerate(axes)],
        *[F.first(c).alias(f"__p{i}") for i, c in enumerate(at)]
    )
    return s.select(
        group, *[F.when(F.col("__w") > 0, F.col(f"__s{i}") / F.col("__w")).otherwise(F.col(f"__p{i}")).alias(a) for i, a in enumerate(axes)]
    )


def mean_shift(
    start: DataFrame, voxels: DataFrame, point_id: str, axes: Sequence[str], value: str, radius: float, power: float = 1.0, rounds: int = 15
) -> DataFrame:
    """Every start point moved ``rounds`` times to the weighted centroid of the fixed voxels within ``radius``.

    The voxels never move; each round is a cell join and a combined sum, and its result is written so that the lineage
    doesn't grow. A point without voxels in reach stays.
    """
    at = start.select(point_id, *axes)
    for _ in range(rounds):
        j = range_join(at, voxels.select(*axes, value), axes, radius).select(
            F.col(f"l.{point_id}").alias(point_id), *[F.col(f"r.{a}").alias(a) for a in axes], F.col(f"r.{value}").alias(value),
            *[F.col(f"l.{a}").alias(f"__at{i}") for i, a in enumerate(axes)]
        )
        moved = weighted_centroids(j, point_id, axes, value, power, [f"__at{i}" for i in range(len(axes))])
        m = moved.select(F.col(point_id), *[F.col(a).alias(f"__m{i}") for i, a in enumerate(axes)])
        at = materialize(at.join(m, point_id, "left").select(point_id, *[F.coalesce(f"__m{i}", a).alias(a) for i, a in enumerate(axes)]))
    return at


def mean_shift_nearest(
    start: DataFrame, voxels: DataFrame, point_id: str, axes: Sequence[str], value: str, cell: float, k: int = 20, power: float = 1.0,
    rounds: int = 15
) -> DataFrame:
    """Every start point moved ``rounds`` times to the centroid, weighted by value^power, of its ``k`` nearest fixed voxels.

    ``voxels`` has ``point_id`` too, which decides ties; with fewer than k voxels all are taken. ``cell`` is the reach that the
    search starts with and has no influence on the result. A point whose neighbours have no positive value stays. Each round
    is a job of nearest(), whose result is joined to the voxels by id, and is written so that the lineage doesn't grow.
    """
    names = [f"__v{i}" for i in range(len(axes))]
    ok = F.lit(True)
    for a in axes:
        ok = ok & F.col(a).isNotNull()
    fixed = materialize(voxels.where(ok).select(F.col(point_id).alias("__near"), *axes, F.col(value).alias("__value")))
    k = min(k, fixed.count())
    at = start.select(point_id, *axes)
    if not k:
        return at
    v = fixed.select("__near", *[F.col(a).alias(n) for a, n in zip(axes, names)], "__value")
    for _ in range(rounds):
        near = nearest(at, fixed, point_id, "__near", axes, k, cell)
        j = near.select(point_id, "__near").join(v, "__near").join(at, point_id)
        j = j.select(
            point_id, F.col("__value"), *[F.col(a).alias(f"__at{i}") for i, a in enumerate(axes)],
            *[F.col(n).alias(a) for a, n in zip(axes, names)]
        )
        moved = weighted_centroids(j, point_id, axes, "__value", power, [f"__at{i}" for i in range(len(axes))])
        m = moved.select(point_id, *[F.col(a).alias(f"__m{i}") for i, a in enumerate(axes)])
        at = materialize(at.join(m, point_id, "left").select(point_id, *[F.coalesce(f"__m{i}", a).alias(a) for i, a in enumerate(axes)]))
    return at


def edge_geometry(
    bonds: DataFrame, atoms: DataFrame, keys: Sequence[str], axes: Sequence[str], serial: str = "serial_id",
    ends: tuple[str, str] = ("atom_serial_id_1", "atom_serial_id_2")
) -> DataFrame:
    """Bonds with both atoms: mid_a, vec_a, unit_a for each axis and length; the unit vector is 0 for length 0."""
    one = atoms.select(*keys, F.col(serial).alias(ends[0]), *[F.col(a).alias(f"__1{a}") for a in axes])
    two = atoms.select(*keys, F.col(serial).alias(ends[1]), *[F.col(a).alias(f"__2{a}") for a in axes])
    j = bonds.join(one, [*keys, ends[0]]).join(two, [*keys, ends[1]])
    length = F.lit(0.0)
    for a in axes:
        d = F.col(f"__2{a}") - F.col(f"__1{a}")
        length = length + d * d
    j = j.withColumn("length", F.sqrt(length))
    out = [F.col(c) for c in bonds.columns] + [F.col("length")]
    for a in axes:
        v = F.col(f"__2{a}") - F.col(f"__1{a}")
        out += [
            ((F.col(f"__1{a}") + F.col(f"__2{a}")) / 2).alias(f"mid_{a}"), v.alias(f"vec_{a}"),
            F.when(F.col("length") > 0, v / F.col("length")).otherwise(0.0).alias(f"unit_{a}")
        ]
    return j.select(*out)


def adjacency(bonds: DataFrame, keys: Sequence[str], ends: tuple[str, str] = ("atom_serial_id_1", "atom_serial_id_2")) -> DataFrame:
    """One row for each end of each bond: keys, serial_id, other_id; a bond between the same atom gives one."""
    a, b = ends
    one = bonds.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return one.select(*keys, F.col(a).alias("serial_id"), F.col(b).alias("other_id")).unionAll(
        one.where(F.col(a) != F.col(b)).select(*keys, F.col(b), F.col(a))
    )
