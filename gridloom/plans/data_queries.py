"""Queries of statistics, selections, grids, points, lookups and sequences, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import keys, potential, strings
from gridloom.operators import grid, lookup, ordering, reports, select, spatial, stats
from gridloom.session import materialize, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


# statistics


@query(
    "select l_returnflag, l_linestatus, count(*) as n, round(avg(l_extendedprice), 4) as mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) as sd, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by all"
)
def grouped_stats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), _r(stats.mean(c), "mean", 4), _r(stats.sd(c), "sd", 4), stats.minimum(c).alias("low"),
        stats.maximum(c).alias("high")
    )


@query(
    "select count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) as low, max(value) as high, round(median(value), 6) as median from events"
)
def global_stats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("value")
    e = table(spark, d, "events")
    one = e.agg(
        F.count(F.lit(1)).alias("n"), _r(stats.mean(c), "mean"), _r(stats.sd(c), "sd"), stats.minimum(c).alias("low"),
        stats.maximum(c).alias("high")
    )
    median = ordering.percentiles(e, [], "value", {"m": 0.5}).first()["m"]
    return one.withColumn("median", F.round(F.lit(median), 6))


@query(
    """select user_id, round(quantile_cont(value, 0.01), 6) as p01, round(quantile_cont(value, 0.25), 6) as p25, round(median(value), 6) as p50, round(quantile_cont(value, 0.99), 6) as p99, 0.0::double as p00, max(value) as p100 from events group by 1"""
)
def percentiles_by_group(spark: SparkSession, d: str) -> DataFrame:
    p = ordering.percentiles(
        table(spark, d, "events"), ["user_id"], "value", {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p00": 0.0, "p100": 1.0}
    )
    return p.select("user_id", *[_r(F.col(c), c) for c in ("p01", "p25", "p50", "p99")], "p00", "p100")


@query("""select event_type, round(lo - 0.1 * (hi - lo), 6) as low, round(hi + 0.1 * (hi - lo), 6) as high, round(q1 - 0.5 * (q9 - q1), 6) as p_low, round(q9 + 0.5 * (q9 - q1), 6) as p_high
from (select event_type, min(value) as lo, max(value) as hi, quantile_cont(value, 0.1) as q1, quantile_cont(value, 0.9) as q9 from events group by 1)""")
def scaled_ranges(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("value")
    lo, hi = stats.scaled(stats.value_range(c), 0.1)
    e = table(spark, d, "events")
    p = ordering.percentiles(e, ["event_type"], "value", {"q1": 0.1, "q9": 0.9})
    a, b = stats.scaled((F.col("q1"), F.col("q9")), 0.5)
    return e.groupBy("event_type").agg(_r(lo, "low"), _r(hi, "high")).join(
        p.select("event_type", _r(a, "p_low"), _r(b, "p_high")), "event_type"
    )


@query("select event_id, round(value / nullif(stddev_samp(value) over (partition by event_type), 0), 6) as value from events")
def sd_normalized(spark: SparkSession, d: str) -> DataFrame:
    return stats.normalize_by_sd(
        table(spark, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"]
    ).select("event_id", _r(F.col("value"), "value"))


@query("""with s as (select event_type, (event_id % 1500) / 1000.0::double as dist, value
from events), b as (select event_type, floor(dist / 0.1::double)::int as bin, median(value) as y from s group by 1, 2)
select g.event_type, g.bin, round(0 + (g.bin + 0.5) * 0.1::double, 6) as x, round(coalesce(b.y, 0), 6) as y
from (select distinct event_type, unnest(range(15))::int as bin from events) g left join b on b.event_type = g.event_type and b.bin = g.bin""")
def binned_median_profile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.pmod("event_id", F.lit(1500)) / F.lit(1000.0)).alias("dist"), "value")
    return stats.binned_medians(e, ["event_type"], "dist", "value").select("event_type", "bin", _r(F.col("x"), "x"), _r(F.col("y"), "y"))


@query(
    """select l_partkey, round(coalesce(avg(l_quantity) filter (l_discount <= 0.05), 0), 6) as near_mean, round(avg(l_quantity) filter (l_discount * 10 <= 0.8), 6) as m0, round(sqrt(avg(l_quantity * pow(l_discount * 10, 2)) filter (l_discount * 10 <= 0.8) / avg(l_quantity) filter (l_discount * 10 <= 0.8) / 3), 6) as m2 from lineitem group by 1"""
)
def profile_moments(spark: SparkSession, d: str) -> DataFrame:
    q, dist = F.col("l_quantity"), F.col("l_discount") * 10
    m0, m2 = stats.moments(dist, q, 0.8)
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(
        _r(stats.near_centre_mean(F.col("l_discount"), q), "near_mean"), _r(m0, "m0"), _r(m2, "m2")
    )


@query("""select l_partkey, round(case when var_pop(v) > 0 and var_pop(f) > 0 then covar_pop(v, f) / (sqrt(var_pop(v)) * sqrt(var_pop(f))) else 0 end, 6) as q_score
from (select l_partkey, l_quantity as v, 0.05::double * exp(-0.5 * pow(l_discount * 10 / 0.6::double, 2)) - 0.005 as f from lineitem) group by 1""")
def profile_q_score(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", (F.col("l_discount") * 10).alias("dist"), "l_quantity")
    return stats.q_score(li, ["l_partkey"], "dist", "l_quantity").select("l_partkey", _r(F.col("q_score"), "q_score"))


@query(
    "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1"
)
def linear_fits(spark: SparkSession, d: str) -> DataFrame:
    s, i, r = stats.linear_fit(F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(_r(s, "slope"), _r(i, "intercept", 4), _r(r, "r2"))


@query("select event_type, floor(value / 20)::int as bin, count(*) as n from events where value >= 0 and value < 500 group by 1, 2")
def histogram_1d(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "events"), ["event_type"], "value", 0.0, 500.0, 25)


@query(
    "select floor(l_quantity / 5)::int as bin_x, floor(l_tax / 0.02::double)::int as bin_y, count(*) as n from lineitem where l_quantity >= 0 and l_quantity < 50 and l_tax >= 0 and l_tax < 0.08 group by 1, 2"
)
def histogram_of_two(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram_2d(table(spark, d, "lineitem"), "l_quantity", "l_tax", (0.0, 50.0), (0.0, 0.08), (10, 4))


@query("""select key_tag, count(*) as n, round(avg(position_x), 6) as centre_x, round(avg(position_y), 6) as centre_y, round(avg(position_z), 6) as centre_z,
  round(sqrt(pow(max(position_x) - min(position_x), 2) + pow(max(position_y) - min(position_y), 2) + pow(max(position_z) - min(position_z), 2)), 6) as length, round(min(position_x) + 0.25 * (max(position_x) - min(position_x)), 6) as quarter_x from model_atom group by 1""")
def model_extent(spark: SparkSession, d: str) -> DataFrame:
    """Centre, diagonal and a relative position of each model."""
    s = stats.spatial_summary(table(spark, d, "model_atom"), ["key_tag"], ["position_x", "position_y", "position_z"])
    return s.select(
        "key_tag", "n", *[_r(F.col(f"centre_position_{a}"), f"centre_{a}") for a in "xyz"], _r(F.col("length"), "length"),
        _r(stats.relative_position(F.lit(0.25), F.col("low_position_x"), F.col("high_position_x")), "quarter_x")
    )


@query(
    "select count(distinct (element, structure)) as n_groups, count(distinct component_key) as n_components, min(temperature) filter (element = 6 and not isnan(temperature)) as least from model_atom"
)
def distinct_groups(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "model_atom").withColumn("serial_id", F.col("row_id"))
    one = a.agg(F.countDistinct(F.struct("element", "structure")).alias("n_groups"), F.countDistinct("component_key").alias("n_components"))
    return one.withColumn("least", F.lit(reports.parameter_minimum(a, a, 6, "temperature").first()["minimum"]).cast("double"))


# selections


@query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (3, 5, 7)")
def pick_veto_selection(spark: SparkSession, d: str) -> DataFrame:
    picks, vetoes = select.parse_names("BUILDING, MACHINERY,,"), [3, 5, 7]
    return table(spark, d, "customer").where(
        select.pick_veto({"c_mktsegment": picks}, {"c_nationkey": vetoes, "c_name": []})
    ).select("c_custkey")


@query("""with heads as (select key_tag, arg_min(chain_id, ordinal) as chain_id
from (select key_tag, structure as entity_id, chain_id, min(serial_id) as ordinal from model_atom where structure is not null and chain_id is not null
group by 1, 2, 3) group by key_tag, entity_id)
select key_tag, count(*) as n from model_atom a where exists (select 1 from heads h
where h.key_tag = a.key_tag and h.chain_id = a.chain_id) or not exists (select 1 from heads h where h.key_tag = a.key_tag) group by 1""")
def first_chain_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of the first chain of each entity (entities stood for by structure codes)."""
    a = table(spark, d, "model_atom")
    chain_map = a.where("structure is not null and chain_id is not null").groupBy(
        "key_tag", F.col("structure").alias("entity_id"), "chain_id"
    ).agg(F.min("serial_id").alias("chain_ordinal"))
    return select.first_chains(
        a.select("key_tag", "chain_id", "row_id"), chain_map, ["key_tag"]
    ).groupBy("key_tag").agg(F.count(F.lit(1)).alias("n"))


@query("""with box as (select key_tag, min(position_x) - 3 as lx, max(position_x) + 3 as hx, min(position_y) - 3 as ly, max(position_y) + 3 as hy
from model_atom where element = 7 group by 1)
select a.row_id from model_atom a join box b on a.key_tag = b.key_tag where position_x between lx and hx and position_y between ly and hy""")
def bounding_box_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "model_atom")
    axes = ["position_x", "position_y"]
    return select.in_box(
        a.select("row_id", "key_tag", *axes), select.bounding_box(a.where("element = 7"), ["key_tag"], axes, 3.0), ["key_tag"], axes
    ).select("row_id")


@query("select event_id from (select event_id, value, max(value) over (partition by event_type) as m from events) where value > m * 0.9")
def threshold_rows(spark: SparkSession, d: str) -> DataFrame:
    return select.above_share_of_max(table(spark, d, "events"), "value", 0.9, ["event_type"]).select("event_id")


@query(
    "select row_id from (select row_id, position_z - avg(position_z) over (partition by key_tag) as z from model_atom) where z >= -2 and z < 2"
)
def centred_slab(spark: SparkSession, d: str) -> DataFrame:
    return select.slab(
        table(spark, d, "model_atom").select("row_id", "key_tag", "position_z"), "position_z", -2.0, 2.0, ["key_tag"], True
    ).select("row_id")


@query(
    """select key_tag, count(*) filter (atom_id in ('CA','C','N','O','P','OP1','OP2','O5''','C5''','C4''','O4''','C3''','O3''','C2''','O2''','C1''')) as n_main, count(*) filter (coalesce(element, 0) = 0 or coalesce(component_key, 0) = 0 or coalesce(atom_key, 0) = 0) as n_unknown from model_atom group by 1"""
)
def main_chain_and_unknown(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "model_atom")
    return a.groupBy("key_tag").agg(
        F.count_if(select.is_main_chain(F.col("atom_id"))).alias("n_main"),
        F.count_if(select.is_unknown(F.col("element"), F.col("component_key"), F.col("atom_key"))).alias("n_unknown")
    )


@query(
    """select l_suppkey, n_members from (select l_suppkey, count(*) as n_members, arg_min(l_discount > 0.02, (l_orderkey, l_linenumber, l_partkey)) as f from lineitem group by 1) where n_members >= 10 and f"""
)
def eligible_groups(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), (F.col("l_discount") > 0.02).alias("f")
    )
    return select.fit_groups(li, ["l_suppkey"], "o", "f")


# grids: events as voxels of a 100 x 10 x n grid

_NZ = 1000


def _event_grid() -> grid.Grid:
    return grid.Grid((100, 10, _NZ), (0.5, 1.0, 2.0), (-10.0, 0.0, 5.0))


@query("""with g as (select event_id as gid, event_id % 100 as ix, (event_id // 100) % 10 as iy, event_id // 1000 as iz from events)
select gid, ix, iy, iz, ix * 0.5::double - 10 as x, iy::double as y, iz * 2.0::double + 5 as z, ix as fx, iy as fy, iz as fz, gid as back from g""")
def grid_round_trip(spark: SparkSession, d: str) -> DataFrame:
    g = _event_grid()
    e = table(spark, d, "events").select(F.col("event_id").alias("gid"))
    p = e.select(
        "gid", *[c.alias(n) for c, n in zip(g.index(F.col("gid")), ("ix", "iy", "iz"))],
        *[c.alias(n) for c, n in zip(g.position(F.col("gid")), "xyz")]
    )
    p = p.select("*", *[c.alias(n) for c, n in zip(g.floor_index(*[F.col(c) for c in "xyz"]), ("fx", "fy", "fz"))])
    return p.withColumn("back", g.gid(F.col("fx"), F.col("fy"), F.col("fz")))


@query("""with g as (select event_id as gid, value, event_id % 10 as a, (event_id // 10) % 25 as b, event_id // 250 as c, (select max(event_id) // 250 + 1
from events) as ny from events)
select (b + 25 * (c + ny * a))::bigint as gid, value from g""")
def axes_reordered(spark: SparkSession, d: str) -> DataFrame:
    """All events as an array of 10 x 25 x n values stored in z, x, y order."""
    e = table(spark, d, "events").select(F.col("event_id").alias("gid"), "value")
    n = e.agg(F.max("gid")).first()[0] // 250 + 1
    return grid.reorder_axes(e, "gid", (10, 25, n), (3, 1, 2))


_PTS = "select vec_id as id, embedding[1] * 40::double as px, embedding[2] * 4::double as py, embedding[3] * 20::double + 10 as pz from embeddings"


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), (e[0] * F.lit(40.0)).alias("px"), (e[1] * F.lit(4.0)).alias("py"),
        (e[2] * F.lit(20.0) + 10).alias("pz")
    )


@query(f"""with p as ({_PTS}), q as (select id, px, py, pz, (px >= -10.25 and px <= 39.75 and py >= -0.5 and py <= 9.5 and pz >= 4 and pz <= {5 + 2 * (_NZ - 0.5)}) as ok
from p),
i as (select id, case when ok then floor((px + 10) / 0.5) else -1 end as ix, case when ok then floor(py) else -1 end as iy, case when ok then floor((pz - 5) / 2) else -1 end as iz, px, py, pz
from q),
t as (select *, (px + 10 - ix * 0.5) / 0.5 as tx, py - iy as ty, (pz - 5 - iz * 2) / 2 as tz from i),
k as (select unnest([0, 1, 2, 3]) as k),
w as (select id, kx.k as kx, ky.k as ky, kz.k as kz, {' * '.join(f"(case k{a}.k when 0 then 0.5 * (-t{a}*t{a}*t{a} + 2*t{a}*t{a} - t{a}) when 1 then 0.5 * (3*t{a}*t{a}*t{a} - 5*t{a}*t{a} + 2) when 2 then 0.5 * (-3*t{a}*t{a}*t{a} + 4*t{a}*t{a} + t{a}) else 0.5 * (t{a}*t{a}*t{a} - t{a}*t{a}) end)" for a in 'xyz')} as w,
  least(greatest(ix + kx.k - 1, 0), 99) + 100 * (least(greatest(iy + ky.k - 1, 0), 9) + 10 * least(greatest(iz + kz.k - 1, 0), {_NZ - 1})) as gid from t, k kx, k ky, k kz)
select p.id, round(coalesce(sum(w.w * e.value), 0), 5) as value from p left join w on w.id = p.id left join events e on e.event_id = w.gid group by 1""")
def stencil_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Tricubic values of the event grid at the embedding points, partly outside it."""
    v = table(spark, d, "events").select(F.col("event_id").alias("gid"), "value")
    return grid.interpolate(_points(spark, d), v, _event_grid(), "id", ("px", "py", "pz")).select("id", _r(F.col("value"), "value", 5))


_SMALL = grid.Grid((12, 10, 8), (1.0, 1.0, 1.0), (-6.0, -5.0, -4.0))


@query("""with p as (select vec_id % 3 as width, embedding[1] * 6::double as px, embedding[2] * 6::double as py, embedding[3] * 6::double as pz from embeddings),
v as (select i as gid, i % 12 - 6 as x, (i // 12) % 10 - 5 as y, i // 120 - 4 as z from range(960) r(i)),
c as (select width, gid, pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2) as d2 from p, v)
select w.width, v.gid, round(coalesce(s.value, 0), 8) as value from (select distinct width from p) w cross join v left
join (select width, gid, sum(pow(2 * pi() * pow(0.5 + 0.25 * width, 2), -1.5) * exp(-d2 / (2 * pow(0.5 + 0.25 * width, 2)))) as value from c
where d2 <= 6.25 group by 1, 2) s on s.width = w.width and s.gid = v.gid""")
def scatter_add_field(spark: SparkSession, d: str) -> DataFrame:
    """Fields of Gaussian points on a lattice for three widths in one job."""
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select(
        F.pmod("vec_id", F.lit(3)).alias("width"), *[(e[i] * F.lit(6.0)).alias(n) for i, n in enumerate(("px", "py", "pz"))]
    )
    field = grid.scatter_add(
        p, _SMALL, 2.5, potential.user_gauss(F.col("distance"), 1.0, 0.5 + 0.25 * F.col("width")), ["width"], ("px", "py", "pz")
    )
    return field.select("width", "gid", _r(F.col("value"), "value", 8))


@query(
    "select p_partkey, round(pow(2 * pi() * (1.0 / (p_size * p_size) + 0.25), -1.5) * exp(-0.81::double / (2 * (1.0 / (p_size * p_size) + 0.25))), 8) as value from part"
)
def single_gauss_potential(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", _r(potential.single_gauss(F.col("p_size"), F.lit(0.9), 0.5), "value", 8))


@query("""select p_partkey, round(47.87764193::double * (0.5 * pow(2 * pi() * f1, -1.5) * exp(-r * r / f1 / 2) + 1.5 * pow(2 * pi() * f2, -1.5) * exp(-r * r / f2 / 2)), 6) as value
from (select p_partkey, p_size / 50.0::double as r, 2.0 / (8 * pi() * pi()) + 0.25 as f1, 9.0 / (8 * pi() * pi()) + 0.25 as f2 from part)""")
def many_gauss_potential(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array(F.lit(0.5), F.lit(1.5)), F.array(F.lit(2.0), F.lit(9.0))
    return table(spark, d, "part").select("p_partkey", _r(potential.five_gauss(a, b, F.col("p_size") / F.lit(50.0), 0.5), "value"))


@query("""with p as (select p_partkey, p_size / 20.0::double as r, p_size / 20.0::double / (0.5 * sqrt(2::double)) / 400 as h from part)
select p_partkey, round(case when r > 3 then 0 else 14.39964393::double / r * (h / 3) * list_sum(list_transform(range(401), lambda i: (case when i = 0 or i = 400 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(i * h, 2)))) * 2 / sqrt(pi()) end, 6) as value
from p""")
def charge_term(spark: SparkSession, d: str) -> DataFrame:
    """The error function term of a charged potential; the SQL integrates it by Simpson's rule."""
    return table(spark, d, "part").select("p_partkey", _r(potential.charge_delta(F.col("p_size") / F.lit(20.0), F.lit(1.0), 0.5), "value"))


# points


_ATOMS = "select row_id, key_tag, position_x as x, position_y as y, position_z as z, element, atom_id from model_atom"


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_atom").select(
        "row_id", "key_tag", F.col("position_x").alias("x"), F.col("position_y").alias("y"), F.col("position_z").alias("z"), "element",
        "atom_id"
    )


@query(f"""with a as ({_ATOMS}) select l.row_id as left_id, r.row_id as right_id, round(sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2)), 6) as distance
from a l join a r on l.key_tag = r.key_tag and l.row_id < r.row_id where pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2) <= 4""")
def range_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of atoms of the same model within 2 of each other."""
    a = _atoms(spark, d)
    j = spatial.range_join(
        a.select("row_id", "key_tag", "x", "y", "z"), a.select("row_id", "key_tag", "x", "y", "z"), "xyz", 2.0, ["key_tag"],
        F.col("l.row_id") < F.col("r.row_id")
    )
    return j.select(F.col("l.row_id").alias("left_id"), F.col("r.row_id").alias("right_id"), _r(F.col("distance"), "distance"))


@query(
    f"""with a as ({_ATOMS}) select l.row_id, count(r.row_id) as n_neighbours from a l left
join a r on l.key_tag = r.key_tag and pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2) <= 9 group by 1"""
)
def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of the same model within 3 of each atom, itself included."""
    return spatial.neighbour_counts(_atoms(spark, d), "row_id", "xyz", 3.0, ["key_tag"])


@query("""with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)
select vec_id, near_id, round(distance, 6) as distance, rank
from (select q.vec_id, r.vec_id as near_id, sqrt(pow(q.x - r.x, 2) + pow(q.y - r.y, 2) + pow(q.z - r.z, 2)) as distance,
  row_number() over (partition by q.vec_id order by sqrt(pow(q.x - r.x, 2) + pow(q.y - r.y, 2) + pow(q.z - r.z, 2)), r.vec_id)::int as rank from p q, p r where q.vec_id % 20 = 0) where rank <= 5""")
def nearest_points(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all points to every twentieth."""
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select("vec_id", *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    near = spatial.nearest(p.where("vec_id % 20 = 0"), p.withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id", "xyz", 5, 0.1)
    return near.select("vec_id", "near_id", _r(F.col("distance"), "distance"), "rank")


@query(
    "select distinct floor(embedding[1] / 0.05::double)::double * 0.05::double as x, floor(embedding[2] / 0.05::double)::double * 0.05::double as y from embeddings"
)
def quantized_points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return spatial.quantized_distinct(
        table(spark, d, "embeddings").select(e[0].cast("double").alias("x"), e[1].cast("double").alias("y")), "xy", 0.05
    )


def _shift_sql(rounds: int) -> str:
    out = "v as materialized (select vec_id, embedding[1] * 4::double as x, embedding[2] * 4::double as y, 1.0::double + label as value from embeddings), m0 as materialized (select vec_id, x, y from v)"
    for i in range(1, rounds + 1):
        out += f", m{i} as materialized (select m.vec_id, sum(v.value * v.value * v.x) / sum(v.value * v.value) as x, sum(v.value * v.value * v.y) / sum(v.value * v.value) as y from m{i - 1} m join v on pow(m.x - v.x, 2) + pow(m.y - v.y, 2) <= 0.25 group by 1)"
    return f"with {out} select vec_id, round(x, 6) as x, round(y, 6) as y from m{rounds}"


@query(_shift_sql(2))
def mean_shift_two_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Every point moved twice to the weighted centroid around it."""
    e = F.col("embedding")
    v = table(spark, d, "embeddings").select(
        "vec_id", (e[0] * F.lit(4.0)).alias("x"), (e[1] * F.lit(4.0)).alias("y"), (F.lit(1.0) + F.col("label")).alias("value")
    )
    return spatial.mean_shift(v, v, "vec_id", "xy", "value", 0.5, 2.0, 2).select("vec_id", _r(F.col("x"), "x"), _r(F.col("y"), "y"))


@query()
def mean_shift_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The selected points (at least half the largest value), each moved 15 times to the weighted centroid of its 20 nearest."""
    e = F.col("embedding")
    v = table(spark, d, "embeddings").select(
        "vec_id", (e[0] * F.lit(4.0)).alias("x"), (e[1] * F.lit(4.0)).alias("y"), (F.lit(1.0) + F.col("label")).alias("value")
    )
    high = materialize(select.above_share_of_max(v, "value", 0.5))
    return spatial.mean_shift_nearest(
        high, high, "vec_id", "xy", "value", 0.25, power=2.0
    ).select("vec_id", _r(F.col("x"), "x"), _r(F.col("y"), "y"))


_FIRST = "select key_tag, serial_id, min(row_id) as row_id from model_atom group by 1, 2"


def _unique_atoms(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "model_atom")
    return a.groupBy("key_tag", "serial_id").agg(
        F.min_by(
            F.struct(
                "position_x", "position_y", "position_z", "chain_id", "sequence_id", "component_id", "atom_id", "temperature", "element"
            ),
            "row_id"
        ).alias("a")
    ).select("key_tag", "serial_id", "a.*")


@query(f"""with u as (select m.* from model_atom m join ({_FIRST}) f on m.row_id = f.row_id)
select b.row_id, round(sqrt(pow(a2.position_x - a1.position_x, 2) + pow(a2.position_y - a1.position_y, 2) + pow(a2.position_z - a1.position_z, 2)), 6) as length, round((a1.position_x + a2.position_x) / 2, 6) as mid_x, round(a2.position_y - a1.position_y, 6) as vec_y
from model_bond b join u a1 on a1.key_tag = b.key_tag and a1.serial_id = b.atom_serial_id_1 join u a2 on a2.key_tag = b.key_tag and a2.serial_id = b.atom_serial_id_2""")
def bond_geometry(spark: SparkSession, d: str) -> DataFrame:
    g = spatial.edge_geometry(
        table(spark, d, "model_bond").select("row_id", "key_tag", "atom_serial_id_1", "atom_serial_id_2"), _unique_atoms(spark, d),
        ["key_tag"], ["position_x", "position_y", "position_z"]
    )
    return g.select("row_id", _r(F.col("length"), "length"), _r(F.col("mid_position_x"), "mid_x"), _r(F.col("vec_position_y"), "vec_y"))


@query("""select key_tag, serial_id, count(*) as n_bonds from (select key_tag, atom_serial_id_1 as serial_id from model_bond
where atom_serial_id_1 is not null and atom_serial_id_2 is not null
 union all select key_tag, atom_serial_id_2 from model_bond
where atom_serial_id_1 is not null and atom_serial_id_2 is not null and atom_serial_id_1 <> atom_serial_id_2) group by 1, 2""")
def bond_degrees(spark: SparkSession, d: str) -> DataFrame:
    return spatial.adjacency(
        table(spark, d, "model_bond"), ["key_tag"]
    ).groupBy("key_tag", "serial_id").agg(F.count(F.lit(1)).alias("n_bonds"))


# keys


@query("""with a as (select row_id, (coalesce(atom_key, 0) & 65535)::bigint as a, (coalesce(component_key, 0) & 255)::bigint as c, (coalesce(structure, 0) & 255)::bigint as s, (coalesce(is_special_atom, 0) & 1)::bigint as f
from model_atom)
select class_key, group_key, count(*) as n, min(row_id) as first_row from (select row_id, 'simple' as class_key, a + f * 65536 as group_key from a
union all select row_id, 'component', c + a * 256 from a union all select row_id, 'structure', s + c * 256 + a * 65536 from a) group by 1, 2""")
def packed_key_groups(spark: SparkSession, d: str) -> DataFrame:
    """Atoms grouped by the packed keys of three classes at once."""
    a = table(spark, d, "model_atom").na.fill(0, ["atom_key", "component_key", "structure", "is_special_atom"])
    return keys.atom_classes(a).groupBy("class_key", "group_key").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


@query("""select distinct k as group_key, k & 255 as structure, (k >> 8) & 255 as component_key, (k >> 16) & 65535 as atom_key, '<' || (k & 255) || ', ' || ((k >> 8) & 255) || ', ' || ((k >> 16) & 65535) || '>' as label
from (select structure::bigint + component_key::bigint * 256 + (atom_key::bigint & 65535) * 65536 as k from model_atom
where structure between 0 and 255 and component_key between 0 and 255 and atom_key >= 0)""")
def unpacked_keys(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "model_atom").where("structure between 0 and 255 and component_key between 0 and 255 and atom_key >= 0")
    k = a.select(keys.STRUCTURE_ATOM.pack(F.col("structure"), F.col("component_key"), F.col("atom_key")).alias("group_key")).distinct()
    return k.select(
        "group_key", *keys.STRUCTURE_ATOM.unpack(F.col("group_key")), keys.STRUCTURE_ATOM.label(F.col("group_key")).alias("label")
    )


@query("""with s as (select component_id as id, min(row_id) as first from model_atom where component_id is not null
group by 1), k as (select id, row_number() over (order by id) as code from (select distinct id from model_component
where is_standard_monomer = 1 and id is not null))
select s.id, k.code, false as is_new from s join k on s.id = k.id union all select s.id, 29 + row_number() over (order by first, s.id), true from s
where s.id not in (select id from k)""")
def dictionary_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of component ids: known ones first, others from 30 in order of appearance."""
    known = table(spark, d, "model_component").where("is_standard_monomer = 1 and id is not null").select("id").distinct()
    known = ordering.numbered(known, [], ["id"], "code")
    return keys.encode_ids(table(spark, d, "model_atom"), "component_id", "row_id", known, 30)


@query(
    "select distinct atom_id || '_' || element_type as bond_id, element_type || '_' || atom_id as reversed from model_component_atom where atom_id is not null and element_type is not null and atom_id not like '%\\_%' escape '\\'"
)
def bond_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "model_component_atom").where(
        "atom_id is not null and element_type is not null"
    ).where(~F.col("atom_id").contains("_"))
    b = keys.bond_id(F.col("atom_id"), F.col("element_type").cast("string"))
    return c.select(b.alias("bond_id"), keys.reversed_bond_id(b).alias("reversed")).distinct()


# lookups


_RANGES = [
    (0, 3, 18, "SHEET", 2), (1, 10, 40, "HELX", 1), (2, 35, 60, "SHEET", 2), (3, 38, 70, "HELX", 1), (4, 90, 80, "HELX", 1),
    (5, 200, 200, "SHEET", 2)
]


@query(f"""with r(range_id, lo, hi, label, priority) as (values {', '.join(str(x) for x in _RANGES)})
select row_id, coalesce((select label from r where sequence_id between lo and hi order by priority, range_id limit 1), 'FREE') as label from model_atom""")
def interval_labels(spark: SparkSession, d: str) -> DataFrame:
    """Atoms labelled by the range of their sequence number; helices before sheets."""
    r = spark.createDataFrame(_RANGES, "range_id int, low int, high int, label string, priority int").withColumn("one", F.lit(1))
    a = table(spark, d, "model_atom").select("row_id", "sequence_id").withColumn("one", F.lit(1))
    return lookup.label_intervals(a, r, ["one"], "sequence_id", default="FREE").select("row_id", "label")


@query(
    "select o_orderkey, coalesce((select min(n_nationkey) from nation where n_name = o_orderpriority), -1)::int as code, coalesce((select min(c_nationkey) from customer where c_custkey = o_custkey), -1)::int as nation from orders"
)
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    o = lookup.dictionary(
        table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", n, "n_name", "n_nationkey", -1,
        "code"
    )
    return lookup.dictionary(o, "o_custkey", c, "c_custkey", "c_nationkey", -1, "nation").select(
        "o_orderkey", F.col("code").cast("int").alias("code"), F.col("nation").cast("int").alias("nation")
    )


@query("""with ca as (select key_tag, chain_id, sequence_id, arg_min(row_id, row_id) as partner from model_atom where atom_id = 'CA' group by 1, 2, 3)
select a.row_id, ca.partner from model_atom a join ca on ca.key_tag = a.key_tag and ca.chain_id = a.chain_id and ca.sequence_id = a.sequence_id where a.atom_id = 'O'""")
def first_partner(spark: SparkSession, d: str) -> DataFrame:
    """The first CA atom of the same residue for each O atom."""
    a = table(spark, d, "model_atom").select("row_id", "key_tag", "chain_id", "sequence_id", "atom_id")
    right = a.where("atom_id = 'CA'").withColumn("partner", F.col("row_id"))
    return lookup.first_match(
        a.where("atom_id = 'O'"), right, ["key_tag", "chain_id", "sequence_id"], "row_id", ["partner"]
    ).select("row_id", "partner")


@query("""with ref as (select l_suppkey, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey)) as v from lineitem where l_returnflag = 'A' group by 1)
select l.l_suppkey, round(sum(l_extendedprice - coalesce(v - 1000, 0)), 2) as total from lineitem l left join ref on ref.l_suppkey = l.l_suppkey group by 1""")
def normalized_to_reference(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        "l_suppkey", "l_extendedprice", "l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o")
    )
    n = lookup.normalized_by_reference(li, li.where("l_returnflag = 'A'"), "l_suppkey", "l_extendedprice", "o", 1000.0)
    return n.groupBy("l_suppkey").agg(_r(F.sum("l_extendedprice_normalized"), "total", 2))


@query("""with t as (select key_tag, component_key, load_id, min(row_id) as hit from model_component
group by 1, 2, 3), u as (select key_tag, component_key, min(row_id) as hit from model_component group by 1, 2)
select a.row_id, coalesce(t.hit, u.hit) as hit from model_component_atom a left
join t on t.key_tag = a.key_tag and t.component_key = a.component_key and t.load_id = a.load_id left
join u on u.key_tag = a.key_tag and u.component_key = a.component_key""")
def lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The component row of the same load, else the first of any load."""
    t = table(spark, d, "model_component").select("key_tag", "component_key", "load_id", F.col("row_id").alias("hit"))
    a = table(spark, d, "model_component_atom").select("row_id", "key_tag", "component_key", "load_id")
    return lookup.lookup_with_fallback(
        a, t, ["key_tag", "component_key", "load_id"], ["key_tag", "component_key"], "hit", "hit"
    ).select("row_id", "hit")


@query(
    """select row_id from model_bond b where exists (select 1 from model_atom a where a.key_tag = b.key_tag and a.serial_id = b.atom_serial_id_1 and a.load_id <= 4) and exists (select 1 from model_atom a where a.key_tag = b.key_tag and a.serial_id = b.atom_serial_id_2 and a.load_id <= 4)"""
)
def bonds_within(spark: SparkSession, d: str) -> DataFrame:
    return lookup.both_ends_in(
        table(spark, d, "model_bond").select("row_id", "key_tag", "atom_serial_id_1", "atom_serial_id_2"),
        table(spark, d, "model_atom").where("load_id <= 4"), ["key_tag"]
    ).select("row_id")


@query("""select distinct key_tag, 'left_only' as side from object_catalog c
where object_type = 'model' and key_tag is not null and key_tag not in (select key_tag from model_object where key_tag is not null)
union all select distinct key_tag, 'right_only' from model_object where key_tag is not null and key_tag not in (select key_tag from object_catalog
where object_type = 'model' and key_tag is not null)""")
def catalog_differences(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "object_catalog").where("object_type = 'model' and key_tag is not null")
    return lookup.key_differences(c, table(spark, d, "model_object").where("key_tag is not null"), ["key_tag"])


@query(
    "select o_orderkey, n is not null as is_selected, coalesce(n, 0) as n from orders left join (select l_orderkey, count(*) as n from lineitem where l_quantity > 45 group by 1) on l_orderkey = o_orderkey"
)
def marked_present(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg(F.count(F.lit(1)).alias("n"))
    return lookup.mark_present(
        table(spark, d, "orders").select("o_orderkey"), e, ["o_orderkey"]
    ).select("o_orderkey", "is_selected", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "select 'new' as label, o_orderkey from orders where o_orderstatus = 'O' union all select 'done', o_orderkey from orders where o_orderstatus = 'F'"
)
def labelled_union(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return lookup.union_labelled(
        {"new": o.where("o_orderstatus = 'O'").drop("o_orderstatus"), "done": o.where("o_orderstatus = 'F'").drop("o_orderstatus")}
    )


@query("select distinct least(l_suppkey, l_partkey % 100) as a, greatest(l_suppkey, l_partkey % 100) as b from lineitem")
def unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.pmod("l_partkey", F.lit(100)).alias("b"))
    return lookup.unordered_pairs(li, "a", "b")


@query(
    "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') and c_custkey in (select o_custkey from orders where o_orderpriority = '5-LOW')"
)
def ids_in_both(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    pick = lambda p: o.where(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(
        pick("1-URGENT"), "c_custkey", "left_semi"
    ).join(pick("5-LOW"), "c_custkey", "left_semi")


# sequences


@query("""with t as (select key_tag, chain_id, sequence_id, coalesce(max(temperature) filter (atom_id = 'CA'), 0) as a, coalesce(max(temperature) filter (atom_id = 'C'), 0) as b, coalesce(max(temperature) filter (atom_id = 'N'), 0) as c, coalesce(max(temperature) filter (atom_id = 'O'), 0) as d
 from model_atom where atom_id in ('CA', 'C', 'N', 'O') group by 1, 2, 3),
r as (select unnest(['CA', 'C', 'N', 'O']) as atom_id, unnest([1 + (b < a)::int + (c < a)::int + (d < a)::int, 1 + (a < b)::int + (c < b)::int + (d < b)::int, 1 + (a < c)::int + (b < c)::int + (d < c)::int, 1 + (a < d)::int + (b < d)::int + (c < d)::int]) as rank
from t)
select atom_id, rank::int as rank, count(*) as n from r group by 1, 2""")
def rank_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the four main-chain atoms within their residue."""
    return lookup.rank_of_values(
        table(spark, d, "model_atom"), ["key_tag", "chain_id", "sequence_id"], "atom_id", select.MAIN_CHAIN_AMINO, "temperature"
    ).groupBy("atom_id", "rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "select event_id, (1 + coalesce(sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0))::int as model_number from events"
)
def running_counter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return lookup.running_count(e, ["user_id"], "o", F.col("event_type") == "error", "model_number").select("event_id", "model_number")


@query(
    "select l.l_orderkey, l.l_linenumber, sum(r.l_quantity) as next_total, count(*) as n from lineitem l join lineitem r on r.l_orderkey = l.l_orderkey and r.l_linenumber = l.l_linenumber + 1 group by 1, 2"
)
def next_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lookup.next_in_sequence(li, ["l_orderkey"], "l_linenumber", ["l_quantity"]).groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("next_l_quantity").alias("next_total"), F.count(F.lit(1)).alias("n")
    )


@query(
    "select key_tag, chain_id, sequence_id, round(avg(temperature), 6) as value, count(*) as n from model_atom where sequence_id >= 0 and not isnan(temperature) group by 1, 2, 3"
)
def chain_series(spark: SparkSession, d: str) -> DataFrame:
    """Mean temperature along the sequence of each chain."""
    a = table(spark, d, "model_atom").where((F.col("sequence_id") >= 0) & F.col("temperature").isNotNull() & ~F.isnan("temperature"))
    means = a.groupBy("key_tag", "chain_id", "sequence_id").agg(_r(F.avg("temperature"), "value"), F.count(F.lit(1)).alias("n"))
    return reports.chain_series(means, "value", "n")


@query("""with s as (select l_returnflag as g, l_partkey as k, floor(l_discount * 10 / 0.1::double)::int as bin, l_quantity as v
from lineitem), m as (select g, k, bin, median(v) as y from s where bin between 0 and 9 group by 1, 2, 3),
p as (select distinct g, k, unnest(range(10))::int as bin from s), f as (select p.g, p.k, p.bin, coalesce(m.y, 0) as y from p left
join m on m.g = p.g and m.k = p.k and m.bin = p.bin)
select x.k as l_partkey, x.bin, round((x.bin + 0.5) * 0.1::double, 6) as x, x.y as a, y.y as b from f x join f y on x.k = y.k and x.bin = y.bin
where x.g = 'A' and y.g = 'R'""")
def cross_model_bins(spark: SparkSession, d: str) -> DataFrame:
    """Binned medians of two groups of rows side by side, empty bins 0."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", (F.col("l_discount") * 10).alias("distance"), "l_quantity")
    p = reports.paired_profiles(
        li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_partkey"], "distance", "l_quantity", 10, 1.0
    )
    return p.select("l_partkey", "bin", _r(F.col("x"), "x"), "a", "b")


# texts


@query(
    """select doc_id, length(rtrim(replace(text, chr(10), ''), 'x')) as n, len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '')) as n_parts from documents where text is not null"""
)
def text_cleanup(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select(
        "doc_id", F.length(F.rtrim(F.replace(t, F.lit("\n"), F.lit("")), F.lit("x"))).cast("long").alias("n"),
        F.size(strings.split_list(t)).cast("long").alias("n_parts")
    )


@query()
def upper_texts(spark: SparkSession, d: str) -> DataFrame:
    """Length and hash of each whole text in upper case; without SQL, as engines differ on letters like sharp s."""
    up = F.upper("text")
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select(
        "doc_id", F.length(up).cast("long").alias("n"), F.md5(up.cast("binary")).alias("hash")
    )


@query(
    """select row_id, try_cast(regexp_extract(emd_id, '^\\s*EMD-([0-9]+)', 1) as bigint) as number, try_cast(regexp_extract(formula_, '^\\s*([+-]?[0-9]+)', 1) as bigint) as prefix from (select row_id, emd_id, substr(pdb_id, 2) as formula_ from model_object)"""
)
def number_prefixes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "model_object")
    return m.select(
        "row_id", F.regexp_extract("emd_id", r"^\s*EMD-([0-9]+)", 1).try_cast("long").alias("number"),
        strings.int_prefix(F.expr("substr(pdb_id, 2)")).alias("prefix")
    )


@query("select file_name, lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) as ext, count(*) as n from raw_record group by 1")
def file_extensions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_record").groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).select(
        "file_name", strings.extension(F.col("file_name")).alias("ext"), "n"
    )
