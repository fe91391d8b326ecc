"""Queries of samplers, bonds, charges, comparisons and simulated accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.charges import partial_charges
from gridloom.operators import lookup, reports, samplers, tester
from gridloom.plans.data_queries import _atoms, _r
from gridloom.session import table
from gridloom.sources.store import violations

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with s as (select p_partkey, p_size, k, (((p_partkey % 1048576) * 1103515245 + k * 12345 + 7) % 2147483648) / 2147483648.0::double as u
from part, (select unnest(range(4)) as k))
select p_partkey, k::int as sample_no, round(0.5 + u, 6) as distance, round(p_size + (0.5 + u) * cos(2 * pi() * u), 6) as px from s""")
def counter_draws(spark: SparkSession, d: str) -> DataFrame:
    """Four reproducible draws for each part, as distance and place on a circle."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample_no"))
    u = samplers.lcg(F.col("p_partkey"), F.col("sample_no"), 7)
    return p.select("p_partkey", "sample_no", _r(0.5 + u, "distance"), _r(F.col("p_size") + (0.5 + u) * F.cos(2 * F.pi() * u), "px"))


@query("""with v as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as vx, embedding[5]::double as vy, embedding[6]::double as vz
from embeddings),
n as (select *, vx / sqrt(vx * vx + vy * vy + vz * vz) as n0, vy / sqrt(vx * vx + vy * vy + vz * vz) as n1, vz / sqrt(vx * vx + vy * vy + vz * vz) as n2 from v),
a as (select *, case when abs(n2) < 0.999 then n1 / sqrt(n0 * n0 + n1 * n1) else 0 end as a0, case when abs(n2) < 0.999 then -n0 / sqrt(n0 * n0 + n1 * n1) else n2 / sqrt(n1 * n1 + n2 * n2) end as a1, case when abs(n2) < 0.999 then 0 else -n1 / sqrt(n1 * n1 + n2 * n2) end as a2
from n),
s as (select *, n1 * a2 - n2 * a1 as b0, n2 * a0 - n0 * a2 as b1, n0 * a1 - n1 * a0 as b2, unnest(range(9))::int as sample_no from a),
p as (select *, (sample_no // 3)::int as row, (sample_no % 3)::int as column, (sample_no % 3 - 1)::double as u, (sample_no // 3 - 1)::double as w from s)
select vec_id, sample_no, row, "column", round(sqrt(u * u + w * w), 6) as distance, round(x + u * a0 + w * b0, 6) as px, round(y + u * a1 + w * b1, 6) as py, round(z + u * a2 + w * b2, 6) as pz
from p""")
def plane_lattice(spark: SparkSession, d: str) -> DataFrame:
    """A 3 x 3 lattice across each vector."""
    e = F.col("embedding")
    v = table(spark, d, "embeddings").select(
        "vec_id", *[e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "z"))],
        *[e[3 + i].cast("double").alias(n) for i, n in enumerate(("vx", "vy", "vz"))]
    )
    return samplers.plane(v, 3, 2.0).select(
        "vec_id", "sample_no", "row", "column", _r(F.col("distance"), "distance"), _r(F.col("px"), "px"), _r(F.col("py"), "py"),
        _r(F.col("pz"), "pz")
    )


@query("""select vec_id, 40::bigint as n, true as within, true as at_distance from embeddings""")
def sphere_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples around each point, reduced to what must hold of them."""
    e = F.col("embedding")
    v = table(spark, d, "embeddings").select("vec_id", *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    s = samplers.sphere(v, "vec_id", 40, 0.25, 1.5, seed=11)
    far = F.sqrt(
        F.pow(
            F.col("px") - F.col("x"), F.lit(2.0)
        ) + F.pow(F.col("py") - F.col("y"), F.lit(2.0)) + F.pow(F.col("pz") - F.col("z"), F.lit(2.0))
    )
    return s.groupBy("vec_id").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("distance").between(0.25, 1.5)).alias("within"),
        F.every(F.abs(far - F.col("distance")) < 1e-9).alias("at_distance")
    )


@query("""select vec_id, 30::bigint as n, true as within, true as at_distance from embeddings""")
def cylinder_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples around an axis through each point, reduced to what must hold of them."""
    e = F.col("embedding")
    v = table(spark, d, "embeddings").select(
        "vec_id", *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")],
        *[e[3 + i].cast("double").alias(n) for i, n in enumerate(("vx", "vy", "vz"))]
    )
    s = samplers.cylinder(v, "vec_id", 30, 0.1, 0.8, 1.0, seed=5)
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in ("vx", "vy", "vz")), F.lit(0.0)))
    along = sum(((F.col(f"p{a}") - F.col(a)) * F.col(f"v{a}") for a in "xyz"), F.lit(0.0)) / length
    square = sum((F.pow(F.col(f"p{a}") - F.col(a), F.lit(2.0)) for a in "xyz"), F.lit(0.0))
    return s.groupBy("vec_id").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("distance").between(0.1, 0.8) & (F.abs(along) <= 0.5 + 1e-9)).alias("within"),
        F.every(F.abs(F.sqrt(F.greatest(F.lit(0.0), square - along * along)) - F.col("distance")) < 1e-6).alias("at_distance")
    )


_PAIRS = [("N", "CA"), ("CA", "C"), ("C", "O"), ("CA", "CB")]
_LINKS = [("C", "N"), ("O3'", "P")]


@query(f"""with a as (select row_id as serial_id, key_tag, load_id, chain_id, sequence_id, component_id, atom_id, position_x as x, position_y as y, position_z as z
from model_atom),
p as (select l.key_tag, l.load_id as model_number, l.serial_id as atom_serial_id_1, r.serial_id as atom_serial_id_2, l.atom_id as a1, r.atom_id as a2, l.sequence_id as q1, r.sequence_id as q2, l.component_id as n1, r.component_id as n2, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2)) as distance
 from a l join a r on l.key_tag = r.key_tag and l.load_id = r.load_id and l.serial_id < r.serial_id and l.chain_id = r.chain_id and pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2) <= 4)
select key_tag, model_number, atom_serial_id_1, atom_serial_id_2, a1 || '_' || a2 as bond_id, round(distance, 6) as distance from p
where (q1 = q2 and n1 = n2 and ({' or '.join(f"(a1 = '{x}' and a2 = '{y}') or (a1 = '{y}' and a2 = '{x}')" for x, y in _PAIRS)}))
 or (q2 = q1 + 1 and ({' or '.join("(a1 = '{}' and a2 = '{}')".format(x.replace("'", "''"), y) for x, y in _LINKS)})) or (q1 = q2 + 1 and ({' or '.join("(a2 = '{}' and a1 = '{}')".format(x.replace("'", "''"), y) for x, y in _LINKS)}))""")
def bonds_from_distance(spark: SparkSession, d: str) -> DataFrame:
    """Bonds built from distances and the known names, within each model and load."""
    a = table(spark, d, "model_atom").select(
        F.col("row_id").alias("serial_id"), "key_tag", F.col("load_id").alias("model_number"), "chain_id", "sequence_id", "component_id",
        "atom_id", F.col("position_x").alias("x"), F.col("position_y").alias("y"), F.col("position_z").alias("z")
    )
    inside = F.explode(F.array(*[F.struct(F.lit(x).alias("atom_1"), F.lit(y).alias("atom_2")) for x, y in _PAIRS])).alias("p")
    names = a.select("component_id").where("component_id is not null").distinct()
    allowed = names.select("component_id", inside).select("component_id", "p.atom_1", "p.atom_2").unionAll(
        spark.createDataFrame([(None, *x) for x in _LINKS], "component_id string, atom_1 string, atom_2 string")
    )
    return lookup.build_bonds(a, allowed).withColumn("distance", F.round("distance", 6))


@query(
    """select row_id, case when component_id = 'ALA' and atom_id = 'N' and structure between 10 and 61 then 0.5 when component_id = 'ALA' and atom_id = 'N' and structure in (3, 4) then -0.25 else 0 end::double as charge from model_atom"""
)
def charges(spark: SparkSession, d: str) -> DataFrame:
    """Charges from a parameter table by component, atom and structure class."""
    t = spark.createDataFrame(
        [("ALA", "N", "HELX", 0.5), ("ALA", "N", "SHEET", -0.25), ("ALA", "N", None, 9.0)],
        "component_id string, atom_id string, structure_class string, charge double"
    )
    return partial_charges(
        table(spark, d, "model_atom").select("row_id", "component_id", "atom_id", "structure"), t
    ).select("row_id", "charge")


@query("""with a as (select row_id, key_tag, position_x as x, position_y as y, position_z as z, temperature from model_atom)
select l.row_id, any_value(l.temperature) as temperature, count(r.row_id) as n_neighbours from a l left
join a r on l.key_tag = r.key_tag and pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2) <= 4 group by 1""")
def neighbours_and_value(spark: SparkSession, d: str) -> DataFrame:
    a = _atoms(spark, d).join(table(spark, d, "model_atom").select("row_id", "temperature"), "row_id")
    return reports.neighbours_and_value(a, "row_id", "xyz", 2.0, "temperature", ["key_tag"]).select("row_id", "temperature", "n_neighbours")


@query(
    """select row_id, round(sqrt(pow(position_x - avg(position_x) over w, 2) + pow(position_y - avg(position_y) over w, 2) + pow(position_z - avg(position_z) over w, 2)), 5) as distance, occupancy from model_atom window w as (partition by key_tag)"""
)
def distance_to_centre(spark: SparkSession, d: str) -> DataFrame:
    r = reports.distance_to_centre(
        table(spark, d, "model_atom"), "row_id", ["key_tag"], ["position_x", "position_y", "position_z"], "occupancy"
    )
    return r.select("row_id", F.round("distance", 5).alias("distance"), "occupancy")


@query("select l_returnflag, count(*) filter (l_linestatus = 'F') as F, count(*) filter (l_linestatus = 'O') as O from lineitem group by 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_counts(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


_GROUPS = "select p_brand as key_tag, p_type as class_key, (p_size % 5)::int as group_key, avg(p_retailprice) as v, stddev_samp(p_retailprice) as s from part group by 1, 2, 3"


@query(f"""with g as ({_GROUPS}) select g.key_tag, g.class_key, g.group_key, round(g.v / r.v, 6) as ratio, round(g.v / r.v * sqrt(pow(g.s / g.v, 2) + pow(r.s / r.v, 2)), 6) as ratio_sigma
from g join g r on r.key_tag = 'Brand#1' and g.key_tag <> 'Brand#1' and r.class_key = g.class_key and r.group_key = g.group_key""")
def group_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Group means of each brand over those of one brand, with errors."""
    p = table(spark, d, "part").groupBy(
        F.col("p_brand").alias("key_tag"), F.col("p_type").alias("class_key"), F.pmod("p_size", F.lit(5)).cast("int").alias("group_key")
    ).agg(F.avg("p_retailprice").alias("v"), F.stddev_samp("p_retailprice").alias("s"))
    return reports.compare_groups(p, "Brand#1", "v", "s").select(
        "key_tag", "class_key", "group_key", F.round("ratio", 6).alias("ratio"), F.round("ratio_sigma", 6).alias("ratio_sigma")
    )


@query("""with b as (select l_returnflag as g, l_partkey, avg(l_extendedprice) as v from lineitem group by 1, 2)
select count(*) as n, round(regr_slope(r.v, a.v), 6) as slope, round(regr_intercept(r.v, a.v), 3) as intercept, round(regr_r2(r.v, a.v), 6) as r2
from b a join b r on a.l_partkey = r.l_partkey and a.g = 'A' and r.g = 'R'""")
def comparison_fit(spark: SparkSession, d: str) -> DataFrame:
    """Line between two groups' values of the same parts."""
    b = table(spark, d, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.avg("l_extendedprice").alias("v"))
    r = reports.value_regression(b.where("l_returnflag = 'A'"), b.where("l_returnflag = 'R'"), ["l_partkey"], "v")
    return r.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""with c as (select key_tag, chain_id, sequence_id, (array_agg(temperature order by row_id))[1] as other from model_atom where atom_id = 'C' group by 1, 2, 3)
select a.row_id, case when not isnan(a.temperature) then a.temperature end as temperature, case when not isnan(c.other) then c.other end as other
from model_atom a join c on a.key_tag = c.key_tag and a.chain_id = c.chain_id and a.sequence_id = c.sequence_id where a.atom_id = 'N'""")
def paired_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Temperature of each N atom beside that of the first C atom of its residue; null for NaN."""
    p = reports.paired_groups(
        table(spark, d, "model_atom"), "N", "C", "atom_id", ["key_tag", "chain_id", "sequence_id"], "temperature", "row_id"
    )
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return p.select("row_id", known("temperature"), known("other"))


@query(
    "select key_tag, sum(n)::bigint as n from (select key_tag, serial_id, count(*) as n from model_atom group by 1, 2 having count(*) > 1) group by 1"
)
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each model that share their natural key with others."""
    return violations(spark, {"model_atom": table(spark, d, "model_atom")}).where("rule = 'primary_key'").select("key_tag", "n")


def _studies(spark: SparkSession, studies: dict, residuals) -> DataFrame:
    out = None
    for name, (replicas, points) in studies.items():
        one = tester.summarize(
            residuals(spark, tester.scenario_table(spark, name), replicas, points, seed=1)
        ).withColumn("study", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def simulated_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Residuals of simulated profiles by study, scenario and method."""
    return _studies(spark, tester.LINE_STUDIES, tester.profile_residuals)


@query()
def simulated_groups(spark: SparkSession, d: str) -> DataFrame:
    """Residuals of simulated groups with outlying members by study, scenario and method."""
    return _studies(spark, tester.GROUP_STUDIES, tester.member_residuals)
