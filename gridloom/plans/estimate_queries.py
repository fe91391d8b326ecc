"""Queries of estimates, group tables, key classes, requests and whole-table numbering, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import codes, gauss, keys, potential
from gridloom.operators import grid, lookup, ordering, reports, robust, samplers, select, stats
from gridloom.plans import commands
from gridloom.plans.data_queries import _r, _unique_atoms
from gridloom.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# selections and classes


_UNIQUE = "select m.* from model_atom m join (select key_tag, serial_id, min(row_id) as row_id from model_atom group by 1, 2) f on m.row_id = f.row_id"


@query(f"""with u as ({_UNIQUE}), h as (select key_tag, arg_min(chain_id, serial_id) as chain_id from u
where element is not null and chain_id is not null group by key_tag, element)
select row_id from model_bond b where exists (select 1 from u a where a.key_tag = b.key_tag and a.serial_id = b.atom_serial_id_1 and (exists (select 1
from h where h.key_tag = a.key_tag and h.chain_id = a.chain_id) or not exists (select 1 from h where h.key_tag = a.key_tag)))""")
def bonds_of_first_chains(spark: SparkSession, d: str) -> DataFrame:
    """Bonds whose first atom is in the first chain of some entity (elements stand for entities)."""
    u = _unique_atoms(spark, d)
    chains = u.where("element is not null and chain_id is not null").groupBy(
        "key_tag", F.col("element").alias("entity_id"), "chain_id"
    ).agg(F.min("serial_id").alias("chain_ordinal"))
    return select.bonds_of_chains(table(spark, d, "model_bond"), u, chains, ["key_tag"]).select("row_id")


@query(
    "select exists (select 1 from model_component where id in ('A', 'C', 'G', 'U')) as has_rna, exists (select 1 from model_component where id in ('DA', 'DC', 'DG', 'DT')) as has_dna, exists (select 1 from model_component where id = 'none such') as has_none"
)
def nucleic_presence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "model_component")
    has = [select.has_any(c, F.col("id").isin(v)) for v in (["A", "C", "G", "U"], ["DA", "DC", "DG", "DT"], ["none such"])]
    return spark.createDataFrame([tuple(has)], "has_rna boolean, has_dna boolean, has_none boolean")


@query("""with b as (select row_id, (coalesce(bond_key, 0) & 65535)::bigint as b, (coalesce(bond_order, 0) & 255)::bigint as c, (coalesce(is_special_bond, 0) & 1)::bigint as f
from model_bond)
select class_key, group_key, count(*) as n, min(row_id) as first_row from (select row_id, 'simple' as class_key, b + f * 65536 as group_key from b
union all select row_id, 'component', c + b * 256 from b) group by 1, 2""")
def bond_key_groups(spark: SparkSession, d: str) -> DataFrame:
    """Bonds grouped by the packed keys of both classes at once (orders stand for components)."""
    b = table(spark, d, "model_bond").na.fill(0, ["bond_key", "bond_order", "is_special_bond"])
    return keys.bond_classes(b, component_key="bond_order").groupBy("class_key", "group_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")
    )


def _codes_sql(pairs: dict[str, int]) -> str:
    quote = chr(39)
    return ", ".join(f"({quote}{n.replace(quote, quote * 2)}{quote}, {c})" for n, c in pairs.items())


@query(
    f"with t(id, code) as (values {_codes_sql(codes.SPOTS)}) select a.atom_id, coalesce(max(t.code), 0)::bigint as code, count(*) as n from model_component_atom a left join t on t.id = a.atom_id group by 1"
)
def atom_name_codes(spark: SparkSession, d: str) -> DataFrame:
    """Built-in codes of the atom names in the dictionary, 0 for others."""
    named = lookup.dictionary(table(spark, d, "model_component_atom"), "atom_id", codes.code_table(spark, codes.spot_codes()), "id", "code")
    return named.groupBy("atom_id").agg(F.max("code").cast("long").alias("code"), F.count(F.lit(1)).alias("n"))


@query(
    f"with t(id, code) as (values {_codes_sql(codes.structure_codes())}) select a.structure, max(t.id) as label, count(*) as n from model_atom a left join t on t.code = a.structure group by 1"
)
def structure_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the structure codes."""
    t = codes.code_table(spark, codes.structure_codes()).select(F.col("code").cast("int").alias("structure"), F.col("id").alias("label"))
    return table(spark, d, "model_atom").join(t, "structure", "left").groupBy("structure").agg(
        F.max("label").alias("label"), F.count(F.lit(1)).alias("n")
    )


# statistics of empty and of matrix input


@query("""select key_tag, round(coalesce(avg(v), 0), 6) as mean, round(coalesce(stddev_samp(v), 0), 6) as sd, min(v) is null as no_low, max(v) is null as no_high, coalesce(min(v), 0) as low
from (select key_tag, case when element = 16 and temperature between 0 and 100 then temperature end as v from model_atom) group by 1""")
def empty_group_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the sulphurs of each model; most models have none, so mean and sd are 0 and the extremes NaN."""
    v = F.when((F.col("element") == 16) & F.col("temperature").between(0, 100), F.col("temperature"))
    g = table(spark, d, "model_atom").groupBy("key_tag").agg(
        _r(stats.mean(v), "mean"), _r(stats.sd(v), "sd"), stats.minimum(v).alias("lo"), stats.maximum(v).alias("hi")
    )
    return g.select(
        "key_tag", "mean", "sd", F.isnan("lo").alias("no_low"), F.isnan("hi").alias("no_high"),
        F.when(F.isnan("lo"), 0.0).otherwise(F.col("lo")).alias("low")
    )


@query(
    """with v as (select label, unnest(range(len(embedding)))::int as dimension, unnest(embedding)::double as value from embeddings) select label, dimension, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(median(value), 6) as median from v group by 1, 2"""
)
def matrix_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation and median of each column of the embedding matrix, by label."""
    v = table(spark, d, "embeddings").select(
        "label", F.posexplode("embedding").alias("dimension", "v")
    ).withColumn("value", F.col("v").cast("double"))
    one = v.groupBy("label", "dimension").agg(_r(stats.mean(F.col("value")), "mean"), _r(stats.sd(F.col("value")), "sd"))
    m = ordering.percentiles(v, ["label", "dimension"], "value", {"m": 0.5}).select("label", "dimension", _r(F.col("m"), "median"))
    return one.join(m, ["label", "dimension"])


# estimates


@query(
    "select p_partkey as l_partkey, 5::bigint as n, round(y / (1 + x * x), 6) as b0, round(x * y / (1 + x * x), 6) as b1 from (select p_partkey, p_size::double as x, p_retailprice / 100.0::double as y from part)"
)
def singular_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines through five rows at one place: of all that fit, the coefficients of least norm."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100.0).alias("y"),
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")
    )
    f = robust.fit_local(p, ["l_partkey"], "x", "y", 0.0)
    return f.select("l_partkey", "n", _r(F.col("b0"), "b0"), _r(F.col("b1"), "b1"))


@query("""with e as (select p_partkey, p_retailprice / 100.0::double as a, p_size / 10.0::double as w
from part), i as (select *, a * pow(2 * pi() * w * w, -1.5) as v from e)
select p_partkey, round(a, 6) as amplitude, round(w, 6) as width, round(v, 8) as intensity, round(sqrt(pow(pow(2 * pi() * w * w, -1.5) * 0.1, 2) + pow(3 * pow(2 * pi(), -1.5) * a * pow(w, -4) * 0.05, 2)), 8) as intensity_sigma
from i""")
def intensity_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The three parameters of a profile by number, and the error of the intensity."""
    e = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 100.0).alias("a"), (F.col("p_size") / F.lit(10.0)).alias("w"))
    a, w = F.col("a"), F.col("w")
    return e.select(
        "p_partkey",
        *[_r(gauss.parameter(i, a, w), n, digits) for i, n, digits in ((0, "amplitude", 6), (1, "width", 6), (2, "intensity", 8))],
        _r(gauss.intensity_sigma(a, F.lit(0.1), w, F.lit(0.05)), "intensity_sigma", 8)
    )


@query(
    """with b as (select o_orderkey, 1.0::double + o_custkey % 7 as a, 1.0::double + o_orderkey % 5 as r from orders) select o_orderkey, round(a / r, 6) as ratio, round(a / r * sqrt(pow(sqrt(0.1 * a) / a, 2) + pow(sqrt(0.2 * r) / r, 2)), 6) as ratio_sigma from b"""
)
def rooted_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratios whose errors are given as variances."""
    o = table(spark, d, "orders").select(
        "o_orderkey", (F.lit(1.0) + F.col("o_custkey") % 7).alias("a"), (F.lit(1.0) + F.col("o_orderkey") % 5).alias("r")
    )
    q, s = gauss.ratio(F.col("a"), 0.1 * F.col("a"), F.col("r"), 0.2 * F.col("r"), True)
    return o.select("o_orderkey", _r(q, "ratio"), _r(s, "ratio_sigma"))


_ERF = "(with_n.h / 3) * list_sum(list_transform(range(401), lambda i: (case when i = 0 or i = 400 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(i * with_n.h, 2)))) * 2 / sqrt(pi())"


@query(f"""with p as (select p_partkey, p_size / 20.0::double as r, (p_size % 5 - 2) / 4.0::double as q
from part), with_n as (select *, r / (0.5 * sqrt(2::double)) / 400 as h from p),
d as (select p_partkey, r, q, case when r > 3 then 0 else 14.39964393::double / r * {_ERF} end as delta from with_n),
g as (select *, 1 / (8 * pi() * pi()) as u from d),
f as (select *, 47.87764193::double * (1.0 * pow(2 * pi() * (2 * u + 0.25), -1.5) * exp(-r * r / (2 * u + 0.25) / 2) + 2.0 * pow(2 * pi() * (9 * u + 0.25), -1.5) * exp(-r * r / (9 * u + 0.25) / 2)) as neutral,
 47.87764193::double * (0.5 * pow(2 * pi() * (3 * u + 0.25), -1.5) * exp(-r * r / (3 * u + 0.25) / 2)) as plus, 47.87764193::double * (1.5 * pow(2 * pi() * (4 * u + 0.25), -1.5) * exp(-r * r / (4 * u + 0.25) / 2)) as minus from g)
select p_partkey, round(delta, 6) as delta, round(neutral + q * case when q >= 0 then plus + delta - neutral else neutral - minus + delta end, 6) as value from f""")
def charged_potential(spark: SparkSession, d: str) -> DataFrame:
    """Charge term and potential between a neutral and two charged parameter sets; the SQL integrates the error function."""
    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") / F.lit(20.0)).alias("r"), ((F.col("p_size") % 5 - 2) / F.lit(4.0)).alias("q")
    )
    arrays = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    v = potential.five_gauss_charged(
        (arrays(1, 2), arrays(2, 9)), (arrays(0.5), arrays(3)), (arrays(1.5), arrays(4)), F.col("r"), F.col("q"), 0.5
    )
    return p.select("p_partkey", _r(potential.charge_delta(F.col("r"), F.lit(1.0), 0.5), "delta"), _r(v, "value"))


_GROUPS = "select p_brand, (p_size % 5)::int as group_key, count(*) as n_members, count(*) filter (p_retailprice > 1500) as n_outliers, avg(ln(p_retailprice)) as b0, 1 + avg(p_size) / 10 as b1, min(ln(p_retailprice)) as b0m, 1 + min(p_size) / 10.0::double as b1m from part group by 1, 2"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    g = p.groupBy("p_brand", (F.col("p_size") % 5).cast("int").alias("group_key")).agg(
        F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("p_retailprice") > 1500).alias("n_outliers"),
        F.avg(F.ln("p_retailprice")).alias("b0_mean"), (1 + F.avg("p_size") / 10).alias("b1_mean"),
        F.min(F.ln("p_retailprice")).alias("b0_prior"), (1 + F.min("p_size") / F.lit(10.0)).alias("b1_prior")
    )
    return g.select(
        "*", F.col("b0_mean").alias("b0_mdpde"), F.col("b1_mean").alias("b1_mdpde"), F.lit(0.02).alias("l00"), F.lit(0.03).alias("l11"),
        F.lit(0.001).alias("l01")
    )


@query(f"""with g as ({_GROUPS}) select p_brand, group_key, n_members, n_outliers, round(exp(b0) * pow(2 * pi() / b1, 1.5), 6) as amplitude_mean, round(pow(b1, -0.5), 6) as width_mean, round(exp(b0m) * pow(2 * pi() / b1m, 1.5), 6) as amplitude_prior, round(pow(b1m, -0.5), 6) as width_prior,
round(sqrt(pow(2 * pi(), 3) * exp(2 * b0m) * pow(b1m, -5) * (b1m * b1m * 0.02 + 2.25 * 0.03 - 3 * b1m * 0.001)), 5) as sigma_amplitude, round(sqrt(0.25 * pow(b1m, -3) * 0.03), 6) as sigma_width from g""")
def group_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Amplitudes, widths and errors of groups from their mean and prior lines, with member and outlier counts."""
    e = reports.group_estimates(_groups(spark, d), ["p_brand", "group_key"])
    return e.select(
        "p_brand", "group_key", "n_members", "n_outliers",
        *[_r(F.col(c), c) for c in ("amplitude_mean", "width_mean", "amplitude_prior", "width_prior")],
        _r(F.col("sigma_amplitude"), "sigma_amplitude", 5), _r(F.col("sigma_width"), "sigma_width")
    )


@query("""select p_partkey, round(exp(b0) * pow(2 * pi() / b1, 1.5), 6) as amplitude, round(pow(b1, -0.5), 6) as width, round(sqrt(pow(2 * pi(), 3) * exp(2 * b0) * pow(b1, -5) * (b1 * b1 * 0.02 + 2.25 * 0.03 - 3 * b1 * 0.001)), 5) as sigma_amplitude, round(sqrt(0.25 * pow(b1, -3) * 0.03), 6) as sigma_width, p_size > 40 as is_outlier
from (select *, ln(p_retailprice) as b0, 1 + p_size / 7.0::double as b1 from part)""")
def member_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Amplitudes, widths and errors of members from their posterior lines."""
    p = table(spark, d, "part").select(
        "p_partkey", F.ln("p_retailprice").alias("b0_posterior"), (1 + F.col("p_size") / F.lit(7.0)).alias("b1_posterior"),
        F.lit(0.02).alias("v00"), F.lit(0.03).alias("v11"), F.lit(0.001).alias("v01"), F.lit(0.0).alias("distance"),
        (F.col("p_size") > 40).alias("is_outlier")
    )
    e = reports.posterior_estimates(p, ["p_partkey"])
    return e.select(
        "p_partkey", _r(F.col("amplitude"), "amplitude"), _r(F.col("width"), "width"), _r(F.col("sigma_amplitude"), "sigma_amplitude", 5),
        _r(F.col("sigma_width"), "sigma_width"), "is_outlier"
    )


_CLASSED = "select row_id, 'element' as class_key, element::bigint as group_key, temperature > 60 and not isnan(temperature) as is_outlier, temperature from model_atom"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_atom").select(
        "row_id", F.lit("element").alias("class_key"), F.col("element").cast("long").alias("group_key"),
        ((F.col("temperature") > 60) & ~F.isnan("temperature")).alias("is_outlier"), "occupancy"
    )


@query(
    f"with m as ({_CLASSED}) select 'member' as kind, row_id from m where group_key = 6 union all select 'outlier', row_id from m where group_key = 6 and is_outlier"
)
def group_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of one group, and its outliers alone."""
    m = _members(spark, d)
    one = reports.members(m, "element", 6).select(F.lit("member").alias("kind"), "row_id")
    return one.unionAll(reports.members(m, "element", 6, True).select(F.lit("outlier").alias("kind"), "row_id"))


@query(
    f"""with m as ({_CLASSED}) select class_key, group_key, count(*) as n_members, count(*) filter (is_outlier) as n_outliers from m
where group_key is not null group by 1, 2"""
)
def outliers_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Members and outliers of each group."""
    return _members(spark, d).where("group_key is not null").groupBy("class_key", "group_key").agg(
        F.count(F.lit(1)).alias("n_members"), F.count_if("is_outlier").alias("n_outliers")
    )


@query(
    f"""with m as ({_CLASSED}) select w.class_key, w.group_key
from (values ('element', 6::bigint), ('element', 999::bigint), ('other', 6::bigint)) w(class_key, group_key) where exists (select 1 from m
where m.class_key = w.class_key and m.group_key = w.group_key)"""
)
def available_groups(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("element", 6), ("element", 999), ("other", 6)], "class_key string, group_key long")
    return reports.available(_members(spark, d), wanted)


@query("""select l_suppkey, arg_min(l_tax, (l_orderkey, l_linenumber, l_partkey)) as alpha from lineitem group by 1""")
def first_member_alpha(spark: SparkSession, d: str) -> DataFrame:
    """The value of each group's first member, 0 for a group without one."""
    li = table(spark, d, "lineitem").withColumn("member", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return reports.first_member_value(li, ["l_suppkey"], "member", "l_tax", "alpha")


@query(
    f"""with g as ({_GROUPS}), c as (select distinct p_brand, group_key, row_number() over (order by -regexp_extract(p_brand, '([0-9]+)$', 1)::int, group_key) as ordinal
from (select distinct p_brand, (p_size % 5)::int as group_key from part where p_size > 10)) select c.ordinal, g.p_brand, g.group_key, g.n_members
from c join g on g.p_brand = c.p_brand and g.group_key = c.group_key"""
)
def groups_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order of a catalogue (here by brand, backwards)."""
    c = table(spark, d, "part").where("p_size > 10").select("p_brand", (F.col("p_size") % 5).cast("int").alias("group_key")).distinct()
    named = ordering.numbered(
        c.withColumn("backwards", -F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")), [], ["backwards", "group_key"], "ordinal"
    ).drop("backwards")
    return reports.in_catalogue_order(
        _groups(spark, d), named, ["p_brand", "group_key"]
    ).select("ordinal", "p_brand", "group_key", "n_members")


@query("""with f as (select p_partkey, ln(p_retailprice) as b0, p_size / 7.0::double as b1 from part), x as (select unnest([0.0, 0.25, 0.5, 1.0, 2.0]::double[]) as x)
select p_partkey, 'line' as form, x, round(b0 + b1 * x, 6) as y from f, x
union all select p_partkey, 'gauss2', x, round(exp(b0) * 2 * pi() / b1 * (b1 / (2 * pi())) * exp(-b1 * x * x / 2), 6) from f, x
union all select p_partkey, 'gauss3', x, round(exp(b0 - b1 * x * x / 2), 6) from f, x""")
def fitted_curves(spark: SparkSession, d: str) -> DataFrame:
    """Line and Gaussian curves (in two and three dimensions) of all fits at five places."""
    f = table(spark, d, "part").select("p_partkey", F.ln("p_retailprice").alias("b0"), (F.col("p_size") / F.lit(7.0)).alias("b1"))
    xs, out = [0.0, 0.25, 0.5, 1.0, 2.0], None
    for name, form, n in (("line", "line", 3), ("gauss2", "gauss", 2), ("gauss3", "gauss", 3)):
        one = reports.curves(f, ["p_partkey"], xs, form=form, dimension=n).select(
            "p_partkey", F.lit(name).alias("form"), "x", _r(F.col("y"), "y")
        )
        out = one if out is None else out.unionAll(one)
    return out


@query(
    """select 'sphere' as shape, 0.9::double as distance, 0.0::double as x, 0.0::double as y, 0.0::double as z, 0.333::double as x2, null::double as height2 union all select 'cylinder', null, 0.0, 0.0, 0.0, null, 0.083"""
)
def sample_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Moments of the samples around all points: radii of spheres are uniform, squared radii and heights of cylinders."""
    v = table(spark, d, "embeddings").select("vec_id", *[F.lit(0.0).alias(c) for c in ("x", "y", "z", "vx", "vy")], F.lit(1.0).alias("vz"))
    near = lambda c, digits: (F.round(F.avg(c), digits) + F.lit(0.0))
    s = samplers.sphere(v, "vec_id", 400, 0.3, 1.5, seed=3).selectExpr(
        "*", "px / distance as ux", "py / distance as uy", "pz / distance as uz"
    )
    c = samplers.cylinder(v, "vec_id", 400, 0.0, 1.0, 1.0, seed=4)
    null = F.lit(None).cast("double")
    low = lambda c, digits, want, slack: F.when(F.abs(F.avg(c) - want) < slack, F.lit(float(want))).otherwise(near(c, digits))
    one = s.agg(
        low("distance", 3, 0.9, 0.005).alias("distance"), *[low(f"u{a}", 3, 0.0, 0.005).alias(a) for a in "xyz"],
        low(F.col("ux") * F.col("ux"), 3, 0.333, 0.005).alias("x2"), null.alias("height2")
    ).select(F.lit("sphere").alias("shape"), "*")
    square = F.avg(F.col("distance") * F.col("distance"))
    two = c.agg(
        F.when(F.abs(square - 0.5) < 0.005, null).otherwise(square).alias("distance"),
        *[low(f"p{a}", 3, 0.0, 0.005).alias(a) for a in "xyz"], null.alias("x2"),
        low(F.col("pz") * F.col("pz"), 3, 0.083, 0.005).alias("height2")
    ).select(F.lit("cylinder").alias("shape"), "*")
    return one.unionAll(two)


# numbering and places


@query(
    "select row_id, (row_number() over (order by key_tag, serial_id, row_id))::bigint as serial_no, (row_number() over (partition by component_id order by row_id))::bigint as no_of_component from model_atom where key_tag is not null"
)
def numbered_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms numbered over the whole table and within their component, a few of which hold most of them."""
    a = table(spark, d, "model_atom").where("key_tag is not null").select("row_id", "key_tag", "serial_id", "component_id")
    return ordering.numbered(
        ordering.numbered(a, [], ["key_tag", "serial_id", "row_id"], "serial_no"), ["component_id"], ["row_id"], "no_of_component"
    ).select("row_id", "serial_no", "no_of_component")


@query("""with b as (select min(position_x) - 5 as lx, max(position_x) + 5 as hx, min(position_y) - 5 as ly, max(position_y) + 5 as hy, min(position_z) - 5 as lz, max(position_z) + 5 as hz
from model_atom where element > 0)
select ceil((hx - lx) / 0.5)::bigint as nx, ceil((hy - ly) / 0.5)::bigint as ny, ceil((hz - lz) / 0.5)::bigint as nz, floor(lx / 0.5) * 0.5::double as ox, floor(ly / 0.5) * 0.5::double as oy, floor(lz / 0.5) * 0.5::double as oz
from b""")
def grid_of_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The grid that holds all atoms of known elements with a margin of 5."""
    a = table(spark, d, "model_atom").where("element > 0")
    b = a.agg(*[f(f"position_{c}").alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))]).first()
    g = grid.Grid.around([b[f"l{c}"] for c in "xyz"], [b[f"h{c}"] for c in "xyz"], 0.5, 5.0)
    return spark.createDataFrame([(*map(int, g.size), *map(float, g.origin))], "nx long, ny long, nz long, ox double, oy double, oz double")


@query(f"""with u as ({_UNIQUE}), j as (select b.key_tag, b.atom_serial_id_1 as serial_id, b.atom_serial_id_2 as other, y.position_x - x.position_x as u0, y.position_y - x.position_y as u1, y.position_z - x.position_z as u2
 from model_bond b join u x on x.key_tag = b.key_tag and x.serial_id = b.atom_serial_id_1 join u y on y.key_tag = b.key_tag and y.serial_id = b.atom_serial_id_2),
f as (select key_tag, serial_id, arg_min({{'u0': u0, 'u1': u1, 'u2': u2}}, other) as u from j where u0 * u0 + u1 * u1 + u2 * u2 > 1e-12 group by 1, 2),
e as (select a.key_tag, a.serial_id, f.u.u0 as u0, f.u.u1 as u1, f.u.u2 as u2 from u a left join f on f.key_tag = a.key_tag and f.serial_id = a.serial_id)
select key_tag, serial_id, round(coalesce(case when u0 * u0 + u1 * u1 < 1e-12 then 0 else u1 end, 0), 6) + 0 as vx, round(coalesce(case when u0 * u0 + u1 * u1 < 1e-12 then u2 else -u0 end, 0), 6) + 0 as vy, round(coalesce(case when u0 * u0 + u1 * u1 < 1e-12 then -u1 else 0 end, 1), 6) + 0 as vz
from e where key_tag is not null""")
def viewing_planes(spark: SparkSession, d: str) -> DataFrame:
    """The normal of the viewing plane of every atom, from its first bond."""
    u = _unique_atoms(spark, d).select(
        "key_tag", "serial_id", *[F.col(f"position_{c}").alias(c) for c in "xyz"]
    ).where("key_tag is not null")
    ends = table(spark, d, "model_bond").select(
        "key_tag", F.col("atom_serial_id_1").alias("serial_id"), F.col("atom_serial_id_2").alias("order")
    )
    near = ends.join(
        u.select("key_tag", F.col("serial_id").alias("order"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz")),
        ["key_tag", "order"]
    )
    v = samplers.viewing_frame(u, near, ["key_tag", "serial_id"])
    return v.select("key_tag", "serial_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("vx", "vy", "vz")])


# requests


_DEFAULTS = [
    ("potential_analysis", "samples", "1500"), ("potential_analysis", "sample_high", "1.5"), ("potential_analysis", "fit_high", "1.0"),
    ("potential_analysis", "alpha_r", "0.1"), ("potential_analysis", "alpha_g", "0.2"), ("map_simulation", "cutoff", "5.0"),
    ("map_simulation", "spacing", "0.5"),
    ("map_simulation", "potential_model", "five_gauss_charge"), ("map_simulation", "partial_charge", "partial"),
    ("result_dump", "printer", "gauss"), ("position_estimation", "iterations", "15"), ("position_estimation", "neighbours", "20"),
    ("map_visualization", "size", "100"), ("map_visualization", "width", "5.0"),
    ("model_test", "alpha_r", "0.1"), ("model_test", "alpha_g", "0.2"), ("model_test", "fit_high", "1.0"),
]


@query("select * from (values " + ", ".join(f"('{c}', '{o}', '{v}')" for c, o, v in _DEFAULTS) + ") t(command, option, default_value)")
def command_options(spark: SparkSession, d: str) -> DataFrame:
    """Defaults of the commands' main options, from the one schema that describes all of them."""
    every = commands.option_table(spark)
    named = spark.createDataFrame([(c, o) for c, o, _ in _DEFAULTS], "command string, option string")
    return every.join(named, ["command", "option"]).select("command", "option", "default_value")


@query(
    """select * from (values ('map_simulation', 'cutoff', false), ('map_simulation', 'model_file', true), ('map_simulation', 'widths', true), ('model_test', 'study', true), ('potential_analysis', 'fit_low', true), ('potential_analysis', 'map_file', true), ('potential_analysis', 'model_file', true), ('potential_analysis', 'samples', false), ('result_dump', 'key_tags', true), ('result_dump', 'printer', true)) t(command, option, is_error)"""
)
def request_issues(spark: SparkSession, d: str) -> DataFrame:
    """What the checks say of faulty requests: values put right (no error) and contradictions."""
    bad = {
        "potential_analysis": commands.PotentialAnalysis(model_file="/none", map_file="/none", samples=0, fit_low=2.0),
        "map_simulation": commands.MapSimulation(model_file="/none", cutoff=-1.0, widths=(), potential_model="2"),
        "result_dump": commands.ResultDump(printer="9"), "model_test": commands.ModelTest(study="9")
    }
    rows = [(name, i.option, i.is_error) for name, r in bad.items() for i in commands.run(spark, r).issues]
    return spark.createDataFrame(rows, "command string, option string, is_error boolean")
