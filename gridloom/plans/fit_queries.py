"""Queries of the estimators. Those with SQL, which can only unroll a fixed number of iterations, stop after as many and are
there for the comparison; those named ``_converged`` and all that have no SQL iterate to the operators' tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import gauss
from gridloom.operators import group_model, robust
from gridloom.session import materialize, table

QUERIES, SQL = {}, {}
STEPS, GROUP_STEPS, ALPHA, ALPHA_GROUP = 6, 5, 0.1, 0.2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", (F.lit(-0.5) * F.pow(F.col("l_discount") * 10, F.lit(2.0))).alias("x"),
        F.ln("l_extendedprice").alias("y")
    )


_ROWS = "rows_ as materialized (select l_partkey as k, l_orderkey, l_linenumber, (-0.5)::double * pow(l_discount * 10, 2) as x, ln(l_extendedprice) as y from lineitem)"
_SUMS = "count(*) as n, sum({w}) as s, sum({w} * x) as sx, sum({w} * x * x) as sxx, sum({w} * y) as sy, sum({w} * x * y) as sxy"
_LINE = "(sxx * sy - sx * sxy) / nullif(s * sxx - sx * sx, 0) as b0, (s * sxy - sx * sy) / nullif(s * sxx - sx * sx, 0) as b1"


def local_sql(rows: str, key: str, steps: int, alpha: float) -> str:
    """CTEs: t0 (least squares), w1 .. wK and t1 .. tK (one iteration each); rows must have key, x, y."""
    out = [
        f"a0 as materialized (select {key}, n, {_LINE} from (select {key}, {_SUMS.format(w='1.0::double')} from {rows} group by {key}))",
        f"t0 as materialized (select a0.{key}, any_value(a0.n) as n, any_value(b0) as b0, any_value(b1) as b1, sum(pow(y - b0 - b1 * x, 2)) / (any_value(n) - 1) as s2 from {rows} r join a0 on r.{key} = a0.{key} where a0.n > 1 group by a0.{key})",
    ]
    for i in range(1, steps + 1):
        p = i - 1
        out += [
            f"w{i} as materialized (select r.{key}, x, y, greatest(exp(-0.5 * {alpha!r}::double * pow(y - b0 - b1 * x, 2) / s2), 1e-8) as w from {rows} r join t{p} t on r.{key} = t.{key})",
            f"a{i} as materialized (select {key}, n, s, {_LINE} from (select {key}, {_SUMS.format(w='w')} from w{i} group by {key}))",
            f"t{i} as materialized (select a.{key}, any_value(a.n) as n, any_value(b0) as b0, any_value(b1) as b1, sum(w * pow(y - b0 - b1 * x, 2)) / (any_value(s) - any_value(n) * {alpha!r}::double * pow(1 + {alpha!r}::double, -1.5)) as s2 from w{i} w join a{i} a on w.{key} = a.{key} group by a.{key})",
        ]
    return ", ".join(out)


_LOCAL = f"with {_ROWS}, {local_sql('rows_', 'k', STEPS, ALPHA)}"
_PICK = """select a.k as l_partkey, t.n, round(a.b0, 6) as b0_ols, round(a.b1, 6) as b1_ols, round(t.b0, 6) as b0, round(t.b1, 6) as b1, round(t.s2, 6) as sigma2
from t{0} t join a0 a on a.k = t.k"""


def _fits(spark: SparkSession, d: str, kernel_rows: int = robust.KERNEL_ROWS) -> DataFrame:
    return robust.fit_local(_rows(spark, d), ["l_partkey"], "x", "y", ALPHA, STEPS, 0.0, kernel_rows=kernel_rows).where("n > 1")


@query(_LOCAL + " " + _PICK.format(STEPS))
def robust_lines(spark: SparkSession, d: str) -> DataFrame:
    """A robust line for each part from its order lines."""
    return _fits(spark, d).select("l_partkey", "n", *_r("b0_ols", "b1_ols", "b0", "b1", "sigma2"))


@query(f"""with rows_ as materialized (select l_returnflag as k, (-0.5)::double * pow(l_discount * 10, 2) as x, ln(l_extendedprice) as y
from lineitem), {local_sql('rows_', 'k', 4, ALPHA)}
select k as l_returnflag, n, round(b0, 6) as b0, round(b1, 6) as b1, round(s2, 6) as sigma2 from t4""")
def robust_lines_of_large_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same by sums over the cluster, for groups too large for one task."""
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", (F.lit(-0.5) * F.pow(F.col("l_discount") * 10, F.lit(2.0))).alias("x"), F.ln("l_extendedprice").alias("y")
    )
    return robust.fit_local(
        rows, ["l_returnflag"], "x", "y", ALPHA, 4, 0.0, kernel_rows=100
    ).select("l_returnflag", "n", *_r("b0", "b1", "sigma2"))


@query(_LOCAL + f""", c as (select k, x, y, w, s2, n, sum(1 / w) over (partition by k) as si from (select w.k, x, y, w, t.s2, t.n from w{STEPS} w
join t{STEPS} t on w.k = t.k))
select k as l_partkey, round(sum(w * si / (n * s2)), 4) as g00, round(sum(x * w * si / (n * s2)), 4) as g01, round(sum(x * x * w * si / (n * s2)), 4) as g11, round(sum(y * w * si / (n * s2)), 4) as m0, round(sum(x * y * w * si / (n * s2)), 4) as m1
from c group by k""")
def information_sums(spark: SparkSession, d: str) -> DataFrame:
    """The five sums of each part that stand for its rows in the group model."""
    return _fits(spark, d).select("l_partkey", *[F.round(c, 4).alias(c) for c in ("g00", "g01", "g11", "m0", "m1")])


@query(
    f"with {_ROWS} select k as l_partkey, n, round(b0, 6) as b0, round(b1, 6) as b1 from (select k, n, {_LINE} from (select k, {_SUMS.format(w='1.0::double')} from rows_ group by k))"
)
def least_squares_lines(spark: SparkSession, d: str) -> DataFrame:
    return robust.ols(_rows(spark, d), ["l_partkey"], "x", "y").select("l_partkey", "n", *_r("b0", "b1"))


@query(f"""with rows_ as (select l_suppkey as k, l_quantity as x, l_extendedprice as y, 1 / (1 + l_tax) as w from lineitem)
select k as l_suppkey, n, round(b0, 5) as b0, round(b1, 5) as b1 from (select k, n, {_LINE} from (select k, {_SUMS.format(w='w')} from rows_ group by k))""")
def weighted_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return robust.ols(
        li, ["l_suppkey"], "l_quantity", "l_extendedprice", 1 / (1 + F.col("l_tax"))
    ).select("l_suppkey", "n", *[F.round(c, 5).alias(c) for c in ("b0", "b1")])


def _converged(spark: SparkSession, d: str) -> DataFrame:
    return robust.fit_local(_rows(spark, d), ["l_partkey"], "x", "y", ALPHA).where("n > 1")


@query()
def robust_lines_converged(spark: SparkSession, d: str) -> DataFrame:
    """A robust line for each part, iterated to the tolerance."""
    return _converged(spark, d).select("l_partkey", "n", *_r("b0_ols", "b1_ols", "b0", "b1", "sigma2"), "status", "iterations")


@query()
def robust_lines_of_large_groups_converged(spark: SparkSession, d: str) -> DataFrame:
    """The same by sums over the cluster."""
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", (F.lit(-0.5) * F.pow(F.col("l_discount") * 10, F.lit(2.0))).alias("x"), F.ln("l_extendedprice").alias("y")
    )
    return robust.fit_local(rows, ["l_returnflag"], "x", "y", ALPHA, kernel_rows=100).select(
        "l_returnflag", "n", *_r("b0", "b1", "sigma2"), "status", "iterations"
    )


@query()
def information_sums_converged(spark: SparkSession, d: str) -> DataFrame:
    """The five sums of each part under its converged line."""
    return _converged(spark, d).select("l_partkey", *[F.round(c, 4).alias(c) for c in ("g00", "g01", "g11", "m0", "m1")])


def _members(spark: SparkSession, d: str, fits=_converged) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return fits(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_partkey", *group_model.MEMBER_COLUMNS)


def group_sql(steps: int, alpha: float) -> str:
    """CTEs after mem (g, id, b0, b1, g00, g01, g11, m0, m1): mu_i, om_i by iteration, then web, prior and post."""
    out = [
        "u0 as materialized (select g, count(*) as n, median(b0) as u0, median(b1) as u1, 1.0::double as l00, 0.0::double as l01, 1.0::double as l11 from mem group by g)"
    ]
    for i in range(1, steps + 1):
        out += [
            f"""om{i} as materialized (select m.*, u.n, greatest(exp(-0.5 * {alpha!r}::double * ((b0 - u0) * (b0 - u0) * l11 - 2 * (b0 - u0) * (b1 - u1) * l01 + (b1 - u1) * (b1 - u1) * l00) / (l00 * l11 - l01 * l01)), 0.01::double / n) as w
              from mem m join u{i - 1} u on m.g = u.g)""",
            f"v{i} as materialized (select g, any_value(n) as n, sum(w) as s, sum(w * b0) / sum(w) as u0, sum(w * b1) / sum(w) as u1 from om{i} group by g)",
            f"""u{i} as materialized (select o.g, any_value(v.n) as n, any_value(u0) as u0, any_value(u1) as u1, sum(w * (b0 - u0) * (b0 - u0)) / any_value(s - v.n * {alpha!r}::double * pow(1 + {alpha!r}::double, -2)) as l00,
              sum(w * (b0 - u0) * (b1 - u1)) / any_value(s - v.n * {alpha!r}::double * pow(1 + {alpha!r}::double, -2)) as l01, sum(w * (b1 - u1) * (b1 - u1)) / any_value(s - v.n * {alpha!r}::double * pow(1 + {alpha!r}::double, -2)) as l11
              from om{i} o join v{i} v on o.g = v.g group by o.g)""",
        ]
    k = steps
    out += [
        f"""k1 as (select o.g, id, b0, b1, g00, g01, g11, m0, m1, u.n, u0, u1, l00, l01, l11, w / (u.n / sum(1 / w) over (partition by o.g)) / (l00 * l11 - l01 * l01) as f
from om{k} o join u{k} u on o.g = u.g)""",
        "k2 as (select *, l11 * f as k00, -l01 * f as k01, l00 * f as k11 from k1)",
        "k3 as (select *, (g00 + k00) * (g11 + k11) - (g01 + k01) * (g01 + k01) as det from k2)",
        "k4 as (select *, (g11 + k11) / det as c00, -(g01 + k01) / det as c01, (g00 + k00) / det as c11 from k3)",
        "k5 as (select *, k00 * c00 + k01 * c01 as h00, k00 * c01 + k01 * c11 as h01, k01 * c00 + k11 * c01 as h10, k01 * c01 + k11 * c11 as h11 from k4)",
        """pr as (select g, sum(h00 * m0 + h01 * m1) as q0, sum(h10 * m0 + h11 * m1) as q1, sum(h00 * g00 + h01 * g01) as d00, sum(h00 * g01 + h01 * g11) as d01, sum(h10 * g00 + h11 * g01) as d10, sum(h10 * g01 + h11 * g11) as d11 from k5 group by g)""",
        """prior as materialized (select pr.g, case when n = 2 then u0 else (d11 * q0 - d01 * q1) / (d00 * d11 - d01 * d10) end as p0, case when n = 2 then u1 else (d00 * q1 - d10 * q0) / (d00 * d11 - d01 * d10) end as p1 from pr join u%d u on pr.g = u.g)""" % k,
        """post as materialized (select k.*, p0, p1, c00 * (m0 + k00 * u0 + k01 * u1) + c01 * (m1 + k01 * u0 + k11 * u1) as b0p, c01 * (m0 + k00 * u0 + k01 * u1) + c11 * (m1 + k01 * u0 + k11 * u1) as b1p from k5 k join prior p on k.g = p.g)""",
        "outl as (select *, ((b0p - p0) * (b0p - p0) * l11 - 2 * (b0p - p0) * (b1p - p1) * l01 + (b1p - p1) * (b1p - p1) * l00) / (l00 * l11 - l01 * l01) as dist from post)",
    ]
    return ", ".join(out)


_MEM = f"""{_LOCAL}, c as (select k, x, y, w, s2, n, sum(1 / w) over (partition by k) as si from (select w.k, x, y, w, t.s2, t.n from w{STEPS} w
join t{STEPS} t on w.k = t.k)),
inf as (select k, sum(w * si / (n * s2)) as g00, sum(x * w * si / (n * s2)) as g01, sum(x * x * w * si / (n * s2)) as g11, sum(y * w * si / (n * s2)) as m0, sum(x * y * w * si / (n * s2)) as m1
from c group by k),
mem as materialized (select p_brand as g, t.k as id, b0, b1, g00, g01, g11, m0, m1 from t{STEPS} t join inf on t.k = inf.k
join part on p_partkey = t.k), {group_sql(GROUP_STEPS, ALPHA_GROUP)}"""


def _posterior(spark: SparkSession, d: str) -> DataFrame:
    return group_model.fit_groups(materialize(_members(spark, d, _fits)), ["p_brand"], "l_partkey", ALPHA_GROUP, GROUP_STEPS, 0.0)


def _posterior_converged(spark: SparkSession, d: str) -> DataFrame:
    return group_model.fit_groups(materialize(_members(spark, d)), ["p_brand"], "l_partkey", ALPHA_GROUP)


@query(
    _MEM + " select g as p_brand, count(*) as n_members, count(*) filter (dist > -2 * ln(0.01::double)) as n_outliers, round(avg(b0), 5) as b0_mean, round(any_value(u0), 5) as b0_mdpde, round(any_value(u1), 5) as b1_mdpde, round(any_value(p0), 5) as b0_prior, round(any_value(p1), 5) as b1_prior, round(any_value(l00), 5) as l00, round(any_value(l01), 5) as l01, round(any_value(l11), 5) as l11 from outl group by g"
)
def group_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Robust mean, prior and spread of the parts of each brand."""
    g = group_model.group_rows(_posterior(spark, d), ["p_brand"])
    return g.select(
        "p_brand", "n_members", "n_outliers",
        *[F.round(c, 5).alias(c) for c in ("b0_mean", "b0_mdpde", "b1_mdpde", "b0_prior", "b1_prior", "l00", "l01", "l11")]
    )


@query(
    _MEM + " select g as p_brand, id as l_partkey, round(b0p, 5) as b0_posterior, round(b1p, 5) as b1_posterior, round(c00, 5) as v00, round(c01, 5) as v01, round(c11, 5) as v11, round(dist, 4) as distance, dist > -2 * ln(0.01::double) as is_outlier from outl"
)
def member_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Shrunk coefficients, their covariance and the outlier flag of each part."""
    return _posterior(spark, d).select(
        "p_brand", "l_partkey", *[F.round(c, 5).alias(c) for c in ("b0_posterior", "b1_posterior", "v00", "v01", "v11")],
        F.round("distance", 4).alias("distance"), "is_outlier"
    )


@query()
def group_estimates_converged(spark: SparkSession, d: str) -> DataFrame:
    """Robust mean, prior and spread of the parts of each brand, parts and brands iterated to the tolerance."""
    g = group_model.group_rows(_posterior_converged(spark, d), ["p_brand"])
    return g.select(
        "p_brand", "n_members", "n_outliers",
        *[F.round(c, 5).alias(c) for c in ("b0_mean", "b0_mdpde", "b1_mdpde", "b0_prior", "b1_prior", "l00", "l01", "l11")], "status"
    )


@query()
def member_posteriors_converged(spark: SparkSession, d: str) -> DataFrame:
    """Shrunk coefficients, their covariance and the outlier flag of each part, from converged estimates."""
    return _posterior_converged(spark, d).select(
        "p_brand", "l_partkey", *[F.round(c, 5).alias(c) for c in ("b0_posterior", "b1_posterior", "v00", "v01", "v11")],
        F.round("distance", 4).alias("distance"), "is_outlier"
    )


_ALPHAS = (0.0, 0.3, 0.6)
#: The reference's training grid.
_ALL_ALPHAS = tuple(i / 10 for i in range(11))


def _folds_sql() -> str:
    sides = " union all ".join(
        f"select k * 100 + {a * 10 + f * 2 + s} as k, x, y from ranked where fold {'=' if s == 0 else '<>'} {f}" for a in range(1) for f in range(3) for s in range(2)
    )
    return f"""with ranked as materialized (select l_suppkey as k, l_quantity / 10 as x, ln(l_extendedprice) as y, (row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) % 3 as fold
from lineitem),
    rows_ as materialized ({sides})"""


def _alpha_sql() -> str:
    parts = []
    for a in _ALPHAS:
        parts.append(f"""select k // 100 as l_suppkey, {a!r}::double as alpha, round(sum(e), 5) as error from (
          select k - k % 2 as k, sqrt(pow(max(b0) filter (k % 2 = 0) - max(b0) filter (k % 2 = 1), 2) + pow(max(b1) filter (k % 2 = 0) - max(b1) filter (k % 2 = 1), 2)) as e
          from ({_folds_sql()}, {local_sql('rows_', 'k', 4, a)} select k, b0, b1 from t4) group by 1) group by 1""")
    return " union all ".join(f"({p})" for p in parts)


def _alpha_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_suppkey", (F.col("l_quantity") / 10).alias("x"), F.ln("l_extendedprice").alias("y"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o")
    )


def _alpha_errors(spark: SparkSession, d: str) -> DataFrame:
    return robust.alpha_errors(_alpha_rows(spark, d), ["l_suppkey"], "x", "y", "o", _ALPHAS, 3, 4, 0.0)


def _alpha_errors_converged(spark: SparkSession, d: str) -> DataFrame:
    return robust.alpha_errors(_alpha_rows(spark, d), ["l_suppkey"], "x", "y", "o", _ALL_ALPHAS)


@query(_alpha_sql())
def fold_errors(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validation error of each supplier for several robustness levels."""
    return _alpha_errors(spark, d).select("l_suppkey", "alpha", F.round("error", 5).alias("error"))


@query(f"select min_by(alpha, (error, alpha)) as alpha from (select alpha, sum(error) as error from ({_alpha_sql()}) group by 1)")
def best_robustness(spark: SparkSession, d: str) -> DataFrame:
    """The level of least summed error."""
    return robust.best_alpha(_alpha_errors(spark, d))


@query()
def fold_errors_converged(spark: SparkSession, d: str) -> DataFrame:
    """Error of each supplier over five folds for the whole grid of levels, fits iterated to the tolerance."""
    return _alpha_errors_converged(spark, d).select("l_suppkey", "alpha", F.round("error", 5).alias("error"))


@query()
def best_robustness_converged(spark: SparkSession, d: str) -> DataFrame:
    """The level of least summed error of those."""
    return robust.best_alpha(_alpha_errors_converged(spark, d))


@query()
def half_split_errors(spark: SparkSession, d: str) -> DataFrame:
    """Split-half error of each brand for several robustness levels (splits by a hash)."""
    return group_model.half_split_errors(_members(spark, d), ["p_brand"], "l_partkey", [i / 10 for i in range(11)])




@query()
def robustness_bias(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of robust from least squares lines by level."""
    return robust.alpha_bias(_rows(spark, d), ["l_partkey"], "x", "y", [0.0, 0.1, 0.5])


@query()
def group_robustness_bias(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of robust from plain means of the brands by level."""
    return robust.group_alpha_bias(materialize(_members(spark, d)), ["p_brand"], "l_partkey", [0.0, 0.2, 0.5])


@query("""with b as (select p_partkey, ln(p_retailprice) as b0, p_size / 7.0::double as b1 from part)
select p_partkey, round(exp(b0) * pow(2 * pi() / b1, 1.5), 4) as amplitude, round(pow(b1, -0.5), 6) as width, round(exp(b0) * 2 * pi() / b1, 4) as amplitude_2d,
  round(sqrt(pow(2 * pi(), 3) * exp(2 * b0) * pow(b1, -5) * (b1 * b1 * 0.04::double + 2.25::double * 0.01::double - 3 * b1 * 0.002::double)), 4) as sigma_amplitude, round(sqrt(0.25::double * pow(b1, -3) * 0.01::double), 6) as sigma_width from b""")
def gauss_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Amplitude and width of linear coefficients with their deviations."""
    p = table(spark, d, "part").select("p_partkey", F.ln("p_retailprice").alias("b0"), (F.col("p_size") / F.lit(7.0)).alias("b1"))
    b0, b1 = F.col("b0"), F.col("b1")
    (a, w), (a2, _), (sa, sw) = gauss.gauss_from_beta(b0, b1), gauss.gauss_from_beta(b0, b1, 2), gauss.sigma_from_beta(
        b0, b1, F.lit(0.04), F.lit(0.01), F.lit(0.002)
    )
    return p.select(
        "p_partkey", F.round(a, 4).alias("amplitude"), F.round(w, 6).alias("width"), F.round(a2, 4).alias("amplitude_2d"),
        F.round(sa, 4).alias("sigma_amplitude"), F.round(sw, 6).alias("sigma_width")
    )


@query("""select p_partkey, round(ln(p_retailprice) - 1.5 * ln(2 * pi() * pow(p_size / 10.0::double, 2)), 6) as b0, round(1 / pow(p_size / 10.0::double, 2), 6) as b1,
  round(p_retailprice * pow(2 * pi() * pow(p_size / 10.0::double, 2), -1.5), 6) as intensity, round((p_retailprice - 1000) / 1000, 6) as residual from part""")
def lines_of_gauss(spark: SparkSession, d: str) -> DataFrame:
    """Linear coefficients, intensity and normalized residual of amplitudes and widths."""
    a, w = F.col("p_retailprice"), F.col("p_size") / F.lit(10.0)
    b0, b1 = gauss.beta_from_gauss(a, w)
    return table(spark, d, "part").select(
        "p_partkey", F.round(b0, 6).alias("b0"), F.round(b1, 6).alias("b1"), F.round(gauss.intensity(a, w), 6).alias("intensity"),
        F.round(gauss.normalized_residual(a, F.lit(1000.0)), 6).alias("residual")
    )


@query(
    """select l_orderkey, l_linenumber, 1.0::double as x0, round(-0.5 * pow(l_discount * 10, 2), 6) as x1, round(ln(l_quantity), 6) as y from lineitem where l_discount * 10 between 0 and 0.75 and l_quantity > 0"""
)
def linearized_profile(spark: SparkSession, d: str) -> DataFrame:
    """Linear rows of a profile within the fit range."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("dist"), "l_quantity")
    return gauss.linearize(li, "dist", "l_quantity", 0.0, 0.75).select(
        "l_orderkey", "l_linenumber", "x0", F.round("x1", 6).alias("x1"), F.round("y", 6).alias("y")
    )


@query(
    """select p_partkey, round(a / b, 6) as ratio, round(a / b * sqrt(pow(0.1::double * sqrt(a) / a, 2) + pow(0.2::double / b, 2)), 6) as sigma from (select p_partkey, p_retailprice as a, p_size::double as b from part)"""
)
def ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratios with propagated errors."""
    q, s = gauss.ratio(F.col("p_retailprice"), 0.1 * F.sqrt("p_retailprice"), F.col("p_size").cast("double"), F.lit(0.2))
    return table(spark, d, "part").select("p_partkey", F.round(q, 6).alias("ratio"), F.round(s, 6).alias("sigma"))
