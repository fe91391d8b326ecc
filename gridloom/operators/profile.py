"""Column profiles of tables that arrive in loads, and the loads whose columns are unlike the first load's."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.skew import bounded_join
from gridloom.session import materialize

#: Expected rows of a load that the classifier is fitted on; smaller loads are used whole. Everything else reads all rows.
FIT_ROWS = 4096
#: Bytes of models and score histograms that a worker holds in a scoring scan; more loads take more scans.
SCORE_BYTES = 64_000_000
NEWTON_STEPS = 6
RIDGE = 1e-2
SCORE_BINS = 512
HASH_BUCKETS = 6
#: Standard errors by which an AUC must fall short of a column's smallest change before the load is ruled out, and must
#: exceed 1/2 for the column to count as distinguishable.
SURE = 3.0
#: Rows that a fold of either load must have for a column to be ruled out, and the part of a limit that must be seen.
SURE_ROWS = 100
SEEN = 0.8


@dataclass(frozen=True)
class ColumnRule:
    """What a column's valid values are, and how large a change between loads counts.

    One of ``low``/``high``, ``pattern`` (matched whole) or ``domain`` may say what is valid; without any, every value but
    NaN is. ``mean_change``: difference of the valid means; ``share_change``: half the summed difference of the domain
    shares; null shares count from ``null_change``. Without a domain the shares are those of all values that aren't null, over
    the intervals between ``cuts`` (from a cut on, NaN apart) or over ``buckets`` hash buckets, and must differ by
    ``share_change`` more than two draws from the same values would on average.
    """

    name: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    domain: tuple[str, ...] | None = None
    mean_change: float | None = None
    share_change: float | None = None
    null_change: float = 0.15
    cuts: tuple[float, ...] = ()
    buckets: int = 0

    def n_bins(self) -> int:
        return len(self.cuts) + 2 if self.cuts else self.buckets

    def coded(self) -> Column:
        """What the value's interval or bucket follows from on a worker: the number, or the bucket; null for null."""
        c = F.col(f"`{self.name}`")
        return c.cast("double") if self.cuts else F.when(c.isNotNull(), F.pmod(F.xxhash64(c), F.lit(self.buckets))).cast("double")

    def bins(self, v: pa.Array) -> np.ndarray:
        """Numbers of the intervals or buckets of coded() values; n_bins() for null."""
        x = v.to_numpy(zero_copy_only=False)  # nulls as NaN
        if self.cuts:
            at = np.where(np.isnan(x), len(self.cuts) + 1, np.searchsorted(np.asarray(self.cuts, float), x, side="right"))
        else:
            at = np.nan_to_num(x).astype(int)
        return np.where(np.asarray(v.is_null().to_numpy(zero_copy_only=False), bool), self.n_bins(), at)

    def valid(self) -> Column:
        c = F.col(f"`{self.name}`")
        if self.low is not None:
            return c.between(self.low, self.high) & ~F.isnan(c.cast("double"))
        if self.pattern is not None:
            return c.rlike(rf"\A(?:{self.pattern})\z")
        if self.domain is not None:
            return c.isin(list(self.domain))
        return c.isNotNull()

    def limited(self) -> bool:
        return self.low is not None or self.pattern is not None or self.domain is not None

    def broken(self) -> Column:
        """Not null and not valid."""
        return F.col(f"`{self.name}`").isNotNull() & ~F.coalesce(self.valid(), F.lit(False))

    def smallest_gain(self, now: float = 1.0, head: float = 1.0) -> float:
        """Half of the AUC over 1/2 that the smallest counting change gives at least: what must be excluded. ``now`` and
        ``head`` are the valid shares of the two loads, as only valid rows show a change of means or shares. 0 (nothing is
        ever excluded) where a change can be smaller than any AUC or lie in bins that the features don't tell apart."""
        if self.n_bins() or (self.mean_change is not None and self.low is None):
            return 0.0
        # a gap d among the valid rows is one of at least d times the smaller valid share among all rows
        gains, least = [self.null_change / 2], min(now, head)
        if self.mean_change is not None and self.low is not None:
            gains.append(least * self.mean_change / (self.high - self.low) / 2)
        if self.share_change is not None:
            gains.append(least * self.share_change / 2)
        return min(gains) / 2


def violations(df: DataFrame, table: str, rules: Sequence[ColumnRule], row_id: str = "row_id") -> DataFrame:
    """table_name, column_name STRING, row_id LONG of every value that isn't null and not valid; one scan."""
    named = F.explode(F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))).alias("column_name")
    return df.select(F.lit(table).alias("table_name"), named, F.col(f"`{row_id}`").cast("long").alias("row_id"))


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _fold(row_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{row_id}`"), F.lit(1)), F.lit(2)).cast("int")


def base_aggregates(df: DataFrame, rules: Sequence[ColumnRule], load: str = "load_id", row_id: str = "row_id") -> DataFrame:
    """A row for each load and fold (halves by a hash of the row id): n, and for column i n_null_i, n_valid_i, sum_i, sumsq_i
    (valid values; text by length), and the counts dom_i_k of its domain; exact, over all rows, combined before the shuffle.
    Loads without id are left out."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, r in enumerate(rules):
        c = F.col(f"`{r.name}`")
        ok = F.coalesce(r.valid(), F.lit(False))
        x = c.cast("double") if _is_number(df.schema[r.name].dataType) else F.length(c.cast("string")).cast("double")
        fine = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        v = F.when(fine, x)
        aggs += [
            F.count_if(c.isNull()).alias(f"n_null_{i}"), F.count_if(ok).alias(f"n_valid_{i}"), F.count(v).alias(f"n_num_{i}"),
            F.sum(v).alias(f"sum_{i}"), F.sum(v * v).alias(f"sumsq_{i}")
        ]
        aggs += [F.count_if(c == d).alias(f"dom_{i}_{k}") for k, d in enumerate(r.domain or ())]
    return df.where(F.col(load).isNotNull()).groupBy(F.col(f"`{load}`").cast("long").alias("load"), _fold(row_id).alias("fold")).agg(*aggs)


def bin_counts(
    df: DataFrame, rules: Sequence[ColumnRule], load: str = "load_id", row_id: str = "row_id"
) -> dict[tuple[int, int, int], np.ndarray]:
    """Rows in each bin of the rules with cuts or buckets, by load, fold and number of the rule; exact, over all rows, one scan.
    Partitions are summed before the driver gets a row for each load and fold."""
    binned = [i for i, r in enumerate(rules) if r.n_bins()]
    if not binned:
        return {}
    ends = np.cumsum([0, *[rules[i].n_bins() + 1 for i in binned]])  # the last bin of each is null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            keys, row = np.unique(b.column(0).to_numpy() * 2 + b.column(1).to_numpy(), return_inverse=True)
            n = np.zeros((len(keys), ends[-1]), np.int64)
            for j in range(len(binned)):
                width = ends[j + 1] - ends[j]
                n[:, ends[j] : ends[j + 1]] = np.bincount(
                    row * width + rules[binned[j]].bins(b.column(j + 2)), minlength=len(keys) * width
                ).reshape(len(keys), width)
            for k, v in zip(keys.tolist(), n):
                sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict(
                {
                    "load": pa.array(np.full(len(at), k // 2), pa.int64()), "fold": pa.array(np.full(len(at), k % 2), pa.int32()),
                    "bin": pa.array(at, pa.int32()), "cnt": pa.array(v[at], pa.int64())
                }
            )

    cols = [rules[i].coded().alias(f"b_{i}") for i in binned]
    counts = df.where(F.col(load).isNotNull()).select(
        F.col(f"`{load}`").cast("long").alias("load"), _fold(row_id).alias("fold"), *cols
    ).mapInArrow(run, "load long, fold int, bin int, cnt long")
    total: dict[tuple[int, int], np.ndarray] = {}
    for r in counts.groupBy("load", "fold", "bin").agg(F.sum("cnt").alias("cnt")).collect():
        total.setdefault((r["load"], r["fold"]), np.zeros(ends[-1]))[r["bin"]] = r["cnt"]
    return {(k, f, i): v[ends[j] : ends[j + 1] - 1] for (k, f), v in total.items() for j, i in enumerate(binned)}


@dataclass
class _Coder:
    """Worker-side feature matrix: for each column null, broken, standardized value and its square or category flags; after
    them, for each column with a limit to its mean, the value in (nearly) unclipped units of its spread."""

    rules: tuple[ColumnRule, ...]
    numeric: tuple[bool, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    slots: list[tuple[int, int]] = field(default_factory=list)
    plain: dict[int, int] = field(default_factory=dict)
    width: int = 1

    def __post_init__(self) -> None:
        self.slots, self.plain, self.width = [], {}, 1  # slot 0 is the intercept
        for r, num in zip(self.rules, self.numeric):
            k = 4 if num else 2 + (len(r.domain) if r.domain else HASH_BUCKETS)
            self.slots.append((self.width, self.width + k))
            self.width += k
        for i, r in enumerate(self.rules):
            if r.mean_change is not None and self.numeric[i]:
                self.plain[i] = self.width
                self.width += 1

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        n = batch.num_rows
        x = np.zeros((n, self.width))
        x[:, 0] = 1
        for i, (r, (a, b), num) in enumerate(zip(self.rules, self.slots, self.numeric)):
            c = batch.column(f"v_{i}")
            v = c.to_numpy(zero_copy_only=False)  # nulls as NaN
            if r.limited():
                null = np.asarray(batch.column(f"null_{i}").to_numpy(zero_copy_only=False), bool)
                ok = np.asarray(batch.column(f"ok_{i}").to_numpy(zero_copy_only=False), bool)
            else:
                null = np.asarray(c.is_null().to_numpy(zero_copy_only=False), bool)
                ok = ~null & ~np.isnan(v)
            x[:, a] = null
            x[:, a + 1] = ~null & ~ok
            if num:
                with np.errstate(invalid="ignore"):
                    z = np.where(ok & np.isfinite(v), (v - self.centre[i]) / self.spread[i], 0.0)
                if i in self.plain:
                    x[:, self.plain[i]] = np.clip(z, -1000, 1000)
                z = np.clip(z, -8, 8)
                x[:, a + 2], x[:, a + 3] = z, z * z / 8
            else:
                code = np.where(ok, np.nan_to_num(v, nan=-1), -1).astype(int)
                hit = (code >= 0) & (code < b - a - 2)
                x[np.flatnonzero(hit), a + 2 + code[hit]] = 1
        return x

    def variants(self) -> list[tuple[str, np.ndarray]]:
        """Feature masks of the scored models: all columns, all but one, and one alone."""
        every = np.ones(self.width, bool)
        every[list(self.plain.values())] = False
        out = [("all", every)]
        for r, (a, b) in zip(self.rules, self.slots):
            without, alone = every.copy(), np.zeros(self.width, bool)
            without[a:b] = False
            alone[a:b] = alone[0] = True
            out += [(f"without:{r.name}", without), (f"only:{r.name}", alone)]
        return out

    def means(self) -> list[tuple[str, np.ndarray]]:
        """Feature masks of the models of one column's plain value."""
        return [(f"mean:{self.rules[i].name}", np.isin(np.arange(self.width), (0, at))) for i, at in self.plain.items()]


def _coded(df: DataFrame, rules: Sequence[ColumnRule], load: str, row_id: str) -> DataFrame:
    cols = [F.col(f"`{load}`").cast("long").alias("load"), _fold(row_id).alias("fold")]
    for i, r in enumerate(rules):
        c = F.col(f"`{r.name}`")
        ok = r.valid()
        if _is_number(df.schema[r.name].dataType):
            v = c.cast("double")
            ok = ok & ~F.isnan(v)
        elif r.domain:
            v = (F.array_position(F.array(*[F.lit(d) for d in r.domain]), c) - 1).cast("double")
        else:
            v = F.when(c.isNotNull(), F.pmod(F.xxhash64(c.cast("string")), F.lit(HASH_BUCKETS))).cast("double")
        cols.append(v.alias(f"v_{i}"))
        if r.limited():  # else what is null and valid follows from the value
            cols += [c.isNull().alias(f"null_{i}"), F.coalesce(ok, F.lit(False)).alias(f"ok_{i}")]
    return df.select(*cols)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(coder: _Coder, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (features x models) of the logistic regressions of one load and fold by Newton steps; either class weighs
    a half, whatever the loads' sizes. The models without one column start from that of all and need half the steps."""
    models = coder.variants() + coder.means()
    w = np.zeros((coder.width, len(models)))
    c = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    for j, (name, m) in enumerate(models):
        near = name.startswith("without:")
        xm, b = x[:, m], w[m, 0].copy() if near else np.zeros(m.sum())
        ridge = RIDGE * np.r_[1e-6, np.ones(len(b) - 1)]
        for _ in range(NEWTON_STEPS // 2 if near else NEWTON_STEPS):
            p = _sigmoid(xm @ b)
            g = xm.T @ ((p - y) * c) + RIDGE * np.r_[0, np.ones(len(b) - 1)] * b
            h = (xm * (p * (1 - p) * c)[:, None]).T @ xm + np.diag(ridge)
            step = np.linalg.solve(h, g)
            b = b - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w[m, j] = b
    return w


def _models(
    df: DataFrame, coder: _Coder, rules: Sequence[ColumnRule], sizes: dict[int, int], first: int, load: str, row_id: str, fit_rows: int
) -> dict[tuple[int, int], np.ndarray]:
    """The models of all later loads and both folds, trained side by side on the executors.

    A hash of the row id picks about ``fit_rows`` rows of each load, in a scan of all partitions. Each later load's rows and a
    copy of the first load's go to the tasks of its two folds; the driver gets the coefficients."""
    spark = df.sparkSession
    later = [k for k in sizes if k != first]
    shares = spark.createDataFrame([(int(k), min(1.0, fit_rows / n)) for k, n in sizes.items()], "__load long, __share double")
    draw = F.pmod(F.xxhash64(F.col(f"`{row_id}`"), F.lit(2)), F.lit(1 << 30))
    j = bounded_join(df, shares, F.col(f"`{load}`").cast("long") == F.col("__load"), len(sizes), row_bytes=16)
    picked = j.where(draw < F.col("__share") * F.lit(1 << 30)).drop("__load", "__share")
    tasks = max(1, -(-len(sizes) * fit_rows // 65_536))
    sample = materialize(_coded(picked, rules, load, row_id).repartition(tasks))
    head = sample.where(F.col("load") == first).withColumn("model", F.explode(F.lit(np.array(later, np.int64))))
    pairs = sample.where(F.col("load") != first).withColumn("model", F.col("load")).unionByName(head)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.combine_chunks().to_batches()
        x = np.concatenate([coder.matrix(b) for b in rows])
        y = (table["load"].to_numpy() != first).astype(float)
        w = _fit(coder, x, y)
        return pa.table(
            {
                "model": pa.array([key[0].as_py()], pa.int64()), "fold": pa.array([key[1].as_py()], pa.int32()),
                "weights": pa.array([w.tobytes()], pa.binary())
            }
        )

    n_models = len(coder.variants()) + len(coder.means())
    got = pairs.groupBy("model", "fold").applyInArrow(run, "model long, fold int, weights binary").collect()
    out = {(k, f): np.zeros((coder.width, n_models)) for k in later for f in (0, 1)}
    return out | {(r["model"], r["fold"]): np.frombuffer(r["weights"]).reshape(coder.width, n_models) for r in got}


def _scores(coder: _Coder, loads: list[int], first: int, weights: dict[tuple[int, int], np.ndarray]):
    """Score histograms of one partition: every row is scored by the models fitted on the other fold."""
    names = [v for v, _ in coder.variants()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist: dict[tuple[int, int, int], np.ndarray] = {}
        nv = len(names)
        offset = np.arange(nv) * SCORE_BINS
        for b in batches:
            x, ld, fold = coder.matrix(b), b.column("load").to_numpy(), b.column("fold").to_numpy()
            for f in (0, 1):
                for one in loads:
                    for positive in (0, 1):
                        rows = (ld == (one if positive else first)) & (fold == f)
                        if not rows.any():
                            continue
                        bins = np.minimum(
                            (_sigmoid(x[rows] @ weights[one, 1 - f][:, :nv]) * SCORE_BINS).astype(int), SCORE_BINS - 1
                        ) + offset
                        h = np.bincount(bins.ravel(), minlength=nv * SCORE_BINS)
                        key = (one, f, positive)
                        hist[key] = hist[key] + h if key in hist else h
        for (one, f, positive), h in hist.items():
            at = np.flatnonzero(h)
            n = len(at)
            yield pa.RecordBatch.from_pydict({
                "load": pa.array(np.full(n, one), pa.int64()), "fold": pa.array(np.full(n, f), pa.int32()),
                "positive": pa.array(np.full(n, positive), pa.int32()),
                "variant": pa.array(names, pa.string()).take(pa.array(at // SCORE_BINS)), "bin": pa.array(at % SCORE_BINS, pa.int32()),
                "cnt": pa.array(h[at], pa.int64()),
            })

    return run


def _auc(hist: DataFrame) -> list:
    """AUC of each load, fold and variant from score histograms: pairs in order, ties count a half."""
    from pyspark.sql.window import Window as W

    key = ["load", "fold", "variant"]
    by_bin = hist.groupBy(*key, "bin").agg(
        F.sum(F.when(F.col("positive") == 1, F.col("cnt")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("positive") == 0, F.col("cnt")).otherwise(0)).alias("neg")
    )
    below = F.coalesce(F.sum("neg").over(W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pairs = by_bin.select(*key, "pos", "neg", (F.col("pos").cast("double") * (below + F.col("neg") / 2)).alias("won"))
    return pairs.groupBy(*key).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()


def _standard_error(auc: float, pos: int, neg: int) -> float:
    a = min(max(auc, 0.5), 1 - 1e-9)
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return math.sqrt(max(0.0, (a * (1 - a) + (pos - 1) * (q1 - a * a) + (neg - 1) * (q2 - a * a)) / (pos * neg)))


def discrimination(now: Sequence[np.ndarray], head: Sequence[np.ndarray]) -> float:
    """Cross-fitted discrimination of two loads by one set of flags, from their counts by fold.

    The logistic regression of flags of which one is set has the log ratio of the shares as its coefficients; that of one
    fold calls a row of the other fold the later load's where it is positive. The result is the rate of right calls less that
    of wrong ones (mean of the folds): the difference of the shares where they differ, about 0 where they don't.
    """
    out = total = 0.0
    for f in (0, 1):
        fit, test = (now[1 - f], head[1 - f]), (now[f], head[f])
        if not test[0].sum() or not test[1].sum():
            continue
        shares = [(c + 0.5) / (c + 0.5).sum() for c in fit]
        called = shares[0] > shares[1]
        rows = test[0].sum() + test[1].sum()
        out += rows * (test[0][called].sum() / test[0].sum() - test[1][called].sum() / test[1].sum())
        total += rows
    return float(out / total) if total else 0.0


def load_changes(
    df: DataFrame, table: str, rules: Sequence[ColumnRule], load: str = "load_id", row_id: str = "row_id", first: int = 1,
    least_rows: int = 20, fit_rows: int = FIT_ROWS
) -> list[dict]:
    """Compare each later load with the first by a classifier two-sample test, column by column. Runs jobs.

    1. Exact base aggregates of all rows by load and fold (two halves by a hash of the row id), one scan.
    2. For each later load and fold logistic regressions tell its rows from the first load's: features are null, broken,
       standardized value and square, or category flags of every column. They are trained side by side on the executors on
       about ``fit_rows`` rows a load (a documented bound; smaller loads are used whole), and score every row of the other fold.
    3. Cross-fitted AUCs over all rows (scores to 1 / SCORE_BINS) for the model of all columns, the models without one column
       (their loss is the column's ablation) and the models of one column alone (which a correlated column can't mask). A
       column is distinguishable if its own AUC exceeds 1/2 by SURE standard errors.
    4. For each kind of change that counts, a cross-fitted classifier of that kind alone says how much of a change it sees:
       seen_null and seen_share are the discrimination() by the null flag and by the flags of the domain or bins, seen_mean is
       the difference of the mean scores of the valid rows, in units of the value, along the slope fitted on the other fold.
       What it sees is from all rows, as such scores only depend on the flag or are linear in the value.
    5. A load and column are a candidate if some kind is seen to SEEN of its limit and the AUC plus SURE standard errors
       doesn't exclude half the gain of the smallest change. With under SURE_ROWS rows a fold the classifiers can't rule
       anything out. Candidates are confirmed by the exact aggregates: null share, mean of valid values, shares.

    Result: a dict a load and column: table_name, column_name, load, n, n_first, auc_all, auc_without, auc_only, auc_error,
    distinguishable, seen_null, seen_mean, seen_share, candidate, null_gap, mean_gap, share_gap, shifted. Loads with under
    ``least_rows`` rows (either side) and rows without a load are left out, so an empty table gives []. The driver holds two
    rows a load and the models; the models and histograms of a scoring scan stay below SCORE_BYTES on a worker.
    """
    folds = {(r["load"], r["fold"]): r.asDict() for r in base_aggregates(df, rules, load, row_id).collect()}
    base: dict[int, dict] = {}
    for (k, _), r in folds.items():
        base[k] = {c: (base[k][c] if k in base else 0) + (v or 0) for c, v in r.items() if c not in ("load", "fold")}
    if first not in base or base[first]["n"] < least_rows:
        return []
    later = sorted(k for k, r in base.items() if k > first and r["n"] >= least_rows)
    if not later:
        return []
    head, by_fold = base[first], bin_counts(df, rules, load, row_id)
    numeric = tuple(_is_number(df.schema[r.name].dataType) for r in rules)

    def moments(i: int) -> tuple[float, float]:
        r, n = rules[i], head[f"n_num_{i}"]
        least = 1e-9 if r.low is None else (r.high - r.low) / 1000
        if not n:
            return 0.0, 1.0
        m = head[f"sum_{i}"] / n
        sd = math.sqrt(max(0.0, head[f"sumsq_{i}"] / n - m * m)) if math.isfinite(head[f"sumsq_{i}"]) else abs(m)
        return m, sd if sd > least else max(least, 1.0 if r.low is None else least)

    ms = [moments(i) for i in range(len(rules))]
    coder = _Coder(tuple(rules), numeric, tuple(m for m, _ in ms), tuple(s for _, s in ms))
    weights = _models(df, coder, rules, {k: base[k]["n"] for k in [first, *later]}, first, load, row_id, fit_rows)
    names = [v for v, _ in coder.variants() + coder.means()]
    nv = len(coder.variants())
    block_size = max(1, SCORE_BYTES // (2 * 8 * coder.width * len(names) + 4 * 8 * nv * SCORE_BINS))
    found = []
    for at in range(0, len(later), block_size):
        block = later[at : at + block_size]
        rows = _coded(df.where(F.col(load).isin([first, *block])), rules, load, row_id)
        hist = rows.mapInArrow(
            _scores(coder, block, first, {k: w for k, w in weights.items() if k[0] in block}),
            "load long, fold int, positive int, variant string, bin int, cnt long"
        )
        parts: dict[tuple[int, str], list] = {}
        for r in _auc(hist):
            if r["pos"] and r["neg"]:
                parts.setdefault((r["load"], r["variant"]), []).append((r["won"] / (r["pos"] * r["neg"]), r["pos"], r["neg"]))
        auc = {k: sum(a * (p + n) for a, p, n in v) / sum(p + n for _, p, n in v) for k, v in parts.items()}
        for k in block:
            for i, r in enumerate(rules):
                only = auc.get((k, f"only:{r.name}"))
                error = _standard_error(only, base[k]["n"], head["n"]) if only is not None else None
                valid = [b[f"n_valid_{i}"] / b["n"] for b in (base[k], head)]
                seen = _seen(
                    r, i, k, first, folds, by_fold,
                    {f: weights[k, f][coder.plain[i], names.index(f"mean:{r.name}")] for f in (0, 1)} if i in coder.plain else {}
                )
                visible = any(v is None or v >= SEEN * limit for v, limit in seen.values())
                excluded = only is not None and min(valid) * min(
                    FIT_ROWS, base[k]["n"], head["n"]
                ) / 2 >= SURE_ROWS and max(only, 1 - only) + SURE * error < 0.5 + r.smallest_gain(*valid)
                candidate = visible and not excluded
                pooled = [sum(x) if (x := [by_fold[j, f, i] for f in (0, 1) if (j, f, i) in by_fold]) else None for j in (k, first)]
                found.append(
                    {"table_name": table, "column_name": r.name, "load": int(k), "n": base[k]["n"], "n_first": head["n"], "auc_all": auc.get((k, "all")), "auc_without": auc.get((k, f"without:{r.name}")), "auc_only": only, "auc_error": error,
                     "distinguishable": only is not None and max(only, 1 - only) - SURE * error > 0.5, "seen_null": seen["null"][0], "seen_mean": seen.get("mean", (None,))[0], "seen_share": seen.get("share", (None,))[0], "candidate": candidate}
                    | _confirm(r, i, base[k], head, candidate, *pooled)
                )
    return found


def _seen(
    r: ColumnRule, i: int, load: int, first: int, folds: dict, by_fold: dict, slopes: dict[int, float]
) -> dict[str, tuple[float | None, float]]:
    """How much of each kind of change the cross-fitted classifiers see, with its limit; None where a fold has too few rows."""
    empty = {"n": 0}
    now, head = ([folds.get((k, f), empty) for f in (0, 1)] for k in (load, first))
    enough = lambda rows: min(rows) >= SURE_ROWS
    flags = [[np.array([x.get(f"n_null_{i}", 0), x["n"] - x.get(f"n_null_{i}", 0)], float) for x in side] for side in (now, head)]
    out = {"null": (discrimination(*flags) if enough([x["n"] for x in now + head]) else None, r.null_change)}
    if r.mean_change is not None:
        rows = [x.get(f"n_num_{i}", 0) for x in now + head]
        seen = None
        if enough(rows) and all(slopes.get(f) for f in (0, 1)):
            gaps = [
                math.copysign(1, slopes[1 - f]) * (
                    now[f][f"sum_{i}"] / now[f][f"n_num_{i}"] - head[f][f"sum_{i}"] / head[f][f"n_num_{i}"]
                ) for f in (0, 1)
            ]
            share = [now[f][f"n_num_{i}"] + head[f][f"n_num_{i}"] for f in (0, 1)]
            seen = (gaps[0] * share[0] + gaps[1] * share[1]) / sum(share)
        out["mean"] = (seen, r.mean_change)
    if r.share_change is not None:
        if r.n_bins():
            counts = [[by_fold.get((k, f, i), np.zeros(r.n_bins())) for f in (0, 1)] for k in (load, first)]
        else:
            counts = [
                [np.array([x.get(f"dom_{i}_{k}", 0) for k in range(len(r.domain or ()))], float) for x in side] for side in (now, head)
            ]
        out["share"] = (discrimination(*counts) if enough([c.sum() for side in counts for c in side]) else None, r.share_change)
    return out


def _confirm(
    r: ColumnRule, i: int, now, head, candidate: bool, bins: np.ndarray | None = None, head_bins: np.ndarray | None = None
) -> dict:
    null_gap = now[f"n_null_{i}"] / now["n"] - head[f"n_null_{i}"] / head["n"]
    mean_gap = share_gap = None
    chance = 0.0
    if r.mean_change is not None and now[f"n_num_{i}"] and head[f"n_num_{i}"]:
        mean_gap = now[f"sum_{i}"] / now[f"n_num_{i}"] - head[f"sum_{i}"] / head[f"n_num_{i}"]
    if r.share_change is not None and r.n_bins():
        if bins is not None and head_bins is not None:
            n, m = bins.sum(), head_bins.sum()
            share_gap = float(np.abs(bins / n - head_bins / m).sum() / 2)
            p = (bins + head_bins) / (n + m)
            chance = float(np.sqrt(2 / math.pi * p * (1 - p) * (1 / n + 1 / m)).sum() / 2)
    elif r.share_change is not None and now[f"n_valid_{i}"] and head[f"n_valid_{i}"]:
        share_gap = sum(
            abs(now[f"dom_{i}_{k}"] / now[f"n_valid_{i}"] - head[f"dom_{i}_{k}"] / head[f"n_valid_{i}"]) for k in range(len(r.domain))
        ) / 2
    shifted = abs(null_gap) > r.null_change or (mean_gap is not None and abs(mean_gap) > r.mean_change) or (
        share_gap is not None and share_gap > r.share_change + chance
    )
    return {"null_gap": null_gap, "mean_gap": mean_gap, "share_gap": share_gap, "shifted": bool(candidate and shifted)}


CHANGE_SCHEMA = "table_name string, column_name string, load long, n long, n_first long, auc_all double, auc_without double, auc_only double, auc_error double, distinguishable boolean, seen_null double, seen_mean double, seen_share double, candidate boolean, null_gap double, mean_gap double, share_gap double, shifted boolean"


def _value_kind(t: T.DataType) -> str | None:
    """The type that columns are counted in together; None for complex ones, which are left out."""
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
        return None
    if isinstance(t, T.IntegralType):
        return "bigint"
    return "double" if isinstance(t, (T.FloatType, T.DoubleType)) else t.simpleString()


def column_profile(df: DataFrame, table: str, rules: Sequence[ColumnRule] = ()) -> DataFrame:
    """Null rate, exact distinct count, extremes and broken values of every column; complex columns are left out.

    The columns of one kind (whole numbers, numbers, texts, times) are unpivoted in one scan of these columns and counted by
    column and value, combined before the shuffle, so that distinct counts are exact and no task gets all values of a column.
    Result: table_name, column_name STRING, n_rows, n_null, n_distinct (without null) LONG, min_number, max_number DOUBLE
    (times in seconds since 1970; NaN is the greatest), min_text, max_text STRING (by bytes), n_broken LONG (0 without a
    rule), top_count LONG (rows of the commonest value). NaN is one value. An empty table gives a row of zeros a column.
    """
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if (kind := _value_kind(f.dataType)) is not None:
            kinds.setdefault(kind, []).append(f.name)
    out = None
    for kind, names in kinds.items():
        columns = df.select(*[F.col(f"`{n}`").cast(kind).alias(n) for n in names])
        if len(names) > 1:
            values = columns.unpivot([], [F.col(f"`{n}`") for n in names], "column_name", "value")
        else:
            values = columns.select(F.lit(names[0]).alias("column_name"), F.col(f"`{names[0]}`").alias("value"))
        by_value = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        broken = F.lit(False)
        for r in rules:
            if r.name in names and r.limited():
                broken = F.when(F.col("column_name") == r.name, replace(r, name="value").broken()).otherwise(broken)
        v, none = F.col("value"), F.lit(None)
        text, time = kind == "string", kind in ("timestamp", "timestamp_ntz", "date")
        number = none.cast("double") if text else (v.cast("timestamp") if time else v).cast("double")
        words = v if text else none.cast("string")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        one = by_value.groupBy("column_name").agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(v.isNull(), F.col("n"))).alias("n_null"), F.count(v).alias("n_distinct"),
            F.min(number).alias("min_number"), F.max(number).alias("max_number"), F.min(words).alias("min_text"),
            F.max(words).alias("max_text"), F.sum(F.when(broken, F.col("n"))).alias("n_broken"),
            F.max(F.when(v.isNotNull(), F.col("n"))).alias("top_count")
        )
        every = df.sparkSession.createDataFrame([(n,) for n in names], "column_name string")
        one = every.join(one, "column_name", "left")
        counts = ("n_rows", "n_null", "n_distinct")
        one = one.select(
            F.lit(table).alias("table_name"), "column_name", *[zero(F.col(c)).alias(c) for c in counts], "min_number", "max_number",
            "min_text", "max_text", *[zero(F.col(c)).alias(c) for c in ("n_broken", "top_count")]
        )
        out = one if out is None else out.unionAll(one)
    return out
