"""Robust (HC3) least squares at table scale.

Two passes after the means, each a ``mapInPandas`` that turns an Arrow batch into
partial sums, reduced by a Spark ``groupBy(position).sum``:

1. Gram pass: ``X'X``, ``X'y``, ``y'y``, ``Σy``, ``n``, centred on the means.
2. Meat pass: with ``β`` and ``(X'X)⁻¹`` (k×k, shipped in the task closure),
   residuals ``e``, leverages ``h = x'(X'X)⁻¹x`` and ``Σ x x' e²/(1−h)²``.

Only k×k numbers reach the driver, where one eigendecomposition of the
Jacobi-scaled Gram matrix gives rank, generalised inverse (exactly collinear
columns share their effect) and the coordinates of the F test. p-values and
intervals use normal tails; the model F is the robust Wald F(q, n − rank).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.dist import f_sf, normal_ppf_975, normal_two_sided_p
from ledgerlens.functions.hashrand import hash_uniform
from ledgerlens.operators.features import add_engineered_features, positive_log_target
from ledgerlens.session import write_shared
from ledgerlens.spec import CAUSAL_MIN_EFFECT, R2_SIGNAL, SEED, SIGNIFICANCE, TableSpec

#: Default bound on a categorical's levels: each is a column of the k×k matrices.
MAX_LEVELS = 1000
HIGH_LEVERAGE = 1.0 - 1e-10
RANK_CUTOFF = 1e-10


@dataclass
class Design:
    terms: list[str]
    columns: list[Column]
    y: Column
    source_columns: list[str] = field(default_factory=list)


def categorical_levels(df: DataFrame, col: str, cap: int = MAX_LEVELS) -> list[str]:
    """Sorted distinct levels (bounded: more than ``cap`` levels is an error)."""
    rows = (df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull())
            .distinct().orderBy("v").limit(cap + 1).collect())
    if len(rows) > cap:
        raise ValueError(f"{col} has more than {cap} levels; not a categorical regressor")
    return [r.v for r in rows]


def build_design(df: DataFrame, y: str, terms: Sequence[str], *, intercept: bool = True, max_levels: int = MAX_LEVELS) -> Design:
    """Treatment-coded design: ``C(col)`` terms become dummies (first level is the
    base), listed before numeric terms; names follow ``C(col)[T.level]``."""
    names: list[str] = ["Intercept"] if intercept else []
    cols: list[Column] = [F.lit(1.0)] if intercept else []
    cats = [t[2:-1] for t in terms if t.startswith("C(")]
    nums = [t for t in terms if not t.startswith("C(")]
    for c in cats:
        levels = categorical_levels(df, c, max_levels)
        for lv in levels[1:]:
            names.append(f"C({c})[T.{lv}]")
            cols.append(F.when(F.col(c).cast("string") == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0)))
    for c in nums:
        names.append(c)
        cols.append(F.col(c).cast("double"))
    return Design(names, cols, F.col(y).cast("double"), cats + nums + [y])


def _reduce_packed(df: DataFrame) -> np.ndarray:
    """Sum (pos, value) partials by position in Spark; return the dense vector."""
    rows = df.groupBy("pos").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r.pos for r in rows), default=-1) + 1)
    for r in rows:
        out[r.pos] = r.value
    return out


def _design_frame(df: DataFrame, design: Design) -> DataFrame:
    """Target and design columns; rows with a null anywhere are dropped."""
    sel = df.select(design.y.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(design.columns)])
    return sel.dropna()


@dataclass
class OLSResult:
    name: str
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    rank: int
    r2: float
    adj_r2: float
    f_stat: float
    f_pvalue: float
    df_model: int
    df_resid: int
    n_high_leverage: int

    def std_err(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def coefficients(self, spark: SparkSession, digits: int = 5) -> DataFrame:
        se = self.std_err()
        z = np.where(se > 0, self.coef / np.where(se > 0, se, 1), np.nan)
        q = normal_ppf_975()
        rows = [
            (self.name, t, _r(b, digits), _r(s, digits), _r(zz, digits), _r(normal_two_sided_p(zz), digits),
             _r(b - q * s, digits), _r(b + q * s, digits))
            for t, b, s, zz in zip(self.terms, self.coef, se, z)
        ]
        return spark.createDataFrame(
            rows, "model string, term string, coef double, std_err double, z double, p_value double, "
                  "ci_low double, ci_high double",
        )

    def significant_terms(self) -> list[str]:
        se = self.std_err()
        return [t for t, b, s in zip(self.terms, self.coef, se)
                if t != "Intercept" and s > 0 and normal_two_sided_p(b / s) < SIGNIFICANCE]

    @property
    def has_signal(self) -> bool:
        return bool(self.r2 >= R2_SIGNAL and self.f_pvalue < SIGNIFICANCE)

    def fit_stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.name, self.n, self.rank, _r(self.r2, 6), _r(self.adj_r2, 6), _r(self.f_stat, 6),
              _r(self.f_pvalue, 6), self.df_model, self.df_resid, "HC3", self.n_high_leverage, self.has_signal,
              ", ".join(self.significant_terms()))],
            "model string, n_obs long, rank int, r2 double, adj_r2 double, f_stat double, f_pvalue double, "
            "df_model int, df_resid int, cov_type string, n_high_leverage long, has_signal boolean, "
            "significant_terms string",
        )


def _r(x, digits):
    x = float(x)
    return None if np.isnan(x) or np.isinf(x) else round(x, digits)


def _spectral_inverse(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(generalised inverse, basis B, rank) of a Gram matrix from one decomposition.

    Eigenvalues of the Jacobi-scaled matrix under ``RANK_CUTOFF`` of the largest
    count as zero, for the inverse, the rank and the F test alike. The columns of
    ``B`` span the estimable directions: inverse = B B', so ``B' (X'y)`` are the
    estimable coordinates of the coefficients.
    """
    d = np.diag(gram)
    scale = np.where(d > 0, 1.0 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
    values, vectors = np.linalg.eigh(gram * np.outer(scale, scale)) if len(d) else (np.zeros(0), np.zeros((0, 0)))
    kept = values > RANK_CUTOFF * values.max(initial=0.0)
    basis = scale[:, None] * vectors[:, kept] / np.sqrt(values[kept])
    return basis @ basis.T, basis, int(kept.sum())


def ols_hc3(df: DataFrame, y: str, terms: Sequence[str], *, name: str = "ols", intercept: bool = True, max_levels: int = MAX_LEVELS) -> OLSResult:
    """OLS with HC3 robust covariance, fitted by distributed passes.

    With an intercept, regressors and target are centred on their first-pass means,
    so no sum of squares is the small difference of large numbers. Rows of leverage
    1 leave HC3 undefined: their number is reported and errors, F and p are null.
    """
    design = build_design(df, y, terms, intercept=intercept, max_levels=max_levels)
    slopes = [i for i, t in enumerate(design.terms) if not (intercept and i == 0)]
    k = len(slopes)
    data = _design_frame(df.select(*design.source_columns), design)
    xcols = [f"x{i}" for i in slopes]
    centre, y_centre = np.zeros(k), 0.0
    if intercept:
        row = data.agg(F.avg("y").alias("y"), *[F.avg(c).alias(c) for c in xcols]).first()
        if row["y"] is None:
            raise ValueError("no complete rows to fit")
        centre, y_centre = np.array([row[c] for c in xcols], dtype="float64"), float(row["y"])

    def centred(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf[xcols].to_numpy(dtype="float64") - centre, pdf["y"].to_numpy(dtype="float64") - y_centre

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(k * k + k + 3)
        for pdf in batches:
            if pdf.empty:
                continue
            x, yy = centred(pdf)
            acc[: k * k] += (x.T @ x).ravel()
            acc[k * k: k * k + k] += x.T @ yy
            acc[k * k + k] += yy @ yy
            acc[k * k + k + 1] += yy.sum()
            acc[k * k + k + 2] += len(yy)
        yield pd.DataFrame({"pos": np.arange(len(acc), dtype="int32"), "value": acc})

    g = _reduce_packed(data.mapInPandas(gram, "pos int, value double"))
    if g.size == 0 or g[k * k + k + 2] == 0:
        raise ValueError("no complete rows to fit")
    xty = g[k * k: k * k + k]
    sst, ysum, n = g[k * k + k], g[k * k + k + 1], int(round(g[k * k + k + 2]))
    inv, basis, slope_rank = _spectral_inverse(g[: k * k].reshape(k, k))
    beta = inv @ xty
    mean = 1.0 / n if intercept else 0.0

    def meat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((k + 1) * (k + 1) + 2)
        for pdf in batches:
            if pdf.empty:
                continue
            x, yy = centred(pdf)
            e = yy - x @ beta
            h = ((x @ basis) ** 2).sum(axis=1) + mean
            ok = h < HIGH_LEVERAGE
            w = np.where(ok, e * e / np.where(ok, (1.0 - h) ** 2, 1.0), 0.0)
            full = np.hstack([np.ones((len(x), 1)), x])
            acc[:-2] += (full.T @ (full * w[:, None])).ravel()
            acc[-2] += e @ e
            acc[-1] += (~ok).sum()
        yield pd.DataFrame({"pos": np.arange(len(acc), dtype="int32"), "value": acc})

    m = _reduce_packed(data.mapInPandas(meat, "pos int, value double"))
    meat_m = m[:-2].reshape(k + 1, k + 1)
    sse, n_hi = m[-2], int(round(m[-1]))
    sst = sst - ysum * ysum / n if intercept else sst
    r2 = 1.0 - sse / sst if sst > 0 else float("nan")
    rank = slope_rank + (1 if intercept else 0)
    df_resid, df_model = n - rank, slope_rank
    adj = 1.0 - (n - (1 if intercept else 0)) / df_resid * (1.0 - r2) if df_resid > 0 else float("nan")
    f_stat, f_p = float("nan"), float("nan")
    if df_model > 0 and df_resid > 0 and not n_hi:
        # Wald test in the estimable coordinates, where the covariance has full rank
        coordinates = basis.T @ xty
        spread = basis.T @ meat_m[1:, 1:] @ basis
        f_stat = float(coordinates @ np.linalg.solve(spread, coordinates) / df_model)
        f_p = f_sf(f_stat, df_model, df_resid)
    if intercept:
        bread = np.zeros((k + 1, k + 1))
        bread[0, 0], bread[1:, 1:] = mean, inv
        back = np.eye(k + 1)
        back[0, 1:] = -centre  # from centred regressors to the given ones
        coef = back @ np.concatenate([[y_centre + ysum / n], beta])
        cov = back @ (bread @ meat_m @ bread) @ back.T
    else:
        coef, cov = beta, inv @ meat_m[1:, 1:] @ inv
    if n_hi:
        cov = np.full_like(cov, np.nan)
    return OLSResult(name, design.terms, coef, cov, n, rank, r2, adj, f_stat, f_p, df_model, df_resid, n_hi)


# -- J2 absorbed factors -------------------------------------------------------------------
#: Sweeps of the alternating demeaning, and the largest group mean left, in deviations of its column.
MAX_SWEEPS, SWEEP_CUTOFF = 500, 1e-10


def ols_absorbed(df: DataFrame, y: str, terms: Sequence[str], absorb: Sequence[str], *, name: str = "absorbed", max_levels: int = MAX_LEVELS) -> OLSResult:
    """The fit with a dummy for every level of the ``absorb`` factors, without making the dummies.

    By the Frisch–Waugh theorem the slopes of ``terms`` are those of the fit on columns
    that are demeaned within the factors. One factor takes one sweep; several take turns
    until no group mean is left. A sweep is an aggregate per level and a join by level
    (the planner broadcasts the means while they are small), and is written, so the
    factors may have any number of levels: nothing of their size reaches the driver.

    Errors are HC3 with one factor, whose dummies add 1 / (rows of the level) to a row's
    leverage; with several that sum isn't known by level, and they are HC1 (scaled by
    n / residual degrees of freedom). Levels count as degrees of freedom, one shared
    between each further factor and the first (as in connected data). Null levels are
    dropped with other nulls. R² is that of the whole fit.
    """
    factors = [f"_a{i}" for i in range(len(absorb))]
    design = build_design(df, y, terms, intercept=False, max_levels=max_levels)
    k = len(design.columns)
    names = ["y", *[f"x{i}" for i in range(k)]]
    rows = df.select(design.y.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(design.columns)],
                     *[F.col(c).cast("string").alias(f) for c, f in zip(absorb, factors, strict=True)]).dropna()
    rows = write_shared(rows.withColumn("_y", F.col("y")), "absorb")
    spread = rows.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(c) for c in names]).first()
    n = spread["n"]
    if not n:
        raise ValueError("no complete rows to fit")
    levels = [rows.select(f).distinct().count() for f in factors]
    for sweep in range(MAX_SWEEPS):
        left = 0.0
        for f in factors:
            means = write_shared(rows.groupBy(f).agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(names)]), "absorb-means")
            worst = means.agg(*[F.max(F.abs(f"_m{i}")).alias(f"w{i}") for i in range(len(names))]).first()
            left = max([left, *[worst[f"w{i}"] / spread[c] for i, c in enumerate(names) if spread[c]]])
            keep = [c for c in rows.columns if c not in names and c != "_rows"]
            rows = rows.drop("_rows").join(means, f).select(*keep, "_rows", *[(F.col(c) - F.col(f"_m{i}")).alias(c) for i, c in enumerate(names)])
        rows = write_shared(rows, "absorb")
        if len(factors) == 1 or left < SWEEP_CUTOFF:
            break
    else:
        raise RuntimeError(f"group means are still {left:.1e} deviations after {MAX_SWEEPS} sweeps")
    xcols = names[1:]
    single = len(factors) == 1

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((k + 1) ** 2)
        for pdf in batches:
            z = pdf[names].to_numpy("f8")
            acc += (z.T @ z).ravel()
        yield pd.DataFrame({"pos": np.arange(len(acc), dtype="int32"), "value": acc})

    g = _reduce_packed(rows.select(*names).mapInPandas(gram, "pos int, value double")).reshape(k + 1, k + 1)
    inv, basis, rank = _spectral_inverse(g[1:, 1:])
    beta = inv @ g[1:, 0]
    absorbed = sum(levels) - (len(levels) - 1)
    df_resid = n - rank - absorbed

    def meat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(k * k + 2)
        for pdf in batches:
            x, own = pdf[xcols].to_numpy("f8"), 1.0 / pdf["_rows"].to_numpy("f8")
            e = pdf["y"].to_numpy("f8") - x @ beta
            h = ((x @ basis) ** 2).sum(axis=1) + own if single else np.zeros(len(x))
            ok = h < HIGH_LEVERAGE
            w = np.where(ok, e * e / np.where(ok, (1.0 - h) ** 2, 1.0), 0.0)
            acc[:-2] += (x.T @ (x * w[:, None])).ravel()
            acc[-2] += e @ e
            # a row alone in its level is fitted exactly and moves no slope
            acc[-1] += (~ok & (np.abs(x @ basis).max(axis=1, initial=0.0) > 1e-8)).sum() if k else 0
        yield pd.DataFrame({"pos": np.arange(len(acc), dtype="int32"), "value": acc})

    m = _reduce_packed(rows.select(*names, "_rows").mapInPandas(meat, "pos int, value double"))
    sse, n_hi = float(m[-2]), int(round(m[-1]))
    inner = m[:-2].reshape(k, k) * (1.0 if single else n / max(df_resid, 1))
    cov = inv @ inner @ inv if not n_hi else np.full((k, k), np.nan)
    sst = float(spread["y"] or 0.0) ** 2 * n
    r2 = 1.0 - sse / sst if sst > 0 else float("nan")
    adj = 1.0 - (n - 1) / df_resid * (1.0 - r2) if df_resid > 0 else float("nan")
    f_stat, f_p = float("nan"), float("nan")
    if rank and df_resid > 0 and not n_hi:
        at, width = basis.T @ g[1:, 0], basis.T @ inner @ basis
        f_stat = float(at @ np.linalg.solve(width, at) / rank)
        f_p = f_sf(f_stat, rank, df_resid)
    return OLSResult(name, design.terms, beta, cov, n, rank + absorbed, r2, adj, f_stat, f_p, rank, df_resid, n_hi)


# -- J3–J7 model jobs ---------------------------------------------------------------------
def hedonic_price_model(df: DataFrame, spec: TableSpec) -> OLSResult:
    """Log price on model, region, fuel, transmission, engine, age, log mileage."""
    data = add_engineered_features(df, spec)
    return ols_hc3(data, "log_price", [
        f"C({spec.model})", f"C({spec.region})", f"C({spec.fuel})", f"C({spec.transmission})",
        spec.engine, "vehicle_age", "log_mileage",
    ], name="Hedonic price model")


def demand_model(df: DataFrame, spec: TableSpec) -> OLSResult:
    """Volume on log price, age, region, fuel (+ macro columns present and not all null)."""
    data = add_engineered_features(df, spec)
    terms = ["log_price", "vehicle_age", f"C({spec.region})", f"C({spec.fuel})"]
    macro = [c for c in ("inflation_pct", "gdp_per_capita_usd", "price_usd_per_litre") if c in data.columns]
    if macro:
        present = data.agg(*[F.count(c).alias(c) for c in macro]).first()
        terms += [c for c in macro if present[c] > 0]
    return ols_hc3(data, spec.volume, terms, name="Demand model")


def price_elasticity(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Log-log elasticity with age and region controls, as one row."""
    data = positive_log_target(add_engineered_features(df, spec), spec)
    res = ols_hc3(data, "log_volume", ["log_price", "vehicle_age", f"C({spec.region})"], name="Elasticity")
    i = res.terms.index("log_price")
    b, s = float(res.coef[i]), float(res.std_err()[i])
    p = normal_two_sided_p(b / s) if s > 0 else float("nan")
    q = normal_ppf_975()
    if not p < SIGNIFICANCE:
        text = "The interval includes zero: these rows do not show that volume reacts to price."
    else:
        text = f"Volume reacts {'more' if abs(b) > 1 else 'less'} than proportionally to price (elasticity {b:+.3f})."
    return df.sparkSession.createDataFrame(
        [(round(b, 6), round(s, 6), round(p, 6), round(b - q * s, 6), round(b + q * s, 6), res.n,
          bool(p < SIGNIFICANCE), text)],
        "elasticity double, std_err double, p_value double, ci_low double, ci_high double, n_obs long, "
        "is_significant boolean, interpretation string",
    )


ADJUSTMENT_SET = ("C({region})", "C({model})", "{year}", "{engine}", "vehicle_age")


def causal_price_effect(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Naive vs backdoor-adjusted log-price effect on log volume.

    Year and vehicle age are exactly collinear; the pseudo-inverse splits their
    effect and leaves the price coefficient identified.
    """
    data = positive_log_target(add_engineered_features(df, spec), spec)
    adj_terms = [t.format(region=spec.region, model=spec.model, year=spec.year, engine=spec.engine)
                 for t in ADJUSTMENT_SET]
    naive = ols_hc3(data, "log_volume", ["log_price"], name="naive")
    adjusted = ols_hc3(data, "log_volume", ["log_price", *adj_terms], name="adjusted")

    def pick(res: OLSResult):
        i = res.terms.index("log_price")
        b, s = float(res.coef[i]), float(res.std_err()[i])
        return b, s, normal_two_sided_p(b / s) if s > 0 else float("nan")

    nb, ns, npv = pick(naive)
    ab, as_, apv = pick(adjusted)
    causal = bool(apv < SIGNIFICANCE and abs(ab) > CAUSAL_MIN_EFFECT)
    return df.sparkSession.createDataFrame(
        [(round(nb, 6), round(ns, 6), round(npv, 6), round(ab, 6), round(as_, 6), round(apv, 6), causal,
          ", ".join(adj_terms))],
        "naive_effect double, naive_std_err double, naive_pvalue double, adjusted_effect double, "
        "adjusted_std_err double, adjusted_pvalue double, is_causal boolean, adjustment_set string",
    )


def vif_table(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Variance inflation factors = diag of the inverse correlation matrix.

    One aggregate pass of ``covar_pop`` for every column pair gives the
    covariance matrix; the k×k inversion runs on the driver.
    """
    cols = list(columns)
    x = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).dropna()
    aggs = [F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    row = x.agg(*aggs).first()
    k = len(cols)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    varies = np.diag(cov) > 0  # a constant column has no inflation factor: NULL
    sd = np.sqrt(np.diag(cov)[varies])
    vif = np.full(k, np.nan)
    if varies.any():
        vif[varies] = np.diag(np.linalg.pinv(cov[np.ix_(varies, varies)] / np.outer(sd, sd)))
    return df.sparkSession.createDataFrame([(c, _r(v, digits)) for c, v in zip(cols, vif)], "feature string, vif double")


def stack_fit_stats(results: Sequence[OLSResult], spark: SparkSession) -> DataFrame:
    """Stack the fit statistics of several models (one row per model)."""
    frames = [r.fit_stats(spark) for r in results]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def linear_folds(df: DataFrame, key: str, y: str, terms: Sequence[str], *, k: int = 5, sizes: Sequence[float] = (), seed: int = SEED) -> tuple[list[tuple], list[tuple]]:
    """K12–K14 of a linear fit on all features, from one pass: R² of every fold and the learning curve.

    Each row is in a fold and in the smallest of ``sizes`` that its hash falls under; the
    pass sums X'X, X'y and y'y per (fold, size), around fixed centres. A fold's training
    sums are those of the other folds, a size's those of the sizes up to it; the fold's
    own sums give its squared errors, so no row is read again. Returns (fold, r2, n) per
    fold and (size, mean r2, mean training rows) per size. A row with a null is dropped.
    """
    design = build_design(df, y, terms)
    width = len(design.columns)
    fold = F.least(F.floor(hash_uniform(F.col(key), seed, "fold") * k), F.lit(k - 1)).cast("int")
    u, step = hash_uniform(F.col(key), seed, "size"), F.lit(len(sizes))
    for i, size in reversed(list(enumerate(sizes))):
        step = F.when(u < F.lit(float(size)), F.lit(i)).otherwise(step)
    rows = df.select(fold.alias("fold"), step.cast("int").alias("step"), design.y.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(design.columns)]).dropna()
    # any centre near the data will do: the algebra after it is exact, and sums stay small
    means = rows.agg(F.avg("y").alias("y"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(1, width)]).first()
    if means["y"] is None:
        raise ValueError("no complete rows to fit")
    centre = np.array([0.0] + [means[f"x{i}"] for i in range(1, width)] + [means["y"]])
    names = [f"x{i}" for i in range(width)] + ["y"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (f, s), part in pdf.groupby(["fold", "step"]):
                z = part[names].to_numpy("f8") - centre
                yield pd.DataFrame({"fold": f, "step": s, "pos": np.arange((width + 1) ** 2, dtype="i4"), "value": (z.T @ z).ravel()})

    cells: dict[tuple[int, int], np.ndarray] = {}
    for r in rows.mapInPandas(sums, "fold int, step int, pos int, value double").groupBy("fold", "step", "pos").agg(F.sum("value").alias("value")).collect():
        cells.setdefault((r["fold"], r["step"]), np.zeros((width + 1) ** 2))[r["pos"]] = r["value"]
    total = {c: m.reshape(width + 1, width + 1) for c, m in cells.items()}
    none = np.zeros((width + 1, width + 1))

    def r2(train: np.ndarray, test: np.ndarray) -> float:
        beta = _spectral_inverse(train[:-1, :-1])[0] @ train[:-1, -1]
        n = test[0, 0]
        sse = test[-1, -1] - 2 * beta @ test[:-1, -1] + beta @ test[:-1, :-1] @ beta
        sst = test[-1, -1] - test[0, -1] ** 2 / n if n else 0.0
        return float(1 - sse / sst) if sst > 0 else float("nan")

    own = {f: sum((m for (g, _), m in total.items() if g == f), none) for f in range(k)}
    everything = sum(own.values(), none)
    folds = [(f, r2(everything - own[f], own[f]), int(round(own[f][0, 0]))) for f in range(k)]
    curve = []
    for i, size in enumerate(sizes):
        trained = [sum((m for (g, s), m in total.items() if g != f and s <= i), none) for f in range(k)]
        curve.append((float(size), float(np.mean([r2(t, own[f]) for f, t in enumerate(trained)])), float(np.mean([t[0, 0] for t in trained]))))
    return folds, curve


def linear_attribution(df: DataFrame, y: str, terms: Sequence[str], result: OLSResult) -> DataFrame:
    """K15/H8 (exact for linear models): mean |β_j·(x_j − x̄_j)| per design column.

    Two aggregate passes: column means, then the mean absolute contribution;
    sorted descending.
    """
    design = build_design(df, y, terms)
    data = _design_frame(df.select(*design.source_columns), design)
    idx = [i for i, t in enumerate(design.terms) if t != "Intercept"]
    means = data.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in idx]).first()
    contrib = data.agg(*[
        F.avg(F.abs(F.lit(float(result.coef[i])) * (F.col(f"x{i}") - F.lit(means[f"m{i}"])))).alias(f"a{i}")
        for i in idx
    ]).first()
    rows = sorted(((design.terms[i], float(contrib[f"a{i}"])) for i in idx), key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(rows, "feature string, mean_abs_attribution double")
