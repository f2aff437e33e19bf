"""Ridge regression with preprocessing that learns from training rows alone.

A few aggregations over the training rows give all that a model needs: medians, then sums, products and, by grouping sets, sums by level and the
counts of pairs of levels. From these few numbers the driver solves for any number of penalties. Sums are kept by group, and add up: operators/many.py
solves many models and expanding windows from one set of them. A model is plain numbers, saved as JSON; it predicts by column expressions, without Python workers.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quantiles

#: The grid that tuning goes through, and the wider one of the sensitivity study.
ALPHAS = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
WIDE_ALPHAS = (0.0, 1e-06, 1e-05, 0.0001, *ALPHAS)


@dataclass
class Ridge:
    """A fitted model: medians, means and scales of the training rows, a weight for each scaled number, 0/1 column and level of a category."""

    numeric: list[str]
    categorical: list[str]
    binary: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    weights: dict[str, float]
    levels: dict[str, dict[str, float]]
    intercept: float
    alpha: float
    extra: dict = field(default_factory=dict)

    def design(self, df: DataFrame) -> DataFrame:
        """df with the columns that weights apply to: n_<column>, nulls filled with the training median, centred and scaled; c_<column>, the level; b_<column>, null being 0."""
        numeric = {f"n_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - self.means[c]) / self.scales[c] for c in self.numeric}
        texts = {f"c_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.categorical}
        return df.withColumns(numeric | texts | {f"b_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.binary})

    def one_hot(self, df: DataFrame) -> DataFrame:
        """design() with 0/1 columns h_<column>_<i> for the i-th level of the training rows; a level unseen there is all zeros."""
        hot = {f"h_{c}_{i}": (F.coalesce(F.col(c).cast("string"), F.lit("")) == v).cast("int") for c in self.categorical for i, v in enumerate(sorted(self.levels[c]))}
        return self.design(df).withColumns(hot) if hot else self.design(df)

    def expression(self) -> Column:
        """The prediction from the model's input columns; a level that training has not seen adds nothing."""
        out = F.lit(self.intercept)
        for c in self.numeric:
            out = out + (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - self.means[c]) / self.scales[c] * self.weights[c]
        for c in self.binary:
            out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * self.weights[c]
        for c in self.categorical:
            if self.levels[c]:
                table = F.from_json(F.lit(json.dumps(self.levels[c], sort_keys=True)), "map<string,double>")  # one constant, whatever the number of levels
                out = out + F.coalesce(F.try_element_at(table, F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(0.0))
        return out

    def predict(self, df: DataFrame, name: str = "pred") -> DataFrame:
        return df.withColumn(name, self.expression())

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> Ridge:
        return Ridge(**d)


@dataclass
class Moments:
    """What two passes over training rows leave: enough to solve for any penalty."""

    numeric: list[str]
    categorical: list[str]
    binary: list[str]
    n: int
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    levels: list[tuple[str, str]]  # (column, level) in the order of the design's first columns
    centre: np.ndarray  # mean of each column of the design
    gram: np.ndarray  # centred products of the columns
    with_y: np.ndarray
    y_mean: float

    def solve(self, alpha: float) -> Ridge:
        """Minimises the squared error plus alpha times the squared weights, the intercept free; alpha 0 takes the least weights of all that fit best."""
        g = self.gram + alpha * np.eye(len(self.gram))
        w = np.linalg.solve(g, self.with_y) if alpha > 0 and len(g) else np.linalg.lstsq(g, self.with_y, rcond=1e-12)[0] if len(g) else np.zeros(0)
        k = len(self.levels)
        levels: dict[str, dict[str, float]] = {c: {} for c in self.categorical}
        for (c, v), x in zip(self.levels, w[:k].tolist(), strict=True):
            levels[c][v] = x
        weights = dict(zip([*self.numeric, *self.binary], w[k:].tolist(), strict=True))
        return Ridge(self.numeric, self.categorical, self.binary, self.medians, self.means, self.scales, weights, levels, float(self.y_mean - w @ self.centre), float(alpha))


#: Cells (groups x levels, and pairs of levels) that the driver takes; a category of more must be binned first.
MAX_CELLS = 500_000


@dataclass
class Sums:
    """Additive sums over rows: of columns v = (numbers less their origin, null being 0; whether each is null; flags; the target less its origin), of their
    products, of v at each level, and counts of pairs of levels. Medians come in later, so sums of parts of the rows add up to those of the whole."""

    numeric: list[str]
    categorical: list[str]
    binary: list[str]
    origin: np.ndarray
    n: int
    s: np.ndarray
    p: np.ndarray
    level: dict[tuple[int, str], np.ndarray]  # (category, level): count, then sums of v
    pair: dict[tuple[int, str, int, str], int]

    def __add__(self, other: Sums) -> Sums:
        level, pair = dict(self.level), dict(self.pair)
        for k, v in other.level.items():
            level[k] = level[k] + v if k in level else v
        for k, v in other.pair.items():
            pair[k] = pair.get(k, 0) + v
        return Sums(self.numeric, self.categorical, self.binary, self.origin, self.n + other.n, self.s + other.s, self.p + other.p, level, pair)

    def moments(self, medians: dict[str, float]) -> Moments:
        """The design's moments once nulls are filled with medians."""
        m, f, n = len(self.numeric), len(self.binary), self.n
        if not n:
            raise ValueError("no training rows")
        fill = np.zeros((m + f + 1, 2 * m + f + 1))
        for i, c in enumerate(self.numeric):
            fill[i, i], fill[i, m + i] = 1.0, medians[c] - self.origin[i]
        fill[m:, 2 * m :] = np.eye(f + 1)
        s, p = fill @ self.s, fill @ self.p @ fill.T
        levels = sorted(self.level)
        at, k, m = {kv: i for i, kv in enumerate(levels)}, len(levels), m + f
        gram, total, with_y = np.zeros((k + m, k + m)), np.zeros(k + m), np.zeros(k + m)
        for kv, i in at.items():
            sums = fill @ self.level[kv][1:]
            gram[i, i] = total[i] = self.level[kv][0]
            gram[i, k:] = gram[k:, i] = sums[:-1]
            with_y[i] = sums[-1]
        for (c, v, d, w), count in self.pair.items():
            gram[at[c, v], at[d, w]] = gram[at[d, w], at[c, v]] = count
        gram[k:, k:], total[k:], with_y[k:] = p[:m, :m], s[:m], p[:m, m]
        centre = total / n
        gram, with_y = gram - np.outer(centre, centre) * n, with_y - centre * s[m]
        numbers = slice(k, k + len(self.numeric))
        spread = np.sqrt(np.maximum(np.diag(gram)[numbers], 0) / n)
        spread[spread <= 1e-12] = 1.0
        scale = np.ones(k + m)
        scale[numbers] = spread
        means = {c: float(self.origin[i] + centre[k + i]) for i, c in enumerate(self.numeric)}
        scaled_centre = centre.copy()
        scaled_centre[numbers] = 0.0  # centred by the model itself
        return Moments(
            self.numeric, self.categorical, self.binary, n, medians, means, dict(zip(self.numeric, spread.tolist(), strict=True)), [(self.categorical[c], v) for c, v in levels],
            scaled_centre, gram / np.outer(scale, scale), with_y / scale, float(self.origin[-1] + s[m] / n),
        )


def sums_by(df: DataFrame, y: str, by: list[str], numeric: list[str], categorical: list[str] = (), binary: list[str] = (), origin: list[float] | None = None) -> dict[tuple, Sums]:
    """Sums of the rows of each group, from two aggregations whatever the number of groups; rows without a target are left out.

    origin is subtracted from the numbers and, last, from the target: the same for all groups, so that these add up, and near the data, so that large offsets
    cost no digits. Groups times levels, and pairs of levels, must be at most MAX_CELLS.
    """
    numeric, categorical, binary, by = list(numeric), list(categorical), list(binary), list(by)
    origin = np.array(origin if origin is not None else [0.0] * (len(numeric) + 1), float)
    x = [F.coalesce(F.col(c).cast("double") - float(o), F.lit(0.0)) for c, o in zip(numeric, origin)] + [F.col(c).isNull().cast("double") for c in numeric]
    x += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in binary] + [F.col(y).cast("double") - float(origin[-1])]
    names, keys, groups = [f"x{i}" for i in range(len(x))], [f"c{i}" for i in range(len(categorical))], [f"g{i}" for i in range(len(by))]
    cats = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(categorical, keys)]
    rows = df.where(F.col(y).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, groups)), *(v.alias(n) for v, n in zip(x, names)), *cats)
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    whole = rows.groupBy(*groups).agg(F.count("*").alias("n"), *(F.sum(a).alias(f"s_{a}") for a in names), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i, j in pairs))
    out: dict[tuple, Sums] = {}
    for r in whole.where("n > 0").limit(MAX_CELLS + 1).collect():
        p = np.zeros((len(x), len(x)))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p_{i}_{j}"]
        out[tuple(r[g] for g in groups)] = Sums(numeric, categorical, binary, origin, r.n, np.array([r[f"s_{a}"] for a in names]), p, {}, {})
    if keys:
        sets = [[*groups, a] for a in keys] + [[*groups, a, b] for a, b in combinations(keys, 2)]
        cells = rows.groupingSets(sets, *groups, *keys).agg(F.grouping_id(*groups, *keys).alias("g"), F.count("*").alias("n"), *(F.sum(a).alias(f"s_{a}") for a in names)).limit(MAX_CELLS + 1).collect()
        if len(cells) > MAX_CELLS:
            raise ValueError(f"more than {MAX_CELLS} levels and pairs of levels: bin the categories {categorical} first")
        for r in cells:
            held = [i for i in range(len(keys)) if not r.g >> (len(keys) - 1 - i) & 1]
            group = out[tuple(r[g] for g in groups)]
            if len(held) == 1:
                group.level[held[0], r[keys[held[0]]]] = np.array([r.n, *(r[f"s_{a}"] for a in names)], float)
            else:
                group.pair[held[0], r[keys[held[0]]], held[1], r[keys[held[1]]]] = r.n
    return out


def moments(train: DataFrame, y: str, numeric: list[str], categorical: list[str] = (), binary: list[str] = (), exact: bool = True) -> Moments:
    """Reads the training rows for medians, then for sums.

    Medians are exact and interpolate (found by digits where rows are many: no buffer grows with distinct values), or with exact=False come from a sketch of bounded size; scales are population standard deviations, 1 where that is
    zero; each category keeps all its levels. Numbers are summed as differences from their medians, the target from its mean. Rows without a target are left out.
    """
    numeric = list(numeric)
    train = train.where(F.col(y).isNotNull())
    first = train.agg(F.count("*").alias("n"), F.avg(y).alias("y"), *(F.percentile_approx(F.col(c).cast("double"), 0.5, 100_000).alias(c) for c in numeric if not exact)).first()
    if not first.n:
        raise ValueError("no training rows")
    found = quantiles.medians(train, numeric, first.n) if exact else first.asDict()
    medians = {c: found[c] if found[c] is not None else 0.0 for c in numeric}
    return sums_by(train, y, [], numeric, categorical, binary, [*medians.values(), first.y])[()].moments(medians)


def fit(train: DataFrame, y: str, numeric: list[str], categorical: list[str] = (), binary: list[str] = (), alpha: float = 1.0, exact: bool = True) -> Ridge:
    """The model of one penalty."""
    return moments(train, y, numeric, categorical, binary, exact).solve(alpha)


def scores(models: list[Ridge], df: DataFrame, y: str) -> list[tuple[float, float, float]]:
    """(alpha, MAE, RMSE) of each model, all from one pass over df."""
    errors = [(m.expression() - F.col(y)) for m in models]
    r = df.agg(*(F.avg(F.abs(e)).alias(f"a{i}") for i, e in enumerate(errors)), *(F.avg(e * e).alias(f"q{i}") for i, e in enumerate(errors))).first()
    return [(m.alpha, r[f"a{i}"], r[f"q{i}"] ** 0.5 if r[f"q{i}"] is not None else None) for i, m in enumerate(models)]


def tune(train: DataFrame, validation: DataFrame, y: str, alphas: tuple[float, ...] = ALPHAS, digits: int = 2, **features) -> tuple[float, list[tuple[float, float, float]]]:
    """(best alpha, [(alpha, MAE, RMSE)]): least MAE on the validation rows, compared at so many digits, the earliest in the grid among equals."""
    found = moments(train, y, **features)
    rows = scores([found.solve(a) for a in alphas], validation, y)
    return min(rows, key=lambda r: round(r[1], digits))[0], rows


def sensitivity(rows: list[tuple[float, float, float]], best: float, tolerance: float = 0.5) -> dict[str, object]:
    """Spread of MAE over the grid, whether the best lies on its edge, and which alphas are within the tolerance of it."""
    maes = {a: m for a, m, _ in rows}
    return {
        "spread": max(maes.values()) - min(maes.values()), "on_edge": best in (min(maes), max(maes)),
        "as_good": [a for a, m in maes.items() if m <= maes[best] + tolerance],
    }


def closed_form(df: DataFrame, x: str, y: str, alphas: tuple[float, ...]) -> DataFrame:
    """(alpha, slope, intercept) of ridge with one feature, for all alphas from one pass: Sxy / (Sxx + alpha)."""
    sums = df.agg(F.count(F.col(x) + F.col(y)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("v"))
    out = sums.select("*", F.explode(F.array(*(F.lit(float(a)) for a in alphas))).alias("alpha"))
    slope: Column = F.col("c") * F.col("n") / F.nullif(F.col("v") * F.col("n") + F.col("alpha"), F.lit(0.0))
    return out.withColumn("slope", slope).select("alpha", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "mx")
