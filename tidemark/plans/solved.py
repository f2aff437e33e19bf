"""Ridge in SQL: normal equations as a join, solved by elimination in a recursive query. An independent statement of what the operators must give."""

from __future__ import annotations


def one_hot(column: str, levels: list) -> list[str]:
    """0/1 expressions for the levels of a category; a level that training rows lack weighs nothing."""
    return [f"({column} = {v!r})" for v in levels]


def solved(name: str, train: str, test: str, numeric: list[str], flags: list[str], alpha: float, y: str = "y") -> str:
    """CTEs that end in `name`: the rows of test with pred. train and test are table expressions with a column model: each model is fitted on its train
    rows and scores its test rows, all at once. numeric are filled with the model's median, centred and scaled by the population deviation; flags (0/1
    expressions, null being 0) are centred. The query must begin with WITH RECURSIVE.
    """
    n = len(numeric) + len(flags)
    filled = [f"coalesce({x}, md{i})" for i, x in enumerate(numeric)]
    marks = [f"coalesce(({f})::INT::DOUBLE, 0)" for f in flags]
    row = "[" + ", ".join([f"({x} - a{i}) / d{i}" for i, x in enumerate(filled)] + [f"{f} - c{i}" for i, f in enumerate(marks)]) + "]"
    medians = "".join(f", coalesce(quantile_cont({x}::DOUBLE, 0.5), 0) AS mm{i}" for i, x in enumerate(numeric))
    spread = "".join(f", any_value(mm{i}) AS md{i}, avg(coalesce({x}, mm{i})) AS a{i}, CASE WHEN stddev_pop(coalesce({x}, mm{i})) > 1e-12 THEN stddev_pop(coalesce({x}, mm{i})) ELSE 1 END AS d{i}" for i, x in enumerate(numeric))
    shares = "".join(f", avg({f}) AS c{i}" for i, f in enumerate(marks))
    sparse = "[" + ", ".join([f"({x} - a{i}) / d{i}" for i, x in enumerate(filled)] + marks) + "]"
    centre = "[" + ", ".join(["0::DOUBLE"] * len(numeric) + [f"c{i}" for i in range(len(marks))]) + "]"
    t = name
    return f"""{t}_t AS (SELECT row_number() OVER () AS rid, q.* FROM {train} q WHERE {y} IS NOT NULL),
{t}_m AS (SELECT model, avg({y}) AS mean_y{medians} FROM {t}_t GROUP BY model),
{t}_s AS (SELECT model, any_value(mean_y) AS mean_y, count(*) AS n_rows{spread}{shares} FROM {t}_t JOIN {t}_m USING (model) GROUP BY model),
{t}_d AS (SELECT * FROM (SELECT model, rid, {y} - mean_y AS yc, unnest(range(1, {n + 1})) AS f, unnest({sparse}) AS v FROM {t}_t JOIN {t}_s USING (model)) WHERE v <> 0),
{t}_p AS (SELECT a.model, a.f AS i, b.f AS j, sum(a.v * b.v) AS x FROM {t}_d a JOIN {t}_d b ON a.model = b.model AND a.rid = b.rid GROUP BY a.model, a.f, b.f),
{t}_q AS (SELECT model, i, unnest(range(1, {n + 1})) AS j, n_rows, c FROM (SELECT model, n_rows, {centre} AS c, unnest(range(1, {n + 1})) AS i FROM {t}_s)),
{t}_g AS (SELECT q.model, q.i, q.j, coalesce(p.x, 0) - n_rows * c[q.i] * c[q.j] + CASE WHEN q.i = q.j THEN {alpha}::DOUBLE ELSE 0 END AS x FROM {t}_q q LEFT JOIN {t}_p p ON p.model = q.model AND p.i = q.i AND p.j = q.j),
{t}_y AS (SELECT model, f AS i, sum(v * yc) AS x FROM {t}_d GROUP BY ALL),
{t}_r AS (SELECT g.model, g.i, list_append(list(g.x ORDER BY g.j), coalesce(any_value(b.x), 0)) AS line FROM {t}_g g LEFT JOIN {t}_y b ON g.model = b.model AND g.i = b.i GROUP BY g.model, g.i),
{t}_0 AS (SELECT model, list(line ORDER BY i) AS m FROM {t}_r GROUP BY model),
{t}_k(model, k, m) AS (SELECT model, 0, m FROM {t}_0 UNION ALL
  SELECT model, k + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[i], lambda v: v / m[k + 1][k + 1])
    ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM {t}_k WHERE k < {n}),
{t}_w AS (SELECT model, list_transform(m, lambda r: r[{n + 1}]) AS w FROM {t}_k WHERE k = {n}),
{t} AS (SELECT q.*, mean_y + list_dot_product(w, {row}) AS pred FROM {test} q JOIN {t}_s USING (model) JOIN {t}_w USING (model))"""
