"""DuckDB SQL that fits models on its own: least squares, ridge, logistic regression, trees and boosted trees.

The learners' oracles.  Nothing here reads a fitted model: a regression is solved from its
normal equations (Newton steps for the logistic form), a tree is grown level by level from
grouped sums, so equal predictions mean that the fitted model is right.
"""

from __future__ import annotations

from collections.abc import Sequence


def _solved(k: int, matrix: str, keys: str, out: str) -> str:
    """CTEs that solve a k x k system per row by elimination.

    ``matrix`` is a CTE of columns m_i_j (i <= j; symmetric), b_i and ``keys`` (a list that ends in a comma, or nothing);
    the last CTE, ``out``, has the keys and columns x_0 .. x_{k-1}.
    """
    cell = {(i, j): f"m_{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)}
    ctes = [f"{out}_0 AS (SELECT {keys}" + ", ".join([f"{cell[i, j]} AS a_{i}_{j}" for i in range(k) for j in range(k)]
                                                      + [f"b_{i} AS c_{i}" for i in range(k)]) + f" FROM {matrix})"]
    for p in range(k):
        made = []
        for i in range(k):
            scale = f"a_{i}_{p} / a_{p}_{p}"
            for j in range(k):
                made.append(f"a_{p}_{j} AS a_{p}_{j}" if i == p else f"a_{i}_{j} - {scale} * a_{p}_{j} AS a_{i}_{j}")
            made.append(f"c_{p} AS c_{p}" if i == p else f"c_{i} - {scale} * c_{p} AS c_{i}")
        ctes.append(f"{out}_{p + 1} AS (SELECT {keys}{', '.join(made)} FROM {out}_{p})")
    ctes.append(f"{out} AS (SELECT {keys}" + ", ".join(f"c_{i} / a_{i}_{i} AS x_{i}" for i in range(k)) + f" FROM {out}_{k})")
    return ",\n".join(ctes)


def ridge_ctes(data: str, features: Sequence[str], label: str, reg: float = 0.0, prefix: str = "ls") -> str:
    """CTEs whose last, ``{prefix}``, has coefficients x_j and x_{k} as intercept.

    Spark's objective: mean squared error / 2 plus the penalty ``reg`` / 2 on coefficients in units of the features'
    spread, where the label is scaled to unit spread too: in the label's units the penalty is reg * (its spread).
    """
    k = len(features)
    means = ", ".join([f"avg({f}) AS mean_{j}" for j, f in enumerate(features)] + [f"avg({label}) AS mean_y"])
    cov = [f"covar_pop({features[i]}, {features[j]}) + " + (f"{reg!r} / stddev_pop({label}) * var_pop({features[i]})" if i == j and reg else "0")
           + f" AS m_{i}_{j}" for i in range(k) for j in range(i, k)]
    cov += [f"covar_pop({features[i]}, {label}) AS b_{i}" for i in range(k)]
    return ",\n".join([
        f"{prefix}_m AS (SELECT {means}, {', '.join(cov)} FROM {data})",
        _solved(k, f"{prefix}_m", "", f"{prefix}_s"),
        f"{prefix} AS (SELECT {', '.join(f'x_{j}' for j in range(k))}, mean_y - "
        + " - ".join(f"x_{j} * mean_{j}" for j in range(k)) + f" AS x_{k} FROM {prefix}_s, {prefix}_m)"])


def linear(features: Sequence[str], table: str) -> str:
    """The score of coefficients x_j (last: intercept) in ``table``."""
    return " + ".join(f"{table}.x_{j} * {f}" for j, f in enumerate(features)) + f" + {table}.x_{len(features)}"


def logistic_ctes(data: str, features: Sequence[str], label: str, reg: float, steps: int = 12, prefix: str = "nt") -> str:
    """Newton's method, a step per CTE; ``{prefix}_{steps}`` has coefficients x_j of standardised features and the intercept.

    Objective as Spark's: mean log-loss plus reg / 2 times the squared coefficients of features over their sample spread.
    Columns z_j of ``{prefix}_z`` are the scaled features.
    """
    k = len(features)
    scaled = ", ".join(f"{f} / (SELECT stddev_samp({f}) FROM {data}) AS z_{j}" for j, f in enumerate(features))
    ctes = [f"{prefix}_z AS MATERIALIZED (SELECT *, {scaled}, 1.0::DOUBLE AS z_{k} FROM {data})",
            f"{prefix}_0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS x_{j}" for j in range(k + 1)) + ")"]
    for s in range(steps):
        old = f"{prefix}_{s}"
        eta = " + ".join(f"{old}.x_{j} * z_{j}" for j in range(k + 1))
        pen = [repr(reg) if j < k else "0.0" for j in range(k + 1)]
        cells = [f"avg(p * (1 - p) * z_{i} * z_{j})" + (f" + {pen[i]}" if i == j else "") + f" AS m_{i}_{j}"
                 for i in range(k + 1) for j in range(i, k + 1)]
        cells += [f"avg(({label} - p) * z_{i}) - {pen[i]} * any_value(o_{i}) AS b_{i}" for i in range(k + 1)]
        cells += [f"any_value(o_{i}) AS o_{i}" for i in range(k + 1)]
        ctes.append(f"{prefix}_m{s} AS MATERIALIZED (SELECT {', '.join(cells)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p, "
                    + ", ".join(f"{old}.x_{j} AS o_{j}" for j in range(k + 1)) + f" FROM {prefix}_z, {old}))")
        ctes.append(_solved(k + 1, f"{prefix}_m{s}", "", f"{prefix}_d{s}"))
        ctes.append(f"{prefix}_{s + 1} AS MATERIALIZED (SELECT " + ", ".join(f"o_{j} + {prefix}_d{s}.x_{j} AS x_{j}" for j in range(k + 1))
                    + f" FROM {prefix}_m{s}, {prefix}_d{s})")
    return ",\n".join(ctes)


def tree_ctes(data: str, k: int, label: str, depth: int, gini: bool, prefix: str = "t") -> str:
    """CTEs that grow one tree of ``depth`` levels on features f_0 .. f_{k-1} of ``data``; the last, ``{prefix}``, has all
    columns of ``data`` and ``leaf`` (mean label of the row's leaf; for classes, after leaves of one class have joined).

    Thresholds lie midway between neighbouring values of the whole table.  Of equal gains the first feature's lowest
    threshold wins; a node without gain stays a leaf.  ``gini``: 0/1 labels, else variance.
    """
    values = "[" + ", ".join(f"f_{j}" for j in range(k)) + "]"
    numbers = "[" + ", ".join(map(str, range(k))) + "]"

    def impurity(n, s, ss):
        return f"(1 - ({s} / {n}) ** 2 - (({n} - {s}) / {n}) ** 2)" if gini else f"(({ss} - {s} * {s} / {n}) / {n})"
    ctes = [f"{prefix}_v AS MATERIALIZED (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS above FROM "
            f"(SELECT DISTINCT unnest({numbers}) AS feature, unnest({values}) AS value FROM {data}))",
            f"{prefix}_r0 AS (SELECT *, 1 AS node FROM {data})"]
    for d in range(depth):
        ctes.append(f"""{prefix}_g{d} AS (SELECT node, feature, value, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS ss FROM
  (SELECT node, unnest({numbers}) AS feature, unnest({values}) AS value, {label}::DOUBLE AS y FROM {prefix}_r{d}) GROUP BY ALL)""")
        ctes.append(f"""{prefix}_c{d} AS (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(ss) OVER w AS lss, sum(n) OVER a AS tn,
  sum(s) OVER a AS ts, sum(ss) OVER a AS tss FROM {prefix}_g{d} WINDOW w AS (PARTITION BY node, feature ORDER BY value), a AS (PARTITION BY node, feature))""")
        left, right = impurity("ln", "ls", "lss"), impurity("(tn - ln)", "(ts - ls)", "(tss - lss)")
        ctes.append(f"""{prefix}_b{d} AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, threshold) AS o FROM (
    SELECT node, c.feature, (value + above) / 2 AS threshold, tn,
      {impurity('tn', 'ts', 'tss')} - ln / tn * {left} - (tn - ln) / tn * {right} AS gain
    FROM {prefix}_c{d} c JOIN {prefix}_v v USING (feature, value) WHERE ln < tn)) WHERE o = 1 AND gain > 0)""")
        ctes.append(f"""{prefix}_r{d + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node * 2
  WHEN {values}[b.feature + 1] <= b.threshold THEN r.node * 2 ELSE r.node * 2 + 1 END AS node FROM {prefix}_r{d} r LEFT JOIN {prefix}_b{d} b USING (node))""")
    if not gini:
        ctes.append(f"{prefix} AS MATERIALIZED (SELECT * EXCLUDE (node), avg({label}::DOUBLE) OVER (PARTITION BY node) AS leaf FROM {prefix}_r{depth})")
        return ",\n".join(ctes)
    # leaves of one class below a node are one leaf
    ctes.append(f"{prefix}_k AS (SELECT *, (avg({label}) OVER (PARTITION BY node) > 0.5)::INTEGER AS class FROM {prefix}_r{depth})")
    above = [f"PARTITION BY node >> {depth - lv}" for lv in range(depth + 1)]
    pruned = " ".join(f"WHEN min(class) OVER ({w}) = max(class) OVER ({w}) THEN avg({label}) OVER ({w})" for w in above)
    ctes.append(f"{prefix} AS MATERIALIZED (SELECT * EXCLUDE (node, class), CASE {pruned} END AS leaf FROM {prefix}_k)")
    return ",\n".join(ctes)


def boosted_ctes(data: str, k: int, label: str, rounds: int, depth: int, step: float, keep: Sequence[str],
                 logistic: bool = False) -> str:
    """CTEs of boosted regression trees; the last, ``boosted``, has ``keep``, the features, the label and ``score``.

    The first tree fits the label; each further one fits the loss's negative gradient and counts ``step``: twice the
    residual for squared error, 4 y / (1 + exp(2 y score)) for the logistic loss over labels of -1 and 1.
    """
    cols = ", ".join([*keep, *(f"f_{j}" for j in range(k)), label])
    ctes, now = [f"p0 AS (SELECT {cols}, 0.0::DOUBLE AS score, {label}::DOUBLE AS y_now FROM {data})"], "p0"
    for r in range(rounds):
        ctes.append(tree_ctes(now, k, "y_now", depth, False, f"t{r}"))
        score = f"(score + {1.0 if r == 0 else step!r} * leaf)"
        now = f"p{r + 1}"
        residual = f"4 * {label} / (1 + exp(2 * {label} * {score}))" if logistic else f"2 * ({label} - {score})"
        ctes.append(f"{now} AS MATERIALIZED (SELECT {cols}, {score} AS score, {residual} AS y_now FROM t{r})")
    ctes.append(f"boosted AS (SELECT * FROM {now})")
    return ",\n".join(ctes)


def boosted_split_ctes(data: str, k: int, label: str, rounds: int, depth: int, step: float) -> str:
    """CTEs ``t{round}_b{level}`` of the splits of boosted regression trees (squared loss), as many rounds as asked.

    Trees as ``tree_ctes`` grows them and rounds as those of ``boosted_ctes``, in two CTEs a level: DuckDB takes about a
    thousand.  Gains that differ by less than 1e-12 of the node's mean square are equal (sums in another order round
    otherwise), and of these the first feature's lowest threshold wins; a gain below that is none.
    """
    cols = ", ".join([*(f"f_{j}" for j in range(k)), label])
    values = "[" + ", ".join(f"f_{j}" for j in range(k)) + "]"
    numbers = "[" + ", ".join(map(str, range(k))) + "]"
    ctes = [f"""v AS MATERIALIZED (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS above FROM
  (SELECT DISTINCT unnest({numbers}) AS feature, unnest({values}) AS value FROM {data}))"""]

    def variance(n, s, ss):
        return f"(({ss} - {s} * {s} / {n}) / {n})"
    now = f"(SELECT {cols}, 0.0::DOUBLE AS score, {label}::DOUBLE AS y_now, 1 AS node FROM {data})"
    for r in range(rounds):
        for d in range(depth):
            b = f"t{r}_b{d}"
            ctes.append(f"""{b} AS MATERIALIZED (SELECT node, feature, threshold, tn, gain FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY feature, threshold) AS o FROM (
    SELECT *, max(gain) OVER (PARTITION BY node) AS top FROM (
      SELECT node, c.feature, (value + above) / 2 AS threshold, tn, 1e-12 * tss / tn AS slack,
        {variance('tn', 'ts', 'tss')} - ln / tn * {variance('ln', 'ls', 'lss')} - (tn - ln) / tn * {variance('(tn - ln)', '(ts - ls)', '(tss - lss)')} AS gain
      FROM (SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(ss) OVER w AS lss, sum(n) OVER a AS tn, sum(s) OVER a AS ts, sum(ss) OVER a AS tss
        FROM (SELECT node, feature, value, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS ss FROM
          (SELECT node, unnest({numbers}) AS feature, unnest({values}) AS value, y_now AS y FROM {now}) GROUP BY ALL)
        WINDOW w AS (PARTITION BY node, feature ORDER BY value), a AS (PARTITION BY node, feature)) c
      JOIN v USING (feature, value) WHERE ln < tn))
  WHERE top > slack AND gain >= top - slack) WHERE o = 1)""")
            child = (f"CASE WHEN b.node IS NULL THEN r.node * 2 WHEN {values}[b.feature + 1] <= b.threshold THEN r.node * 2 "
                     f"ELSE r.node * 2 + 1 END")
            moved = f"SELECT r.* EXCLUDE (node), {child} AS node FROM {now} r LEFT JOIN {b} b USING (node)"
            if d == depth - 1:
                score = f"score + {1.0 if r == 0 else step!r} * avg(y_now) OVER (PARTITION BY node)"
                moved = f"SELECT {cols}, score, 2 * ({label} - score) AS y_now, 1 AS node FROM (SELECT {cols}, {score} AS score FROM ({moved}))"
            now = f"t{r}_r{d + 1}"
            ctes.append(f"{now} AS MATERIALIZED ({moved})")
    return ",\n".join(ctes[:-1])  # the last round's scores are not read


def importance_sql(names: Sequence[str], prefixes: Sequence[str], depth: int) -> str:
    """Share of each feature in the sum of gain * rows over all splits of the trees ``prefixes``, as (feature, importance)."""
    splits = " UNION ALL ".join(f"SELECT feature, gain * tn AS worth FROM {p}_b{d}" for p in prefixes for d in range(depth))
    listed = ", ".join(f"({j}, '{n}')" for j, n in enumerate(names))
    return (f"SELECT v.name AS feature, coalesce(sum(worth), 0) / (SELECT sum(worth) FROM ({splits})) AS importance "
            f"FROM (VALUES {listed}) v(feature, name) LEFT JOIN ({splits}) USING (feature) GROUP BY v.name")


def elimination_ctes(data: str, features: Sequence[str], label: str, n_keep: int) -> str:
    """CTEs of backward elimination: ``gone`` has (feature number, rank), the first to go with the highest rank.

    Every step solves the correlation matrix of the features still there (a row of the identity stands for the others)
    and drops the one with the smallest coefficient.
    """
    k = len(features)
    corr = ", ".join([f"corr({features[i]}, {features[j]}) AS r_{i}_{j}" for i in range(k) for j in range(i + 1, k)]
                     + [f"corr({features[i]}, {label}) AS y_{i}" for i in range(k)])
    ctes = [f"cm AS MATERIALIZED (SELECT {corr} FROM {data})", "alive0 AS (SELECT " + ", ".join(f"1 AS a_{i}" for i in range(k)) + ")"]
    drops = k - n_keep
    for s in range(drops):
        cells = [f"CASE WHEN {i} = {j} THEN 1.0 WHEN {f'a_{i} * a_{j}'} = 1 THEN {f'r_{i}_{j}' if i != j else '1.0'} ELSE 0.0 END::DOUBLE AS m_{i}_{j}"
                 for i in range(k) for j in range(i, k)]
        cells += [f"(a_{i} * y_{i})::DOUBLE AS b_{i}" for i in range(k)]
        ctes.append(f"em{s} AS (SELECT {', '.join(cells)} FROM cm, alive{s})")
        ctes.append(_solved(k, f"em{s}", "", f"es{s}"))
        choice = " UNION ALL ".join(f"SELECT {i} AS i, '{features[i]}' AS name, abs(x_{i}) AS size, a_{i} AS alive FROM es{s}, alive{s}" for i in range(k))
        ctes.append(f"drop{s} AS MATERIALIZED (SELECT i FROM ({choice}) WHERE alive = 1 ORDER BY size, name LIMIT 1)")
        ctes.append(f"alive{s + 1} AS MATERIALIZED (SELECT " + ", ".join(f"CASE WHEN i = {i} THEN 0 ELSE a_{i} END AS a_{i}" for i in range(k))
                    + f" FROM alive{s}, drop{s})")
    ctes.append("gone AS (" + " UNION ALL ".join(f"SELECT i, {drops + 1 - s} AS rank FROM drop{s}" for s in range(drops)) + ")")
    return ",\n".join(ctes)


def regression_forecast_sql(src: str, horizon: int, breaks: int, share: float, weekly: int, break_penalty: float, season_penalty: float,
                            holiday: str) -> str:
    """Forecasts of the regression with one holiday (a Boolean over ``day``): normal equations and their solution per series."""
    t = "date_diff('day', first_day, day)::DOUBLE / greatest(1, date_diff('day', first_day, last_day))"
    number = "(date_diff('day', DATE '1970-01-01', day) % 7)"
    cols = [("1.0::DOUBLE", 0.0), ("t", 0.0)] + [(f"greatest(0.0, t - {share * j / (breaks + 1)!r})", break_penalty) for j in range(1, breaks + 1)]
    for n in range(1, weekly + 1):
        cols += [(f"{fn}(2 * pi() * {n} / 7 * {number})", season_penalty) for fn in ("sin", "cos")]
    cols.append((f"({holiday})::INTEGER::DOUBLE", season_penalty))
    k = len(cols)
    xs = ", ".join(f"{e} AS x_{i}" for i, (e, _) in enumerate(cols))
    cells = ", ".join([f"sum(x_{i} * x_{j})" + (f" + count(*) * {cols[i][1] + 1e-12!r}" if i == j else "") + f" AS m_{i}_{j}"
                       for i in range(k) for j in range(i, k)] + [f"sum(x_{i} * y) AS b_{i}" for i in range(k)])
    return f"""WITH s AS (SELECT * FROM {src} q), span AS (SELECT id, min(day) AS first_day, max(day) AS last_day FROM s GROUP BY id),
d AS (SELECT *, {xs} FROM (SELECT s.*, first_day, last_day, {t} AS t FROM s JOIN span USING (id))),
eq AS MATERIALIZED (SELECT id, first_day, last_day, {cells} FROM d GROUP BY ALL),
{_solved(k, "eq", "id, first_day, last_day, ", "beta").replace("x_", "w_")},
h AS (SELECT beta.*, CAST(last_day + hh * INTERVAL 1 DAY AS DATE) AS day FROM beta, (SELECT unnest(range(1, {horizon + 1})) AS hh)),
f AS (SELECT *, {xs} FROM (SELECT *, {t} AS t FROM h))
SELECT id, 'regression' AS model, day, {" + ".join(f"w_{i} * x_{i}" for i in range(k))} AS forecast FROM f"""


def holt_sql(src: str, horizon: int, alphas: Sequence[float], betas: Sequence[float], gammas: Sequence[float] = (), season: int = 1) -> str:
    """Holt's smoothing, or with ``season`` Holt-Winters: every setting steps through the days in a recursive query.

    Series must have two seasons at least.
    """
    m = season
    grid = [(a, b, g) for a in alphas for b in betas for g in (gammas if m > 1 else [0.0])]
    params = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {g!r}::DOUBLE)" for i, (a, b, g) in enumerate(grid))
    first = f"""SELECT id, list(y ORDER BY t) FILTER (t < {2 * m}) AS y0, count(*) AS n FROM s GROUP BY id"""
    if m > 1:
        mean = f"list_avg(y0[1:{m}])"
        begin = (f"{m - 1} AS t, {mean} AS level, (list_avg(y0[{m + 1}:{2 * m}]) - {mean}) / {m} AS trend, "
                 f"list_transform(y0[1:{m}], lambda v: v - {mean}) AS cycle")
    else:
        begin = "0 AS t, y0[1] AS level, y0[2] - y0[1] AS trend, [0.0::DOUBLE] AS cycle"
    at = f"cycle[(r.t + 1) % {m} + 1]"
    new = f"(a * (s.y - {at}) + (1 - a) * (level + trend))"
    turn = (f"list_transform(range({m}), lambda j: CASE WHEN j = (r.t + 1) % {m} THEN g * (s.y - {new}) + (1 - g) * {at} ELSE cycle[j + 1] END)"
            if m > 1 else "cycle")
    return f"""WITH RECURSIVE s AS (SELECT id, day, y, row_number() OVER (PARTITION BY id ORDER BY day) - 1 AS t FROM {src} q),
p(setting, a, b, g) AS (VALUES {params}), first AS ({first}),
r AS (SELECT id, setting, a, b, g, {begin}, 0.0::DOUBLE AS error FROM first, p
  UNION ALL SELECT r.id, setting, a, b, g, r.t + 1, {new}, b * ({new} - level) + (1 - b) * trend, {turn}, error + (s.y - level - trend - {at}) ** 2
  FROM r JOIN s ON s.id = r.id AND s.t = r.t + 1),
best AS (SELECT * FROM (SELECT r.*, n, row_number() OVER (PARTITION BY r.id ORDER BY error, setting) AS place
  FROM r JOIN first ON r.id = first.id AND r.t = n - 1) WHERE place = 1)
SELECT best.id, CAST(last_day + h * INTERVAL 1 DAY AS DATE) AS day, level + h * trend + cycle[(n + h - 1) % {m} + 1] AS forecast
FROM best JOIN (SELECT id, max(day) AS last_day FROM s GROUP BY id) USING (id), (SELECT unnest(range(1, {horizon + 1})) AS h)"""


def eigen_ctes(k: int, matrix: str, count: int, squarings: int = 40, prefix: str = "ev") -> str:
    """CTEs of the ``count`` leading eigenvalues and vectors of a symmetric matrix (one row of columns m_i_j, i <= j).

    Squaring the matrix over and over leaves its leading vector; taking that away leaves the next one's matrix.
    ``{prefix}`` has value_c and v_c_i; each vector's largest entry is positive.
    """
    def m(i, j):
        return f"m_{min(i, j)}_{max(i, j)}"
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    ctes, now = [], matrix
    for c in range(count):
        p = f"{prefix}{c}"
        ctes.append(f"{p}_0 AS MATERIALIZED (SELECT " + ", ".join(f"{m(i, j)} / t AS {m(i, j)}" for i, j in upper)
                    + f" FROM (SELECT *, {' + '.join(m(i, i) for i in range(k))} AS t FROM {now}))")
        for s in range(squarings):
            cells = ", ".join("(" + " + ".join(f"{m(i, x)} * {m(x, j)}" for x in range(k)) + f") AS {m(i, j)}" for i, j in upper)
            ctes.append(f"{p}_q{s} AS (SELECT {cells} FROM {p}_{s})")
            ctes.append(f"{p}_{s + 1} AS MATERIALIZED (SELECT " + ", ".join(f"{m(i, j)} / t AS {m(i, j)}" for i, j in upper)
                        + f" FROM (SELECT *, {' + '.join(m(i, i) for i in range(k))} AS t FROM {p}_q{s}))")
        # the column with the largest diagonal entry, to unit length: that entry is the largest of the vector
        best = "CASE " + " ".join("WHEN " + " AND ".join(f"{m(b, b)} >= {m(i, i)}" for i in range(k)) + f" THEN {{{b}}}" for b in range(k)) + " END"
        entries = []
        for i in range(k):
            e = best
            for b in range(k):
                e = e.replace(f"{{{b}}}", f"{m(i, b)} / sqrt({m(b, b)} * t)")
            entries.append(f"{e} AS v_{i}")
        ctes.append(f"{p}_v AS MATERIALIZED (SELECT {', '.join(entries)} FROM (SELECT *, {' + '.join(m(i, i) for i in range(k))} AS t FROM {p}_{squarings}))")
        value = " + ".join(f"v_{i} * v_{j} * {m(i, j)}" for i in range(k) for j in range(k))
        ctes.append(f"{p} AS MATERIALIZED (SELECT {value} AS value, v.* FROM {now}, {p}_v v)")
        ctes.append(f"{p}_left AS MATERIALIZED (SELECT " + ", ".join(f"{m(i, j)} - value * v_{i} * v_{j} AS {m(i, j)}" for i, j in upper) + f" FROM {now}, {p})")
        now = f"{p}_left"
    ctes.append(f"{prefix} AS (SELECT " + ", ".join(f"{prefix}{c}.value AS value_{c}, " + ", ".join(f"{prefix}{c}.v_{i} AS v_{c}_{i}" for i in range(k))
                                                 for c in range(count)) + " FROM " + ", ".join(f"{prefix}{c}" for c in range(count)) + ")")
    return ",\n".join(ctes)
