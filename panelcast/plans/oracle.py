"""DuckDB oracle SQL, written from the definitions (not from the Spark plans).

Building blocks for the fixture panel, the preparation block, the key
hash, and closed forms of least squares with one or two inputs (Cramer's
rule on population covariances; Ridge adds alpha/n to the diagonal; the
two-input Lasso is found by checking the KKT conditions of every active
set, which has exactly one solution when the covariance is positive
definite).
"""

from __future__ import annotations

PANEL = """SELECT {series} AS series, CAST(l_shipdate AS DATE) AS day,
  avg(l_quantity) AS x_qty, avg(l_extendedprice) AS x_price, avg(l_discount) AS x_disc,
  avg(l_tax) AS x_tax, avg(p_size) AS x_size, avg(p_retailprice) AS x_retail,
  avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS x_open,
  avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS x_ret,
  count(*) AS y, count(DISTINCT l_orderkey) AS y_drop
FROM lineitem {joins}
JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2"""

REGION_JOINS = ("JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey "
                "JOIN region ON n_regionkey = r_regionkey")


def panel_sql(key: str = "region") -> str:
    if key == "region":
        return PANEL.format(series="r_name", joins=REGION_JOINS)
    return PANEL.format(series="l_suppkey", joins="")


def prep_ctes(cols: list[str] | None, key: str = "region") -> str:
    """``panel``, ``prep`` (month, sine, cosine, previous-row target) and
    ``clean`` (rows with no null in ``cols``; all columns if ``None``)."""
    allc = ["series", "day", "x_qty", "x_price", "x_disc", "x_tax", "x_size", "x_retail", "x_open",
            "x_ret", "y", "month", "month_sin", "month_cos", "y_prev"]
    cond = " AND ".join(f"{c} IS NOT NULL" for c in (cols if cols is not None else allc)) or "TRUE"
    return f"""panel AS ({panel_sql(key)}),
prep AS (SELECT * EXCLUDE (y_drop), month(day) AS month,
  sin(2 * pi() * month(day) / 12) AS month_sin, cos(2 * pi() * month(day) / 12) AS month_cos,
  lag(y) OVER (PARTITION BY series ORDER BY day) AS y_prev FROM panel),
clean AS (SELECT * FROM prep WHERE {cond})"""


def hash_expr(seed: int = 42, salt: str = "") -> str:
    return f"md5(concat_ws('|', CAST(series AS VARCHAR), CAST(day AS VARCHAR), '{seed}{salt}'))"


def hash_bits(h: str) -> str:
    return f"('0x' || substr({h}, 1, 8))::BIGINT"


def r(expr: str, d: int = 6) -> str:
    """Rounded for comparison; the same tie nudge as the Spark side."""
    nudge = repr(3.71e-5 * 10.0 ** (-d))
    return f"(round(({expr}) + {nudge}, {d}) + 0.0)"


# ------------------------------------------------------ closed-form fits
def stats_cols(feats: list[str], y: str = "y") -> str:
    cols = ["count(*) AS n", f"avg({y}) AS my"]
    for i, a in enumerate(feats, 1):
        cols.append(f"avg({a}) AS m{i}")
        cols.append(f"covar_pop({a}, {y}) AS c{i}")
        for j, b in enumerate(feats, 1):
            if j >= i:
                cols.append(f"covar_pop({a}, {b}) AS a{i}{j}")
    return ", ".join(cols)


def coef_cols(p: int, alpha: str = "0.0") -> str:
    """``w1..wp`` and ``b0`` from the stats columns (Ridge penalty ``alpha``)."""
    lam = f"(({alpha}) / n)"
    if p == 0:
        return "my AS b0"
    if p == 1:
        w1 = f"c1 / (a11 + {lam})"
        return f"{w1} AS w1, my - ({w1}) * m1 AS b0"
    d = f"((a11 + {lam}) * (a22 + {lam}) - a12 * a12)"
    w1 = f"(((a22 + {lam}) * c1 - a12 * c2) / {d})"
    w2 = f"(((a11 + {lam}) * c2 - a12 * c1) / {d})"
    return f"{w1} AS w1, {w2} AS w2, my - {w1} * m1 - {w2} * m2 AS b0"


def pred_expr(feats: list[str], s: str = "s", c: str = "c") -> str:
    return " + ".join([f"{c}.b0"] + [f"{c}.w{i} * {s}.{a}" for i, a in enumerate(feats, 1)])


def lasso2_coef(alpha: str = "alpha") -> str:
    """SELECT list body giving ``w1, w2`` of the two-input Lasso
    (objective 1/(2n)||y - b - Xw||^2 + alpha||w||_1) from stats columns
    a11, a12, a22, c1, c2 (population covariances)."""
    A = alpha
    det = "(a11 * a22 - a12 * a12)"

    def both(s1, s2):
        w1 = f"((a22 * (c1 - {A} * ({s1})) - a12 * (c2 - {A} * ({s2}))) / {det})"
        w2 = f"((a11 * (c2 - {A} * ({s2})) - a12 * (c1 - {A} * ({s1}))) / {det})"
        return w1, w2

    one1 = f"(sign(c1) * (abs(c1) - {A}) / a11)"
    one2 = f"(sign(c2) * (abs(c2) - {A}) / a22)"
    cases = [f"WHEN abs(c1) <= {A} AND abs(c2) <= {A} THEN [0.0, 0.0]",
             f"WHEN abs(c1) > {A} AND abs(c2 - a12 * {one1}) <= {A} THEN [{one1}, 0.0]",
             f"WHEN abs(c2) > {A} AND abs(c1 - a12 * {one2}) <= {A} THEN [0.0, {one2}]"]
    for s1, s2 in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
        w1, w2 = both(s1, s2)
        cases.append(f"WHEN sign({w1}) = {s1} AND sign({w2}) = {s2} THEN [{w1}, {w2}]")
    return "CASE " + " ".join(cases) + " END"


def ridge2_ws(alpha: str = "alpha") -> tuple[str, str]:
    """``w1, w2`` of the two-input Ridge from stats columns."""
    lam = f"(({alpha}) / n)"
    d = f"((a11 + {lam}) * (a22 + {lam}) - a12 * a12)"
    return (f"(((a22 + {lam}) * c1 - a12 * c2) / {d})", f"(((a11 + {lam}) * c2 - a12 * c1) / {d})")


# ------------------------------------------------------------------- PCA
def _rot_b(m: str, i: str, j: str, n: int) -> str:
    """Element (i, j) of M times the Jacobi rotation in plane (pp, qq)."""
    return (f"(CASE WHEN ({j}) = pp THEN {m}[({i})*{n}+pp+1]*c - {m}[({i})*{n}+qq+1]*s "
            f"WHEN ({j}) = qq THEN {m}[({i})*{n}+pp+1]*s + {m}[({i})*{n}+qq+1]*c ELSE {m}[({i})*{n}+({j})+1] END)")


def _rot_a(i: str, j: str, n: int) -> str:
    """Element (i, j) of J' A J."""
    return (f"(CASE WHEN ({i}) = pp THEN c*{_rot_b('a', 'pp', j, n)} - s*{_rot_b('a', 'qq', j, n)} "
            f"WHEN ({i}) = qq THEN s*{_rot_b('a', 'pp', j, n)} + c*{_rot_b('a', 'qq', j, n)} "
            f"ELSE {_rot_b('a', i, j, n)} END)")


def pca_ctes(src: str, cols: list[str], names: list[str], iters: int = 200) -> str:
    """Eigen-decomposition of the correlation matrix of ``cols`` over the
    relation ``src`` by the classical Jacobi method (one rotation of the
    largest off-diagonal element per recursion step; matrix and rotations
    kept as row-major lists).  Defines ``fin`` (final matrices), ``ord``
    (eigen index i, eigenvalue lam, component by descending eigenvalue),
    ``tot`` (sum of eigenvalues) and ``load`` (component, var_idx, variable,
    loading with its largest absolute entry made positive)."""
    n = len(cols)
    ident = "CAST([" + ", ".join("1" if i == j else "0" for i in range(n) for j in range(n)) + "] AS DOUBLE[])"
    corr = "[" + ", ".join(f"corr({a}, {b})" for a in cols for b in cols) + "]"
    tn, tm = f"t // {n}", f"t % {n}"
    names_list = "[" + ", ".join(f"'{x}'" for x in names) + "]"
    return f"""it(k, a, v) AS (
  SELECT 0, {corr}, {ident} FROM {src}
  UNION ALL
  SELECT k + 1, list_transform(range({n * n}), lambda t: {_rot_a(tn, tm, n)}),
    list_transform(range({n * n}), lambda t: {_rot_b('v', tn, tm, n)})
  FROM (SELECT k, a, v, pp, qq, cos(th) AS c, sin(th) AS s FROM (
    SELECT k, a, v, pp, qq, 0.5 * atan2(2 * a[pp*{n}+qq+1], a[qq*{n}+qq+1] - a[pp*{n}+pp+1]) AS th FROM (
      SELECT k, a, v, (km - 1) // {n} AS pp, (km - 1) % {n} AS qq FROM (
        SELECT k, a, v, list_position(off, list_max(off)) AS km FROM (
          SELECT k, a, v, list_transform(a, lambda x, i: CASE WHEN (i - 1) // {n} < (i - 1) % {n} THEN abs(x) ELSE 0.0 END) AS off
          FROM it WHERE k < {iters})))))),
fin AS (SELECT a, v FROM it WHERE k = {iters}),
ev AS (SELECT r.i, fin.a[r.i * {n} + r.i + 1] AS lam FROM fin, range({n}) r(i)),
ord AS (SELECT i, lam, CAST(row_number() OVER (ORDER BY lam DESC) AS INTEGER) AS component FROM ev),
tot AS (SELECT sum(greatest(lam, 0)) AS t FROM ev),
vec AS (SELECT o.component, r.j AS var_idx, fin.v[r.j * {n} + o.i + 1] AS val FROM ord o, fin, range({n}) r(j)),
sgn AS (SELECT component, arg_max(val, abs(val)) AS big FROM vec GROUP BY component),
load AS (SELECT vec.component, vec.var_idx, {names_list}[vec.var_idx + 1] AS variable, val * sign(big) AS loading
         FROM vec JOIN sgn ON vec.component = sgn.component)"""
