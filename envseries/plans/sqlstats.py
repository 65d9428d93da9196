"""SQL twins of the statistics helpers (Pearson, average ranks, Student-t p)."""

from __future__ import annotations


def pearson_sql(a: str, b: str) -> str:
    return (f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) FILTER (WHERE {b} IS NOT NULL) * "
            f"stddev_samp({b}) FILTER (WHERE {a} IS NOT NULL), 0)")


def avg_rank_sql(x: str, part: str = "") -> str:
    """Average rank of x (ties share the mean rank) within an optional partition."""
    p = f"PARTITION BY {part} " if part else ""
    p2 = f"PARTITION BY {part}, {x}" if part else f"PARTITION BY {x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({p2}) - 1) / 2.0)"


def t_from_r_sql(r: str, n: str) -> str:
    return f"({r}) * sqrt(({n}) - 2) / nullif(sqrt(1 - ({r}) * ({r})), 0)"


def pvalue_cte(src: str, iters: int = 1000) -> str:
    """CTEs computing the two-sided Student-t p-value for rows (id, t, dof) of ``src``.

    Lentz's continued fraction as a recursive CTE; exposes ``pv(id, p)``.
    Must be placed inside ``WITH RECURSIVE``.
    """
    tiny = "1e-300"

    def g(e: str) -> str:
        return f"(CASE WHEN abs({e}) < {tiny} THEN {tiny} ELSE {e} END)"

    aa1 = "(m1 * (bb - m1) * xx / ((aa - 1 + 2 * m1) * (aa + 2 * m1)))"
    d1 = f"(1.0 / {g(f'1.0 + {aa1} * d')})"
    c1 = g(f"1.0 + {aa1} / c")
    aa2 = "(-(aa + m1) * (aa + bb + m1) * xx / ((aa + 2 * m1) * (aa + 1 + 2 * m1)))"
    d2 = f"(1.0 / {g(f'1.0 + {aa2} * {d1}')})"
    c2 = g(f"1.0 + {aa2} / {c1}")
    return f"""
pv_in AS (SELECT id, CAST(t AS DOUBLE) AS t, CAST(dof AS DOUBLE) AS dof,
                 CAST(dof AS DOUBLE) / (CAST(dof AS DOUBLE) + CAST(t AS DOUBLE) * CAST(t AS DOUBLE)) AS x
          FROM ({src}) WHERE t IS NOT NULL AND dof IS NOT NULL AND dof > 0 AND NOT isnan(t)),
pv_sw AS (SELECT id, x, dof / 2.0 AS a, CAST(0.5 AS DOUBLE) AS b, x < (dof / 2.0 + 1.0) / (dof / 2.0 + 2.5) AS direct,
                 CASE WHEN x < (dof / 2.0 + 1.0) / (dof / 2.0 + 2.5) THEN dof / 2.0 ELSE CAST(0.5 AS DOUBLE) END AS aa,
                 CASE WHEN x < (dof / 2.0 + 1.0) / (dof / 2.0 + 2.5) THEN CAST(0.5 AS DOUBLE) ELSE dof / 2.0 END AS bb,
                 CASE WHEN x < (dof / 2.0 + 1.0) / (dof / 2.0 + 2.5) THEN x ELSE 1.0 - x END AS xx
          FROM pv_in WHERE x > 0 AND x < 1),
pv_cf AS (
  SELECT id, 0 AS m, CAST(1.0 AS DOUBLE) AS c, CAST(1.0 / {g('1.0 - (aa + bb) * xx / (aa + 1.0)')} AS DOUBLE) AS d,
         CAST(1.0 / {g('1.0 - (aa + bb) * xx / (aa + 1.0)')} AS DOUBLE) AS h
  FROM pv_sw
  UNION ALL
  SELECT id, m + 1, {c2}, {d2}, h * {d1} * {c1} * {d2} * {c2}
  FROM (SELECT pv_cf.*, CAST(pv_cf.m + 1 AS DOUBLE) AS m1, s.aa, s.bb, s.xx
        FROM pv_cf JOIN pv_sw s USING (id) WHERE pv_cf.m < {iters})),
pv AS (SELECT i.id,
         CASE WHEN s.id IS NULL THEN (CASE WHEN i.x <= 0 THEN 0.0 WHEN i.x >= 1 THEN 1.0 END)
              ELSE least(greatest(CASE WHEN s.direct
                   THEN exp(lgamma(s.a + s.b) - lgamma(s.a) - lgamma(s.b) + s.a * ln(s.x) + s.b * ln(1 - s.x)) * f.h / s.a
                   ELSE 1.0 - exp(lgamma(s.a + s.b) - lgamma(s.a) - lgamma(s.b) + s.a * ln(s.x) + s.b * ln(1 - s.x)) * f.h / s.b
              END, 0.0), 1.0) END AS p
       FROM pv_in i LEFT JOIN pv_sw s USING (id) LEFT JOIN (SELECT id, h FROM pv_cf WHERE m = {iters}) f USING (id))"""
