"""Formula terms to a design matrix.

Terms: ``x`` (numeric; a text column is a factor, as formulas read it),
``C(x)`` (treatment coding, first sorted level is the reference), ``a*b`` (a +
b + a:b; ``a*b*c`` likewise all subsets, smaller first) and ``a:b``
(interaction only).
Levels come from one distinct pass per factor (bounded by its cardinality,
checked); dummies are ``when`` expressions and products are column
products, so the whole matrix is one ``select``.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 1000
_FACTOR = re.compile(r"^C\((\w+)\)$")


def _safe(s: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", str(s))


def _expand_terms(terms: list[str]) -> list[list[str]]:
    """Each result item is a list of atoms multiplied together."""
    out: list[list[str]] = []
    for t in terms:
        t = t.replace(" ", "")
        if "*" in t:
            atoms = t.split("*")
            for size in range(1, len(atoms) + 1):
                for some in combinations(atoms, size):
                    if list(some) not in out:
                        out.append(list(some))
        elif ":" in t:
            out.append(t.split(":"))
        elif [t] not in out:
            out.append([t])
    return out


def factor_levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    levels = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct()
              .limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"factor {col} has more than {max_levels} levels")
    return sorted(levels)


def design_columns(df: DataFrame, terms: list[str],
                   levels: dict[str, list] | None = None) -> tuple[list[Column], list[str], list[str]]:
    """Column expressions of the design matrix, their safe column names and
    their readable term names (patsy style, e.g. ``C(g)[T.b]:x``)."""
    levels = dict(levels or {})
    types = dict(df.dtypes)
    cols: list[Column] = []
    safe: list[str] = []
    names: list[str] = []

    def atom_parts(a: str):
        m = _FACTOR.match(a)
        if not m and types[a] == "string":
            m = _FACTOR.match(f"C({a})")
        if not m:
            return [(F.col(a).cast("double"), a, a)]
        v = m.group(1)
        if v not in levels:
            levels[v] = factor_levels(df, v)
        return [(F.when(F.col(v).isNull(), F.lit(None).cast("double"))
                 .when(F.col(v) == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0)),
                 f"{v}_T_{_safe(lv)}", f"C({v})[T.{lv}]") for lv in levels[v][1:]]

    for atoms in _expand_terms(terms):
        combos = [(F.lit(1.0), "", "")]
        for a in atoms:
            combos = [(c * pc, f"{s}_x_{ps}" if s else ps, f"{n}:{pn}" if n else pn)
                      for c, s, n in combos for pc, ps, pn in atom_parts(a)]
        for c, s, n in combos:
            cols.append(c.alias(s))
            safe.append(s)
            names.append(n)
    return cols, safe, names


def design_matrix(df: DataFrame, terms: list[str], keep: list[str] | None = None,
                  levels: dict[str, list] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """``(frame with keep + design columns, safe names, term names)``."""
    cols, safe, names = design_columns(df, terms, levels)
    return df.select(*(keep or []), *cols), safe, names
