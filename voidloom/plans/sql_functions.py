"""Functions for SQL: ``register(spark)`` makes them known to a session.

Table functions take a table in parts, and each part is one task's rows:

    SELECT * FROM alpha_complex(TABLE(points) PARTITION BY sample)        -- sample, pid, x, y, z, w
    SELECT * FROM reeb_components(TABLE(nodes) PARTITION BY level)        -- level, gid, ix, iy, iz, nx, ny (0: not periodic)
    SELECT * FROM persistence(TABLE(simplices) PARTITION BY sample)       -- sample, sid, dim, verts, value

Scalar functions are SQL expressions that are put into the query's plan; no Python runs for them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import topology
from ..operators.diagrams import ESSENTIAL

#: name: (arguments, type, expression)
SCALARS = {
    "wrap": ("x DOUBLE, n DOUBLE", "DOUBLE", "pmod(x, n)"),
    "min_image_gap": ("a DOUBLE, b DOUBLE, n DOUBLE", "DOUBLE", "least(abs(a - b), n - abs(a - b))"),
    "min_image_dist": (
        "ax DOUBLE, ay DOUBLE, az DOUBLE, bx DOUBLE, by DOUBLE, bz DOUBLE, n DOUBLE",
        "DOUBLE",
        " + ".join(f"power(least(abs(a{c} - b{c}), n - abs(a{c} - b{c})), 2)" for c in "xyz").join(("sqrt(", ")")),
    ),
    "touching_value": (
        "d DOUBLE, wa DOUBLE, wb DOUBLE",
        "DOUBLE",
        "CASE WHEN d > 0 AND (d * d + wa - wb) / (2 * d) BETWEEN 0 AND d THEN power((d * d + wa - wb) / (2 * d), 2) - wa ELSE greatest(-wa, -wb) END",
    ),
}


class AlphaComplex:
    """Rows of one sample in, its simplices out."""

    def __init__(self):
        self.rows: list[tuple] = []

    def eval(self, row):
        self.rows.append((row["sample"], row["pid"], row["x"], row["y"], row["z"], row["w"]))

    def terminate(self):
        if not self.rows:
            return
        data = sorted(self.rows, key=lambda r: r[1])
        pid = np.array([r[1] for r in data])
        number = 0
        for dim, verts, values in topology.alpha_simplices(np.array([r[2:5] for r in data], float), np.array([r[5] for r in data], float)):
            names = pid[verts]
            for i in np.lexsort((*names.T[::-1], values)):
                yield data[0][0], number, int(dim), [int(v) for v in names[i]], float(values[i])
                number += 1


class Persistence:
    """Simplices of one sample in, its diagram out."""

    def __init__(self):
        self.rows: list[tuple] = []

    def eval(self, row):
        self.rows.append((row["value"], row["dim"], row["sid"], tuple(sorted(row["verts"])), row["sample"]))

    def terminate(self):
        rows = sorted(self.rows)
        reduced, _, owner = topology.reduce_columns(topology.boundaries([r[3] for r in rows]))
        for b, d in owner.items():
            if rows[d][0] > rows[b][0]:
                yield rows[b][4], rows[b][1], rows[b][0], rows[d][0], rows[b][2], rows[d][2]
        for j, r in enumerate(rows):
            if not reduced[j] and j not in owner:
                yield r[4], r[1], r[0], float("inf"), r[2], ESSENTIAL


class ReebComponents:
    """Nodes of one level in, their components out (26 neighbours, through boundaries where nx or ny is given)."""

    def __init__(self):
        self.rows: list[tuple] = []

    def eval(self, row):
        self.rows.append((row["level"], row["gid"], row["ix"], row["iy"], row["iz"], row["nx"], row["ny"]))

    def terminate(self):
        if not self.rows:
            return
        f = pd.DataFrame(sorted(set(self.rows)), columns=["level", "gid", "ix", "iy", "iz", "nx", "ny"])
        at = {c: i for i, c in enumerate(zip(f["ix"], f["iy"], f["iz"], strict=True))}
        nx, ny, seen = int(f["nx"][0]), int(f["ny"][0]), set()
        for first in f.sort_values("gid").itertuples():
            if first.Index in seen:
                continue
            todo = [first.Index]
            seen.add(first.Index)
            while todo:
                i = todo.pop()
                yield int(first.level), int(f["gid"][i]), int(first.gid)
                x, y, z = f["ix"][i], f["iy"][i], f["iz"][i]
                for dx in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        for dz in (-1, 0, 1):
                            j = at.get(((x + dx) % nx if nx else x + dx, (y + dy) % ny if ny else y + dy, z + dz))
                            if j is not None and j not in seen:
                                seen.add(j)
                                todo.append(j)


TABLES = {
    "alpha_complex": (AlphaComplex, "sample int, sid long, dim int, verts array<int>, value double"),
    "persistence": (Persistence, "sample int, dim int, birth double, death double, birth_simplex long, death_simplex long"),
    "reeb_components": (ReebComponents, "level int, gid long, component long"),
}


def register(spark: SparkSession) -> None:
    """Make all functions known to a session."""
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
