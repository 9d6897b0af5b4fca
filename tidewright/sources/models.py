"""Emulators as JSON beside their training table, and checkpoints of proposed points.

The table of training rows is written once for all emulators; each emulator
lists the ids of its rows and its fixed priors, so an import re-trains without
any search. Terms are parsed; no text is ever evaluated.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basis import Basis, parse_term
from ..functions.kernels import Correlator
from ..functions.scalar import scale_array
from ..plans.emulator import Emulator, HierarchicalEmulator


def uid(*cols: str):
    """An id of a row by its values."""
    return F.sha2(F.concat_ws("|", *(F.format_string("%.15g", F.col(c).cast("double")) for c in cols)), 256)


def export_emulators(ems: list[Emulator], spark: SparkSession, filename: str, table: str | None = None) -> None:
    """Write deterministic emulators: JSON, and the training rows as Parquet at ``table`` (or inside the JSON)."""
    if any(isinstance(e, HierarchicalEmulator) or type(e) is not Emulator or callable(e.sigma) for e in ems):
        raise ValueError("only deterministic emulators with a number as sigma can be exported")
    inputs = list(dict.fromkeys(n for e in ems for n in e.inputs))
    rows: dict[tuple, dict] = {}
    doc = {"inputs": inputs, "emulators": []}
    for e in ems:
        points = scale_array(e.x, e.ranges, forward=False) if e.x is not None else np.empty((0, len(e.inputs)))
        ids = []
        for p, y in zip(points, [] if e.y is None else e.y, strict=True):
            k = tuple(round(float(v), 12) for v in p)
            row = rows.setdefault(k, {"uid": str(len(rows)), **dict(zip(e.inputs, map(float, p), strict=True))})
            row[e.name] = float(y)
            ids.append(row["uid"])
        doc["emulators"].append(
            {
                "name": e.name,
                "ranges": {k: list(v) for k, v in e.ranges.items()},
                "basis": e.basis.text(),
                "beta": e.beta_mu.tolist(),
                "beta_sigma": e.beta_sigma.tolist() if e.beta_sigma.any() else None,
                "disc": list(e.disc),
                "kernel": e.corr.name,
                "hyper": {k: np.asarray(v).tolist() for k, v in e.corr.hp},
                "nugget": e.corr.nugget,
                "sigma": float(e.sigma),
                "multiplier": e.multiplier,
                "rows": ids,
            }
        )
    if table and rows:
        cols = ["uid", *inputs, *(e.name for e in ems)]
        spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows.values()], "uid string, " + ", ".join(f"`{c}` double" for c in cols[1:])).write.mode("overwrite").parquet(table)
        doc["table"] = table
    else:
        doc["data"] = list(rows.values())
    with open(filename, "w") as f:
        json.dump(doc, f)


def import_emulators(spark: SparkSession, filename: str) -> dict[str, Emulator]:
    with open(filename) as f:
        doc = json.load(f)
    data = {r["uid"]: r for r in (spark.read.parquet(doc["table"]).toPandas().to_dict("records") if "table" in doc else doc["data"])}
    out = {}
    for m in doc["emulators"]:
        names = list(m["ranges"])
        basis = Basis(tuple(names), tuple(parse_term(t, names) for t in m["basis"]))
        hp = {k: np.array(v) if isinstance(v, list) else v for k, v in m["hyper"].items()}
        ranges = {k: tuple(v) for k, v in m["ranges"].items()}
        em = Emulator(basis=basis, beta_mu=np.array(m["beta"]), sigma=m["sigma"], ranges=ranges, corr=Correlator.of(m["kernel"], m["nugget"], **hp), beta_sigma=None if m["beta_sigma"] is None else np.array(m["beta_sigma"]), name=m["name"], disc=tuple(m["disc"]), multiplier=m["multiplier"])
        own = [data[i] for i in m["rows"]]
        out[m["name"]] = em.adjust(np.array([[r[n] for n in names] for r in own]), np.array([r[m["name"]] for r in own])) if own else em
    return out


def checkpoint_points(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Proposed points as CSV (with a header) or Parquet, replacing what was there."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def rows_by_uid(df: DataFrame, cols: list[str], ids: DataFrame) -> DataFrame:
    """The rows whose id is listed."""
    return df.withColumn("uid", uid(*cols)).join(ids.select("uid").distinct(), "uid", "left_semi")
