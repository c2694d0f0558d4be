"""Calibrations: YAML to rows, validation as findings, short command-line forms."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.constraints import FIELDS, OPTIONAL, interval, kind_of, problems

NUMBERS = sorted({k for v in [*FIELDS.values(), *OPTIONAL.values()] for k in v})
CONSTRAINT = "struct<type:string," + ",".join(f"{k}:double" for k in NUMBERS) + ">"
FOSSIL = "struct<fossil_name:string,formation:string,geological_period:string,min_stratigraphic_age:double,max_stratigraphic_age:double,reference:string,confidence:string,notes:string>"
CALIBRATIONS = f"name string, is_root boolean, mrca_pair array<string>, taxa array<string>, target string, constraint {CONSTRAINT}, min_age double, max_age double, fossil {FOSSIL}"
FINDINGS = "name string, check string, severity string, detail string"
KEYS = {"name", "is_root", "mrca_pair", "taxa", "target", "node", "constraint", "fossil"}


def load(text: str) -> tuple[list[dict], list[tuple]]:
    """(sound entries, findings) of one YAML text: a list, or a map with a list under ``calibrations``."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return [], [("", "yaml", "error", str(e).splitlines()[0])]
    if isinstance(data, dict):
        data = data.get("calibrations")
    if not isinstance(data, list) or not data:
        return [], [("", "empty", "error", "no list of calibrations")]
    good, found = [], []
    for i, e in enumerate(data):
        if not isinstance(e, dict):
            found.append((str(i), "not_a_mapping", "error", type(e).__name__))
            continue
        name = str(e.get("name") or f"calibration_{i + 1}")
        faults = [("unknown_key", k) for k in sorted(set(e) - KEYS)]
        node = e.get("node") or {}
        pair, taxa = e.get("mrca_pair") or node.get("mrca_pair"), e.get("taxa") or node.get("taxa")
        if pair is not None and (not isinstance(pair, list) or len(pair) != 2 or pair[0] == pair[1]):
            faults.append(("bad_pair", str(pair)))
        c = e.get("constraint")
        if c is None and not e.get("is_root"):
            faults.append(("no_constraint", name))
        elif c is not None:
            faults += problems(c) if isinstance(c, dict) else [("no_constraint", str(c))]
        fossil = e.get("fossil") or {}
        lo, hi = fossil.get("min_stratigraphic_age"), fossil.get("max_stratigraphic_age")
        fossil |= {k: float(v) for k, v in (("min_stratigraphic_age", lo), ("max_stratigraphic_age", hi)) if v is not None}
        if lo is not None and hi is not None and lo > hi:
            faults.append(("fossil_inverted", name))
        found += [(name, k, "error", v) for k, v in faults]
        if faults:
            continue
        a, b = (None if x is None else float(x) for x in (interval(c) if c else (None, None)))
        if lo is not None and b is not None and b < lo or hi is not None and a is not None and a > hi:
            found.append((name, "fossil_conflict", "warning", "constraint and stratigraphic range are apart"))
        good.append({"name": name, "is_root": bool(e.get("is_root")), "mrca_pair": pair, "taxa": taxa, "target": e.get("target") or name, "constraint": c and {"type": kind_of(c), **{k: float(c[k]) for k in NUMBERS if c.get(k) is not None}}, "min_age": a, "max_age": b, "fossil": fossil or None})
    return good, found


def read_calibrations(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(calibrations, findings) as DataFrames of one configuration text."""
    good, found = load(text)
    rows = [tuple(e[c.split()[0]] for c in ("name", "is_root", "mrca_pair", "taxa", "target")) + ((None if e["constraint"] is None else tuple(e["constraint"].get(k) for k in ("type", *NUMBERS))), e["min_age"], e["max_age"], None if e["fossil"] is None else tuple(e["fossil"].get(k) for k in ("fossil_name", "formation", "geological_period", "min_stratigraphic_age", "max_stratigraphic_age", "reference", "confidence", "notes"))) for e in good]
    return spark.createDataFrame(rows, CALIBRATIONS), spark.createDataFrame(found, FINDINGS)


def parse_short(text: str) -> dict:
    """``TAXON:AGE`` or ``TAXON:MIN-MAX`` (equal bounds are a fixed age)."""
    m = re.fullmatch(r"\s*([^:]+?)\s*:\s*(\d+(?:\.\d+)?)(?:\s*-\s*(\d+(?:\.\d+)?))?\s*", text)
    if not m:
        raise ValueError(f"not TAXON:AGE or TAXON:MIN-MAX: {text}")
    lo, hi = float(m[2]), float(m[3] or m[2])
    c = {"type": "fixed", "age": lo} if lo == hi else {"type": "uniform", "min": lo, "max": hi}
    bad = problems(c)
    if bad:
        raise ValueError("; ".join(f"{k}: {v}" for k, v in bad))
    return {"name": m[1], "constraint": c}
