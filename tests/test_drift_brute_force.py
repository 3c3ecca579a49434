"""The drift report against a plain reading of its definition, file by file."""

from __future__ import annotations

import csv
import re

import pandas as pd
import pytest

from sphaera.plans.data_queries import p2_found


def number(v):
    try:
        return float(v) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) else None
    except ValueError:
        return None


def kind(values):
    if all(re.fullmatch(r"[+-]?\d+", v) for v in values):
        return "integer"
    return "decimal" if all(number(v) is not None for v in values) else "text"


def read(lines):
    """Field names and {run: {field: value}} of one file, runs without a path under their line number."""
    clean = [(i, t) for i, t in enumerate(x.replace("﻿", "") for x in lines) if t.strip() and not t.lstrip().startswith("#")]
    if not clean:
        return None
    header = clean[0][1]
    sep = max(",;\t", key=re.sub(r'"[^"]*"', "", header).count)
    cells = lambda t: [c.strip().strip('"').strip() for c in next(csv.reader([t], delimiter=sep, skipinitialspace=True))]
    names = cells(header)
    runs, values = {}, {n: [] for n in names}
    for i, t in clean:
        row = cells(t)
        if row == names:
            continue
        got = {n: v for n, v in zip(names, row) if v.lower() not in ("", "nan", "na", "null")}
        for n, v in got.items():
            values[n].append(v)
        runs.setdefault(got.get("prediction_path", i), {})
        for n, v in got.items():
            runs[got.get("prediction_path", i)].setdefault(n, v)
    return names, runs, values


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_drift_equals_the_definition(spark, small, folder):
    path = small.replace("sf0.001", folder)
    files = pd.read_parquet(f"{path}/run_files.parquet").drop_duplicates("file_id").sort_values(["experiment", "written_at", "file_id"])
    lines = pd.read_parquet(f"{path}/run_lines.parquet").drop_duplicates(["file_id", "line_no"]).sort_values(["file_id", "line_no"]).groupby("file_id").line.apply(list)
    want = set()
    for _, group in files.groupby("experiment"):
        before, types = None, {}
        for f in group.file_id:
            now = read(lines[f])
            names, runs, values = now
            renamed = {}
            if before:
                gone, fresh = [n for n in before[0] if n not in names], [n for n in names if n not in before[0]]
                for new in fresh:
                    for old in gone:
                        pairs = [(before[1][r][old], runs[r][new]) for r in runs if isinstance(r, str) and r in before[1] and old in before[1][r] and new in runs[r]]
                        if len(pairs) >= 2 and all(a == b or number(a) is not None and number(a) == number(b) for a, b in pairs) and old not in renamed.values():
                            renamed[new] = old
                            break
                want |= {(f, n, "renamed") for n in renamed}
                want |= {(f, n, "added") for n in fresh if n not in renamed}
                want |= {(f, n, "removed") for n in gone if n not in renamed.values()}
            types = {n: types.get(renamed.get(n, n)) if before else None for n in names}
            for n in names:
                if values[n]:
                    if types[n] and types[n] != kind(values[n]):
                        want.add((f, n, "type_changed"))
                    types[n] = kind(values[n])
            before = now
    got = {(r.file_id, r.field_name, r.drift) for r in p2_found(spark, path).collect()}
    assert got == want
