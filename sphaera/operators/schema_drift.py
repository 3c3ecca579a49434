"""Delimited run logs whose fields drift from file to file.

Every field of every file gets a tagged union: how many of its values are whole numbers, other numbers or
text. Unions of parallel parts of a file fuse by addition, so a file of any length is inferred in a map-side
aggregate. Files of one experiment are then walked in the order they were written, one row of unions a file,
with only the types of the fields now alive as state.

Defined results for odd input: null lines and null file ids are skipped; a file without lines has no fields and
takes no part; a file that is in ``run_lines`` only belongs to no experiment and takes no part; repeated rows
(same file and line number) count once, the smallest text wins; cells beyond the header are ignored, missing
ones are no values; of two columns with one name the first counts; an empty table gives an empty result; other
columns of the inputs are ignored.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera import session

DELIMITERS = ",;\t|"
NO_VALUE = frozenset({"", "nan", "na", "null"})
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
RUN_KEY = "prediction_path"
_BOM = "﻿"


def _split(line: str, delimiter: str) -> list[str]:
    """Cells of one line; a quote that is never closed is an ordinary character."""
    text = line.strip("\r\n").lstrip(_BOM)
    if '"' not in text and "'" not in text:
        return [c.strip() for c in text.split(delimiter)]
    quote = '"' if '"' in text else "'"
    if text.count(quote) % 2:
        return [c.strip().strip(quote).strip() for c in text.split(delimiter)]
    cells = next(csv.reader([text], delimiter=delimiter, quotechar=quote, skipinitialspace=True), [])
    return [c.strip() for c in cells]


@lru_cache(maxsize=4096)
def parse_header(line: str) -> tuple[str, tuple[str, ...]]:
    """Delimiter and field names of a header line."""
    bare = re.sub(r'"[^"]*"', "", line)
    delimiter = max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))
    return delimiter, tuple(c.strip(" \t\"'" + _BOM) for c in _split(line, delimiter))


def _is_header(cells: list[str], names: tuple[str, ...]) -> bool:
    return tuple(c.strip(" \t\"'" + _BOM) for c in cells) == names


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"file_id": [], "line_no": [], "run": [], "cells": []}
        for file_id, line_no, line, header in zip(*(batch.column(i).to_pylist() for i in range(4))):
            delimiter, names = parse_header(header)
            cells = _split(line, delimiter)
            if _is_header(cells, names):
                continue
            values = [c if c.lower() not in NO_VALUE else None for c in cells[: len(names)]]
            values += [None] * (len(names) - len(values))
            rows["file_id"].append(file_id)
            rows["line_no"].append(line_no)
            rows["run"].append(values[names.index(RUN_KEY)] if RUN_KEY in names else None)
            rows["cells"].append(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["file_id"], pa.int64()), pa.array(rows["line_no"], pa.int32()), pa.array(rows["run"], pa.string()), pa.array(rows["cells"], pa.list_(pa.string()))],
            names=list(rows),
        )


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [list(dict.fromkeys(parse_header(h)[1])) for h in batch.column(1).to_pylist()]
        columns = [list(parse_header(h)[1]) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.list_(pa.string())), pa.array(columns, pa.list_(pa.string()))],
            names=["file_id", "header", "names", "columns"],
        )


def parse_runs(run_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers: file_id, header, names, columns) and (runs: file_id, line_no, run, cells)."""
    lines = (
        run_lines.select("file_id", "line_no", "line")
        .where("file_id is not null and line_no is not null and line is not null")
        .groupBy("file_id", "line_no")
        .agg(F.min("line").alias("line"))
        .where(~F.regexp_replace("line", "^[﻿\\s]+", "").rlike(r"^(#.*)?$"))
    )
    headers = lines.groupBy("file_id").agg(F.min_by("line", "line_no").alias("header"))
    headers = session.materialize(headers.mapInArrow(_names, "file_id long, header string, names array<string>, columns array<string>"), "headers")
    runs = lines.join(headers.select("file_id", "header"), "file_id").select("file_id", "line_no", "line", "header")
    return headers, session.materialize(runs.mapInArrow(_parse, "file_id long, line_no int, run string, cells array<string>"), "parsed")


def _files(run_files: DataFrame, headers: DataFrame) -> DataFrame:
    """One row a file with its predecessor in the experiment, if any."""
    from pyspark.sql import Window

    files = (
        run_files.where("file_id is not null and experiment is not null")
        .groupBy("file_id")
        .agg(F.min("experiment").alias("experiment"), F.min("written_at").alias("written_at"))
        .join(headers, "file_id")
    )
    order = Window.partitionBy("experiment").orderBy(F.col("written_at").asc_nulls_first(), "file_id")
    return files.withColumn("prev_id", F.lag("file_id").over(order)).withColumn("prev_names", F.lag("names").over(order))


def tagged_unions(headers: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id, field, n, n_integer, n_number): the union of each field of each file."""
    cell = runs.join(headers.select("file_id", "columns"), "file_id").select(
        "file_id", F.explode(F.filter(F.arrays_zip(F.col("columns").alias("field"), F.col("cells").alias("value")), lambda p: p["value"].isNotNull())).alias("p")
    )
    return (
        cell.select("file_id", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
        .groupBy("file_id", "field")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("value").rlike(INTEGER)).alias("n_integer"),
            F.count_if(F.col("value").rlike(NUMBER)).alias("n_number"),
        )
    )


def _kind() -> Column:
    return (
        F.when(F.col("n_integer") == F.col("n"), F.lit("integer"))
        .when(F.col("n_number") == F.col("n"), F.lit("decimal"))
        .otherwise(F.lit("text"))
    )


def _long(runs: DataFrame, wanted: DataFrame, target: str, field: str, value: str) -> DataFrame:
    """Values of the wanted fields, one row for a run and field; of repeated runs the first line with a value."""
    picked = runs.where("run is not null").join(wanted, "file_id")
    exploded = picked.select(F.col(target).alias("target"), "run", "line_no", F.explode(F.arrays_zip(F.col("columns").alias("field"), F.col("cells").alias("value"))).alias("p"), "wanted")
    return (
        exploded.where(F.array_contains("wanted", F.col("p.field")) & F.col("p.value").isNotNull())
        .groupBy("target", "run", F.col("p.field").alias(field))
        .agg(F.min_by(F.col("p.value"), "line_no").alias(value))
    )


def renames(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id, new_name, old_name, n): gone and new fields that agree in all runs of both files."""
    pairs = (
        files.where("prev_id is not null")
        .select("file_id", "prev_id", "columns", F.array_except("prev_names", "names").alias("gone"), F.array_except("names", "prev_names").alias("fresh"))
        .where("size(gone) > 0 and size(fresh) > 0")
    )
    columns = files.select(F.col("file_id").alias("prev_id"), F.col("columns").alias("prev_columns"))
    now = _long(runs, pairs.select("file_id", F.col("file_id").alias("t"), "columns", F.col("fresh").alias("wanted")), "t", "new_name", "new_value")
    before = _long(
        runs,
        pairs.drop("columns").join(columns, "prev_id").select(F.col("prev_id").alias("file_id"), F.col("file_id").alias("t"), F.col("prev_columns").alias("columns"), F.col("gone").alias("wanted")),
        "t",
        "old_name",
        "old_value",
    )
    number = lambda c: F.when(F.col(c).rlike(NUMBER), F.col(c).cast("double"))
    same = (F.col("new_value") == F.col("old_value")) | F.coalesce(number("new_value") == number("old_value"), F.lit(False))
    return (
        now.join(before, ["target", "run"])
        .groupBy(F.col("target").alias("file_id"), "new_name", "old_name")
        .agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))
        .where("n >= 2 and n = n_same")
        .select("file_id", "new_name", "old_name", "n")
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the fields of each experiment through its files, which come in order."""
    experiment, known, origin, earlier = None, {}, {}, None
    for batch in batches:
        out: dict[str, list] = {"experiment": [], "file_id": [], "field_name": [], "drift": [], "was": [], "now": [], "canonical": []}

        def say(file_id: int, field: str, drift: str, was: str | None = None, now: str | None = None) -> None:
            for k, v in zip(out, (experiment, file_id, field, drift, was, now, origin.get(field))):
                out[k].append(v)

        for row in batch.to_pylist():
            if row["experiment"] != experiment:
                experiment, known, origin, earlier = row["experiment"], {}, {}, None
            names, kinds = row["names"], {u["field"]: u["kind"] for u in row["unions"] or []}
            pairs, taken_new, taken_old = [], set(), set()
            for r in sorted(row["renames"] or [], key=lambda r: (-r["n"], r["new_name"], r["old_name"])):
                if r["new_name"] not in taken_new and r["old_name"] not in taken_old:
                    taken_new.add(r["new_name"])
                    taken_old.add(r["old_name"])
                    pairs.append((r["new_name"], r["old_name"]))
            source, removed = dict(pairs), {}
            if earlier is not None:
                removed = {f: known.get(f) for f in earlier if f not in set(names) and f not in taken_old}
            known_now = {f: known.get(source.get(f, f)) if earlier is not None else None for f in names}
            origin_now = {f: origin.get(source.get(f, f), f) for f in names}
            gone = {f: origin.get(f) for f in removed}
            origin = origin_now
            if earlier is not None:
                for f in names:
                    if f in source:
                        say(row["file_id"], f, "renamed", source[f], f)
                    elif f not in earlier:
                        say(row["file_id"], f, "added", None, kinds.get(f))
                for f, kind in removed.items():
                    origin[f] = gone[f]
                    say(row["file_id"], f, "removed", kind, None)
                    del origin[f]
            for f in names:
                if kinds.get(f) and known_now[f] and kinds[f] != known_now[f]:
                    say(row["file_id"], f, "type_changed", known_now[f], kinds[f])
                known_now[f] = kinds.get(f) or known_now[f]
                say(row["file_id"], f, "field", None, known_now[f])
            known, earlier = known_now, set(names)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "file_id" else pa.string()) for k, v in out.items()], names=list(out))


def drift_report(run_files: DataFrame, run_lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, headers, runs).

    changes: experiment, file_id, field_name, drift, was, now, canonical. Rows with drift ``field`` carry the
    name a field had when it first appeared; the others are the changes themselves.
    """
    headers, runs = parse_runs(run_lines)
    files = _files(run_files, headers)
    unions = tagged_unions(headers, runs).groupBy("file_id").agg(F.collect_list(F.struct("field", _kind().alias("kind"))).alias("unions"))
    named = renames(files, runs).groupBy("file_id").agg(F.collect_list(F.struct("new_name", "old_name", "n")).alias("renames"))
    walk = (
        files.select("experiment", "written_at", "file_id", "names")
        .join(unions, "file_id", "left")
        .join(named, "file_id", "left")
        .withColumn("place", F.xxhash64("experiment", F.lit(1)))
        .repartition("place")
        .sortWithinPartitions("experiment", F.col("written_at").asc_nulls_first(), "file_id")
        .select("experiment", "file_id", "names", "unions", "renames")
    )
    changes = walk.mapInArrow(_walk, "experiment string, file_id long, field_name string, drift string, was string, now string, canonical string")
    return changes, headers, runs


def consistent_table(run_files: DataFrame, run_lines: DataFrame) -> DataFrame:
    """All runs of all files of the experiments in one table, one row for a run and field.

    A field keeps the name it had when it first appeared in its experiment. Conflicting types stay side by side
    as typed branches (``as_integer``, ``as_decimal``, ``as_text``) next to the canonical text. Of a run that
    several files repeat, the value in the file written last counts. A line without a ``prediction_path`` equals
    no other line and is a run of its own: its path is null, ``file_id`` and ``line_no`` are its key (null else).
    """
    changes, headers, runs = drift_report(run_files, run_lines)
    lineage = changes.where("drift = 'field'").select("experiment", "file_id", "field_name", "canonical")
    order = run_files.where("file_id is not null").groupBy("file_id").agg(F.min("written_at").alias("written_at"))
    cells = (
        runs.join(headers.select("file_id", "columns"), "file_id")
        .join(order, "file_id")
        .select("file_id", "written_at", "line_no", "run", F.explode(F.arrays_zip(F.col("columns").alias("field"), F.col("cells").alias("value"))).alias("p"))
        .where("p.value is not null")
        .select("file_id", "written_at", "line_no", "run", F.col("p.field").alias("field_name"), F.col("p.value").alias("value"))
    )
    latest = F.struct(F.coalesce("written_at", F.timestamp_seconds(F.lit(0))), "file_id", -F.col("line_no"))
    own = [F.when(F.col("run").isNull(), F.col(c)).alias(f"key_{c}") for c in ("file_id", "line_no")]
    return (
        cells.join(lineage, ["file_id", "field_name"])
        .groupBy("experiment", F.col("run").alias("prediction_path"), *own, F.col("canonical").alias("field"))
        .agg(F.max_by("value", latest).alias("value"))
        .select(
            "experiment",
            "prediction_path",
            "field",
            F.when(F.col("value").rlike(INTEGER), F.expr("try_cast(value as bigint)")).alias("as_integer"),
            F.when(F.col("value").rlike(NUMBER), F.col("value").cast("double")).alias("as_decimal"),
            F.when(~F.col("value").rlike(NUMBER), F.col("value")).alias("as_text"),
            "value",
            F.col("key_file_id").alias("file_id"),
            F.col("key_line_no").alias("line_no"),
        )
    )


MOST_FIELDS = 2_000
_TYPED = {"integer": "bigint", "decimal": "double", "text": "string"}


def column_names(fields: list[str], taken: tuple[str, ...]) -> dict[str, str]:
    """A column name for each field: its own, numbered where letter case alone tells fields apart or a key has the name."""
    out: dict[str, str] = {}
    used = {t.lower() for t in taken}
    for f in sorted(fields):
        name, n = f, 1
        while name.lower() in used:
            n += 1
            name = f"{f}_{n}"
        used.add(name.lower())
        out[f] = name
    return out


def wide_table(run_files: DataFrame, run_lines: DataFrame) -> DataFrame:
    """All runs in one table, one row a run and one column a field, in the field's fused type.

    A field whose values over all experiments are all whole numbers is a bigint, else a double if all are numbers, else text, as
    whole numbers beyond 18 digits are too. The field names are told to the driver, which refuses more than ``MOST_FIELDS``.
    Keys: experiment, and prediction_path or, for lines without one, file_id and line_no. Runs without any value are no rows.
    """
    cells = session.materialize(consistent_table(run_files, run_lines), "runs")
    unions = cells.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(F.col("as_integer").isNotNull()).alias("n_integer"), F.count_if(F.col("as_decimal").isNotNull()).alias("n_number")
    )
    kinds = {r.field: r.kind for r in unions.select("field", _kind().alias("kind")).limit(MOST_FIELDS + 1).collect()}
    if len(kinds) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    keys = ["experiment", "prediction_path", "file_id", "line_no"]
    names = column_names([f for f in kinds if f != RUN_KEY], tuple(keys))
    rows = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("of"))
    typed = [F.col("of").getItem(f).try_cast(_TYPED[kinds[f]]).alias(n) for f, n in names.items()]
    return rows.select(*keys, *typed)
