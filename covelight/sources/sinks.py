"""Many config files and their manifest, written by tasks and put in place by one rename each. Nothing but counts comes to the
driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import places


def write_configs(configs: DataFrame, folder: str, name: str = "run_id") -> int:
    """One YAML file a row: <folder>/<name>.yaml with the row's other columns as its record. Tasks write into a folder of another
    name, which takes its place once every row is written; a job that fails leaves what was there. Returns the number."""
    part = f"{folder.rstrip('/')}.{uuid.uuid4().hex}.part"
    names, rows = configs.agg(F.count_distinct(name), F.count(F.lit(1))).first()
    if names != rows:
        raise ValueError(f"{rows - names} configs have a name that another has too, or none")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in parts:
            for file, record in zip(pdf["name"], pdf["record"], strict=True):
                places.write_text(f"{part}/{file}.yaml", yaml.safe_dump(json.loads(record), sort_keys=False, allow_unicode=True))
            yield pd.DataFrame({"n": [len(pdf)]})

    records = configs.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct(*[c for c in configs.columns if c != name]), {"ignoreNullFields": "false"}).alias("record"))
    try:
        written = records.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
        if written != rows:
            raise RuntimeError(f"{written} of {rows} configs were written")
    except Exception:
        places.remove(part)
        raise
    if rows:
        places.rename(part, folder)
    return rows


def write_manifest(rows: DataFrame, budget: int, path: str, *order: str) -> int:
    """{budget, generated_count, rows} as one JSON file, a row a line in the given order. A file is one stream, so one task writes
    it, row by row; returns the number of rows."""
    n = rows.count()
    part = f"{path}.{uuid.uuid4().hex}.part"

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = places.open_place(part)
        system.create_dir(place.rpartition("/")[0] or ".", recursive=True)
        done = 0
        with system.open_output_stream(place) as out:
            out.write(f'{{\n  "budget": {json.dumps(budget)},\n  "generated_count": {n},\n  "rows": ['.encode())
            for pdf in parts:
                for record in pdf["record"]:
                    out.write((",\n    " if done else "\n    ").encode() + record.encode())
                    done += 1
            out.write(b"\n  ]\n}\n")
        yield pd.DataFrame({"n": [done]})

    one = rows.coalesce(1).sortWithinPartitions(*order) if order else rows.coalesce(1)
    try:
        written = one.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")).mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
        if written != n:
            raise RuntimeError(f"{written} of {n} manifest rows were written")
    except Exception:
        places.remove(part)
        raise
    if n:
        places.rename(part, path)
    else:
        places.write_text(path, json.dumps({"budget": budget, "generated_count": 0, "rows": []}, indent=2) + "\n")
    return n
