"""External programs as row functions: records of a partition go to a process, its output becomes rows.

A program is a contract, not a dependency: what it reads and writes is text, its output is parsed by a
reader's schema, and a failing program fails its task, which Spark tries again elsewhere.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Program:
    """A command, how a batch becomes its input, and how its output becomes rows."""

    command: tuple[str, ...]
    to_input: Callable[[pd.DataFrame], str]
    from_output: Callable[[str], pd.DataFrame]
    schema: str
    seconds: int = 3600


def piped(records: DataFrame, program: Program, batch_rows: int = 1000) -> DataFrame:
    """The program's rows over all records, at most ``batch_rows`` records a process."""

    def run(batches: Iterable[pd.DataFrame]):
        if shutil.which(program.command[0]) is None:
            raise FileNotFoundError(f"{program.command[0]} is not installed on this executor")
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                text = program.to_input(batch.iloc[at : at + batch_rows])
                done = subprocess.run(program.command, input=text, capture_output=True, text=True, timeout=program.seconds, check=True)
                yield program.from_output(done.stdout)

    return records.mapInPandas(run, program.schema)


def mapped(records: DataFrame, function: Callable, schema: str, *args) -> DataFrame:
    """A plain function over rows in parallel: it takes a row (a named tuple) and more arguments, and returns a tuple or None."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            out = [r for r in (function(row, *args) for row in batch.itertuples(index=False)) if r is not None]
            yield pd.DataFrame(out, columns=names)

    return records.mapInPandas(run, schema)
