"""Files through an external converter, one process for each file, where the file's task runs.

This reads formats that only a program of their own can read (DWG to DXF, SVG to PNG). The
program has to be installed on the executors. A run that fails, takes too long or leaves an
empty file is a row with its error; it stops no other file.
"""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT = 300
_SCHEMA = pa.schema([("file_id", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def convert(content: bytes, command: list[str], suffix: str, made: str, timeout: float = TIMEOUT) -> tuple[bytes | None, str | None]:
    """The converted bytes or an error; ``{input}`` and ``{output}`` in the command become paths."""
    with tempfile.TemporaryDirectory() as folder:
        source, target = Path(folder, f"in.{suffix}"), Path(folder, f"out.{made}")
        source.write_bytes(content)
        filled = [part.replace("{input}", str(source)).replace("{output}", str(target)) for part in command]
        try:
            done = subprocess.run(filled, capture_output=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            return None, f"the converter took more than {timeout:g} seconds"
        except OSError as error:
            return None, str(error)
        if done.returncode:
            return None, f"the converter ended with {done.returncode}: {done.stderr.decode(errors='replace')[-500:]}"
        found = target.read_bytes() if target.exists() else b""
        return (found, None) if found else (None, "the converter left no output")


def converted(files: DataFrame, command: list[str], suffix: str, made: str, timeout: float = TIMEOUT) -> DataFrame:
    """(file_id, content, error) of files given as (file_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, error = convert(content, command, suffix, made, timeout)
                yield pa.RecordBatch.from_pylist([{"file_id": file_id, "content": found, "error": error}], schema=_SCHEMA)

    return files.select("file_id", F.col("content").cast("binary")).mapInArrow(run, "file_id string, content binary, error string")
