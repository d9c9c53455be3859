"""Small helpers of several operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from floorwise.sources.scratch import Written, discard, scratch_path, scratch_root, tidy  # noqa: F401


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shielded(df: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but the needed ones under names that nothing else takes, and the
    way back to its own columns."""
    names = {c: c if c.lower() in {n.lower() for n in needed} else f"_shielded_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), lambda out: out.select(*(out[n].alias(c) for c, n in names.items()))


def slices(texts: list, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` of text each, so that long rows bound a batch."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text is not None else 0
        if size >= most_bytes:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
