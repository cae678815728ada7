"""Ordered INI files with bare keys, read on the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def parse_config(text: str, allow_bare: bool = True) -> dict[str, list[tuple[str, str | None]]]:
    """Sections with their (key, value) pairs in order; a key's value begins after its first ``:`` or ``=``.

    Lines that begin with ``#`` or ``;`` are comments. Bare keys have no value; where they aren't allowed,
    and before the first section, a line is an error.
    """
    out: dict[str, list[tuple[str, str | None]]] = {}
    section: list[tuple[str, str | None]] | None = None
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        if m := re.fullmatch(r"\[(.*)\]", line):
            section = out.setdefault(m[1], [])
            continue
        if section is None:
            raise ValueError(f"line {number} stands before the first section")
        key, mark, value = re.fullmatch(r"([^:=]*)([:=]?)(.*)", line).groups()
        if not mark and not allow_bare:
            raise ValueError(f"line {number} has no value")
        section.append((key.strip(), value.strip() if mark else None))
    return out


def read_config(path: str, allow_bare: bool = True) -> dict[str, list[tuple[str, str | None]]]:
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read(), allow_bare)


def config_table(spark: SparkSession, config: Mapping[str, Sequence[tuple[str, str | None]]]) -> DataFrame:
    rows = [(s, k, key, value) for s, pairs in config.items() for k, (key, value) in enumerate(pairs)]
    return spark.createDataFrame(rows, "section string, ord int, key string, value string")


def taxa_of(config: Mapping[str, Sequence[tuple[str, str | None]]], group: str, excludes: str = "Excludes") -> list[str]:
    """A group's taxa without excluded ones, in order, hyphens as underscores."""
    if group not in config:
        raise KeyError(f"no group {group}")
    out = {k.replace("-", "_") for k, _ in config.get(excludes, ())}
    return [t for t in (k.replace("-", "_") for k, _ in config[group]) if t not in out]


def parse_partitions(text: str, length: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """``DNA, name = 1-3, 8-9`` lines as ranges from 1; ranges outside the length are an error."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        m = re.fullmatch(r"[^,]*,\s*(\S+)\s*=\s*(.+)", line)
        if not m:
            raise ValueError(f"no partition: {line}")
        ranges = []
        for part in m[2].split(","):
            a, _, b = part.strip().partition("-")
            first, last = int(a), int(b or a)
            if not 1 <= first <= last <= length:
                raise ValueError(f"range {part.strip()} is outside 1-{length}")
            ranges.append((first, last))
        out.append((m[1], ranges))
    return out


def resolve(value: str, places: Mapping[str, str]) -> str:
    """A path with ``$NAME`` placeholders and ``~`` resolved."""
    return os.path.expanduser(re.sub(r"\$([A-Z]+)", lambda m: places.get(m[1], m[0]), value))
