"""Long literal lists as one SQL expression instead of one Column object per entry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> str:
    return ", ".join(string(v) for v in values)


def string_array(values: Iterable[str]) -> str:
    return f"array({strings(values)})"


def string_map(table: Mapping[str, str]) -> str:
    return f"map({strings(x for kv in table.items() for x in kv)})"


def double_array(values: Iterable[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"
