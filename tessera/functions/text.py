"""String functions of metadata: tags, file names, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_tag(x: Column) -> Column:
    """A model type as written in a tag file: lower case, without quotes and outer spaces."""
    return F.trim(F.lower(F.regexp_replace(x, "[\"']", "")))


def without_number(x: Column) -> Column:
    """A file name without a numeric prefix like ``12_``."""
    return F.regexp_replace(x, r"^\d+_(.+)$", "$1")


def elapsed(seconds: Column) -> Column:
    """hh:mm:ss; hours beyond 99 take more digits."""
    s = seconds.cast("long")
    two = lambda v: F.when(v < 100, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def number(x: float | int, digits: int = 4, small: float = 1e-3) -> str:
    """An integer as it is; a float with ``digits`` decimals, or in powers of ten, without idle zeros, where it is
    smaller than ``small`` and not zero."""
    if isinstance(x, int):
        return str(x)
    if x == 0 or not abs(x) < small:
        return f"{x:.{digits}f}"
    head, _, power = f"{x:.{digits}e}".partition("e")
    return f"{head.rstrip('0').rstrip('.')}e{power[0]}{int(power[1:])}"


def numbers(value, digits: int = 5):
    """The floats of nested dicts, lists and tuples as text with ``digits`` decimals."""
    if isinstance(value, float):
        return f"{value:.{digits}f}"
    if isinstance(value, dict):
        return {k: numbers(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(numbers(v, digits) for v in value)
    return value


def _table(rows: list[list[str]]) -> list[str]:
    """Rows in columns, the first of them a header."""
    wide = [max(map(len, column)) for column in zip(*rows, strict=True)]
    lines = ["  ".join(x.ljust(w) for x, w in zip(row, wide, strict=True)).rstrip() for row in rows]
    return [lines[0], "  ".join("-" * w for w in wide), *lines[1:]]


def report(metrics: dict, title: str = "Metrics") -> str:
    """Nested metrics as text: overall ones by name, then a table of strata and averages, metrics by name."""
    if not metrics:
        return f"{title}: no metrics"
    lines = [title, "=" * len(title)]
    overall = sorted(k for k, v in metrics.items() if not isinstance(v, dict))
    nested = [k for k, v in metrics.items() if isinstance(v, dict)]
    if overall:
        lines += ["", *_table([["Metric", "Value"], *[[k, number(metrics[k])] for k in overall]])]
    if nested:
        names = sorted({m for k in nested for m in metrics[k]})
        lines += ["", *_table([["", *names], *[[k, *[number(metrics[k][m]) if m in metrics[k] else "nan" for m in names]] for k in nested]])]
    return "\n".join(lines) + "\n"


def one_line(metrics: dict) -> str:
    """Nested metrics in one line, by path."""
    flat = lambda d, at: [x for k, v in d.items() for x in (flat(v, f"{at}{k}/") if isinstance(v, dict) else [f"{at}{k}: {number(v)}"])]
    return ", ".join(flat(metrics, ""))


def printed(x: Column, digits: int = 4, small: float = 1e-3) -> Column:
    """``number`` for a column of doubles."""
    power = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}e", x), r"\.?0*e", "e"), r"e([+-])0*(\d)", "e$1$2")
    return F.when(F.isnan(x), "nan").when((x != 0) & (F.abs(x) < small), power).otherwise(F.format_string(f"%.{digits}f", x))
