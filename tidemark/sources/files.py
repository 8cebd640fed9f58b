"""Files and folders of whatever file system a path names, by way of Hadoop's; small texts and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.exists(p))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none where it isn't there. Hidden ones are left out."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return sorted(n for n in found if not n.startswith(("_", ".")))


def files(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """All files below a folder whose names end in ``suffix``, as full paths, sorted; none where it isn't there."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return []
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next().getPath()
        if f.getName().lower().endswith(suffix.lower()):
            out.append(f.toString())
    return sorted(out)


def ensure_folders(spark: SparkSession, *paths: str) -> None:
    """Makes the folders that aren't there."""
    for path in paths:
        p, fs = _at(spark, path)
        fs.mkdirs(p)


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    """``FileExistsError`` if any of the paths is there."""
    for p in paths:
        if exists(spark, p):
            raise FileExistsError(p)


def require_existing(spark: SparkSession, *paths: str) -> None:
    """``FileNotFoundError`` if any of the paths isn't there."""
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text, in UTF-8, in the place of whatever is there."""
    p, fs = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_report(spark: SparkSession, path: str, payload: object) -> None:
    """JSON with sorted keys, indented, with a newline at its end."""
    write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")


def number(value: float | None, digits: int = 4) -> str:
    """A number of fixed digits as reports show it; ``n/a`` for none."""
    return "n/a" if value is None or value != value else f"{value:.{digits}f}"


def percent(value: float | None) -> str:
    """A share in percent; ``n/a`` for none."""
    return "n/a" if value is None or value != value else f"{100 * value:.1f}%"


def thousands(value: float | None) -> str:
    """A count with commas; ``n/a`` for none."""
    return "n/a" if value is None or value != value else f"{int(value):,}"


def markdown_report(title: str, facts: Iterable[tuple[str, object]], tables: Iterable[tuple[str, str]] = ()) -> str:
    """A report: a title, a list of facts, and tables (as ``markdown_table`` gives them) under their headings."""
    lines = [f"# {title}", "", *(f"- {k}: {'n/a' if v is None else v}" for k, v in facts), ""]
    for heading, text in tables:
        lines += [f"## {heading}", "", text]
    return "\n".join(lines).rstrip("\n") + "\n"
