"""Settings of a study: defaults for every key, what a file says in their place, paths made absolute."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import date
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Windows:
    """Inclusive offsets in trading rows."""

    estimation: tuple[int, int] = (-120, -20)
    pre_event: tuple[int, int] = (-5, -1)
    terminal: tuple[int, int] = (-2, -1)
    announcement: tuple[int, int] = (0, 1)


@dataclass(frozen=True)
class Paths:
    raw: str = "data/raw"
    processed: str = "data/processed"
    cache: str = "data/cache"
    reports: str = "outputs/reports"


@dataclass(frozen=True)
class Case:
    case_id: str = ""
    source_symbol: str = ""
    focal_symbol: str = ""
    event_date: date | None = None
    top_k: int = 10
    contracts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    paths: Paths = field(default_factory=Paths)
    windows: Windows = field(default_factory=Windows)
    case: Case = field(default_factory=Case)
    first_date: date | None = None
    last_date: date | None = None


def text(value: Any) -> str | None:
    """A trimmed text; null for a blank."""
    out = "" if value is None else str(value).strip()
    return out or None


def symbol(value: Any) -> str:
    """A symbol in its one notation; blank for null."""
    return (text(value) or "").upper().replace("/", ".").replace("-", ".")


def option_type(value: Any) -> str:
    """C or P; a ``ValueError`` for what is neither."""
    code = {"CALL": "C", "PUT": "P"}.get((text(value) or "").upper(), (text(value) or "").upper())
    if code not in ("C", "P"):
        raise ValueError(f"no option type: {value!r}")
    return code


def day(value: Any) -> date | None:
    """A date of an ISO text or a date; null for a blank."""
    return value if isinstance(value, date) or value is None else date.fromisoformat(text(value)) if text(value) else None


def span(value: Any) -> tuple[int, int]:
    """Two whole numbers in order; else a ``ValueError``."""
    a, b = (int(x) for x in value) if len(value) == 2 else (1, 0)
    if a > b:
        raise ValueError(f"no span: {value!r}")
    return a, b


def series_id(underlying: str, root: str, expiration: date, strike: float, kind: str) -> str:
    """The series key as option frames make it."""
    return "|".join((symbol(underlying), symbol(root), expiration.isoformat(), str(round(float(strike), 4)), option_type(kind)))


def _only(known: type, given: dict[str, Any]) -> dict[str, Any]:
    names = {f.name for f in fields(known)}
    if unknown := sorted(set(given) - names):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return given


def from_dict(given: dict[str, Any], root: str = ".") -> Settings:
    """Settings with the given values in place of defaults; relative paths start at ``root``. Unknown keys are a ``ValueError``."""
    _only(Settings, given)
    paths = replace(Paths(), **_only(Paths, given.get("paths", {})))
    local = lambda p: p if "://" in p or p.startswith("/") else str(Path(root, p).resolve())
    case = dict(_only(Case, given.get("case", {})))
    for k, f in (("source_symbol", symbol), ("focal_symbol", symbol), ("event_date", day), ("contracts", tuple)):
        if k in case:
            case[k] = f(case[k])
    return Settings(
        paths=Paths(**{k: local(v) for k, v in asdict(paths).items()}),
        windows=replace(Windows(), **{k: span(v) for k, v in _only(Windows, given.get("windows", {})).items()}),
        case=replace(Case(), **case), first_date=day(given.get("first_date")), last_date=day(given.get("last_date")),
    )


def load(path: str, root: str | None = None) -> Settings:
    """Settings of a JSON file, or of a YAML file where a reader for it is installed; paths start at its folder."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        given = yaml.safe_load(raw) or {}
    else:
        given = json.loads(raw)
    return from_dict(given, root or str(Path(path).parent))
