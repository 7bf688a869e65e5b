"""Settings of a case from a file, and guards of paths. Read on the driver; declared files join as a small frame."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

#: Declared files at most: they are sent to every executor.
MAX_DECLARED = 100_000


class ConfigError(ValueError):
    """A setting that isn't valid."""


@dataclass(frozen=True)
class Declared:
    path: str
    type: str | None = None
    author: str | None = None
    created_date: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class CaseConfig:
    case_number: str
    case_folder: str
    title: str | None = None
    description: str | None = None
    max_file_bytes: int = 2 << 30
    files: tuple[Declared, ...] = ()


def resolve_within(base: str | Path, candidate: str | Path) -> Path:
    """The candidate's real path, links followed; an error where it lies outside the base."""
    root = Path(base).resolve()
    target = (root / candidate).resolve()
    if not target.is_relative_to(root):
        raise ConfigError(f"path leaves the case folder: {candidate}")
    return target


def external_path(path: str | Path) -> str:
    """A path that may be given to another program: an absolute one, which can't be taken for an option."""
    if not Path(path).is_absolute():
        raise ConfigError(f"another program needs an absolute path: {path}")
    return str(path)


def _declared(item: dict) -> Declared:
    path = str(item.get("path") or "")
    if not path or PurePosixPath(path).is_absolute() or ".." in PurePosixPath(path).parts:
        raise ConfigError(f"a declared path must lie in the case folder: {path!r}")
    known = {k: item.get(k) for k in ("type", "author", "created_date")}
    return Declared(PurePosixPath(path).as_posix(), *[None if v is None else str(v) for v in known.values()], {k: str(v) for k, v in item.items() if k not in ("path", *known)})


def load_config(path: str | Path) -> CaseConfig:
    """The settings of a JSON file, or of a YAML file where a library reads one. Unknown keys are errors, but for those of declared files."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("no library reads YAML here; use JSON") from e
        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ConfigError("settings must be a mapping")
    unknown = sorted(set(raw) - {f.name for f in fields(CaseConfig)})
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    for need in ("case_number", "case_folder"):
        if not raw.get(need):
            raise ConfigError(f"{need} is missing")
    return CaseConfig(**{**raw, "files": tuple(_declared(i) for i in raw.get("files") or ())})


def jdbc_options(url: str, user: str, password_from: str = "LEDGERLENS_DB_PASSWORD") -> dict[str, str]:
    """Options of a table in a database; the password comes from the environment alone."""
    password = os.environ.get(password_from)
    if password is None:
        raise ConfigError(f"set {password_from}")
    return {"url": url, "user": user, "password": password}


def safe_url(options: dict[str, str]) -> str:
    """What may be shown of a connection."""
    return f"{options['user']}@{options['url']}"


def declared_files(spark: SparkSession, config: CaseConfig) -> DataFrame:
    """(relative_path, declared_type, author, created_date, extra) of at most MAX_DECLARED files."""
    if len(config.files) > MAX_DECLARED:
        raise ConfigError(f"more than {MAX_DECLARED} declared files")
    rows = [(d.path, d.type, d.author, d.created_date, d.extra) for d in config.files]
    return spark.createDataFrame(rows, "relative_path string, declared_type string, author string, created_date string, extra map<string,string>")
