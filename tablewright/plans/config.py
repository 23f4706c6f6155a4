"""Configuration from YAML and from flags."""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass, fields, replace

from ..functions.canonical import Options
from ..operators.diff import Spec
from .schema import PlanError

PLACEHOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


@dataclass(frozen=True)
class Config:
    """All options with their defaults; lists are comma-separated in flags."""

    src: str = ""
    dst: str = ""
    src_host: str = ""
    dst_host: str = ""
    src_port: int = 0
    dst_port: int = 0
    src_user: str = ""
    dst_user: str = ""
    src_password_env: str = ""
    dst_password_env: str = ""
    src_db: str = ""
    dst_db: str = ""
    tables: tuple[str, ...] = ()
    exclude_tables: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    where: str = ""
    ignore_columns: tuple[str, ...] = ()
    parallel: int = 4
    chunk_size: int = 10_000
    drill: bool = False
    drill_limit: int = 10
    tolerance: float = 0.0
    snapshot: bool = False
    no_trim: bool = False
    fold_case: bool = False
    normalize_json: bool = False
    allow_tz_swap: bool = False
    strict_types: bool = False
    secure: bool = False
    json: bool = False
    batch_size: int = 1000
    sample_limit: int = 5
    apply: bool = False
    yes: bool = False
    no_sync_schema: bool = False
    allow_structure_truncate: bool = False
    allow_row_rewrite: bool = False

    def check(self) -> Config:
        for name in ("parallel", "chunk_size", "batch_size"):
            if getattr(self, name) <= 0:
                raise PlanError(f"{name} must be positive", argument=True)
        if self.chunk_size < 10:
            raise PlanError("chunk_size must be 10 at least", argument=True)
        for name in ("drill_limit", "sample_limit"):
            if getattr(self, name) < 0:
                raise PlanError(f"{name} must not be negative", argument=True)
        if not (math.isfinite(self.tolerance) and self.tolerance >= 0):
            raise PlanError("tolerance must be 0 or a finite positive number", argument=True)
        return self

    def place(self, side: str) -> str | Address:
        """Where a side is: a folder or a JDBC URL as it stands, or the address of a database. A whole address wins
        over its parts."""
        whole, variable = getattr(self, side), getattr(self, f"{side}_password_env")
        if whole.startswith("jdbc:") or whole and "@" not in whole or "://" in whole:
            return whole
        if whole:
            return parse_address(whole, password_variable=variable)
        host, port, user, database = (getattr(self, f"{side}_{part}") for part in ("host", "port", "user", "db"))
        if not (host and user and database):
            raise PlanError("src and dst are needed", argument=True)
        return Address(host, port or 3306, user, os.environ.get(variable, ""), database)

    @property
    def spec(self) -> Spec:
        options = Options(self.tolerance, not self.no_trim, self.fold_case, self.normalize_json, self.allow_tz_swap)
        return Spec(self.key, self.where, self.ignore_columns, self.chunk_size, self.drill, self.drill_limit, self.strict_types, self.secure, options=options)


def _kinds() -> dict[str, type]:
    return {f.name: type(f.default) for f in fields(Config)}


def _typed(name: str, value: object) -> object:
    kind = _kinds()[name]
    if kind is tuple:
        listed = value if isinstance(value, (list, tuple)) else str(value).split(",")
        return tuple(str(v).strip() for v in listed if str(v).strip())
    if kind is bool:
        if isinstance(value, str) and value.lower() in ("true", "false"):
            return value.lower() == "true"
        if not isinstance(value, bool):
            raise PlanError(f"{name} must be true or false", argument=True)
        return value
    try:
        return kind(value)
    except (TypeError, ValueError):
        raise PlanError(f"{name}: {value!r} is not a {kind.__name__}", argument=True) from None


def expand(value: object, environment: dict[str, str]) -> object:
    """``${NAME}`` in texts, after parsing, so that values can't change the document's structure."""
    if isinstance(value, dict):
        return {k: expand(v, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, environment) for v in value]
    if not isinstance(value, str):
        return value

    def fill(found: re.Match) -> str:
        if found[1] not in environment:
            raise PlanError(f"environment variable {found[1]} is not set", argument=True)
        return environment[found[1]]

    return PLACEHOLDER.sub(fill, value)


def from_yaml(text: str, environment: dict[str, str] | None = None) -> Config:
    """One document with known fields only."""
    import yaml

    documents = list(yaml.safe_load_all(text))
    if len(documents) > 1:
        raise PlanError("the configuration must be one document", argument=True)
    found = expand(documents[0] or {}, dict(os.environ) if environment is None else environment)
    if not isinstance(found, dict):
        raise PlanError("the configuration must be a mapping", argument=True)
    named = {k.replace("-", "_"): v for k, v in found.items()}
    unknown = sorted(set(named) - set(_kinds()))
    if unknown:
        raise PlanError(f"unknown field {unknown[0]}", argument=True)
    return Config(**{k: _typed(k, v) for k, v in named.items()}).check()


def overlay(config: Config, given: dict[str, object]) -> Config:
    """Flags over a configuration; only flags that were given count, and a given 0 is a 0."""
    return replace(config, **{k: _typed(k, v) for k, v in given.items() if v is not None}).check()


def masked(address: str) -> str:
    """A connection address without its password."""
    return re.sub(r"(//[^:/@\s]*:)[^@\s]*@", r"\1***@", address)


@dataclass(frozen=True)
class Address:
    """A database endpoint, for JDBC sides."""

    host: str
    port: int
    user: str
    password: str
    database: str

    @property
    def url(self) -> str:
        return f"jdbc:mysql://{self.host}:{self.port}/{self.database}"

    def options(self) -> dict[str, str]:
        return {"user": self.user, "password": self.password}


def parse_address(text: str, password: str | None = None, environment: dict[str, str] | None = None, password_variable: str = "") -> Address:
    """``user[:password]@host[:port]/database``. A password given by itself wins over one in an environment
    variable, and that over one in the text; passwords may hold any character, as the last @ ends them."""
    before, at, after = text.rpartition("@")
    place, slash, database = after.partition("/")
    if not at or not slash or not database:
        raise PlanError("an address is user[:password]@host[:port]/database", argument=True)
    user, _, inline = before.partition(":")
    if place.startswith("["):
        host, _, rest = place[1:].partition("]")
        port = rest.removeprefix(":")
    else:
        host, _, port = place.partition(":")
    if not host or port and not port.isdigit():
        raise PlanError(f"not a host and port: {place}", argument=True)
    held = (os.environ if environment is None else environment).get(password_variable) if password_variable else None
    return Address(host, int(port or 3306), user, next(p for p in (password, held, inline) if p is not None), database)
