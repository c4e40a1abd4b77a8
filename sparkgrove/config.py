"""Configuration in TOML: tables [server], [indexer], [cache] and a list of [[repos]]."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields


SCHEMES = ("https://", "http://", "git://", "ssh://")


class ConfigError(ValueError):
    """The configuration isn't valid."""


@dataclass
class Server:
    bind: str = "127.0.0.1:6080"
    timeout_secs: int = 30
    cors_origins: list[str] = field(default_factory=list)
    rate_limit_rps: int = 0
    max_request_bytes: int = 1 << 20
    max_search_results: int = 10_000


@dataclass
class Indexer:
    data_dir: str = "data"
    max_concurrent_indexers: int = 4
    poll_interval_secs: int = 60
    max_file_size: int = 1 << 20
    exclude_patterns: list[str] = field(default_factory=list)
    index_timeout_secs: int = 300


@dataclass
class Cache:
    max_entries: int = 1000
    ttl_secs: int = 300


@dataclass
class Repo:
    name: str = ""
    url: str = ""
    ref: str | None = None
    auth_token: str | None = None
    ssh_key: str | None = None
    ssh_key_path: str | None = None
    ssh_key_passphrase: str | None = None

    def __repr__(self) -> str:
        return f"Repo(name={self.name!r}, url={self.url!r}, ref={self.ref!r})"  # no secrets


@dataclass
class Config:
    server: Server = field(default_factory=Server)
    indexer: Indexer = field(default_factory=Indexer)
    cache: Cache = field(default_factory=Cache)
    repos: list[Repo] = field(default_factory=list)


def _made(kind: type, values: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ConfigError(f"unknown field {sorted(unknown)[0]} in {where}")
    return kind(**values)


def expand(value: str | None) -> str | None:
    """$NAME and ${NAME} from the environment; None where it isn't set."""
    if value is None or not (m := re.fullmatch(r"\$(?:\{(\w+)\}|(\w+))", value)):
        return value
    return os.environ.get(m[1] or m[2])


def parse(text: str) -> Config:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    if unknown := set(data) - {"server", "indexer", "cache", "repos"}:
        raise ConfigError(f"unknown table {sorted(unknown)[0]}")
    tables = {k: _made(c, data.get(k, {}), k) for k, c in (("server", Server), ("indexer", Indexer), ("cache", Cache))}
    config = Config(**tables, repos=[_made(Repo, r, "repos") for r in data.get("repos", [])])
    validate(config)
    for r in config.repos:
        for name in ("auth_token", "ssh_key", "ssh_key_path", "ssh_key_passphrase"):
            setattr(r, name, expand(getattr(r, name)))
    return config


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def validate(config: Config) -> None:
    for table, names in ((config.server, ("timeout_secs", "max_request_bytes")), (config.indexer, ("max_concurrent_indexers", "poll_interval_secs", "max_file_size")), (config.cache, ("max_entries",))):
        for name in names:
            if getattr(table, name) <= 0:
                raise ConfigError(f"{name} must be more than 0")
    if bad := [x for x in config.server.cors_origins if not x.startswith("http")]:
        raise ConfigError(f"bad origin {bad[0]!r}")
    seen = set()
    for r in config.repos:
        _check_repo(r)
        if r.name in seen:
            raise ConfigError(f"repo {r.name} is there twice")
        seen.add(r.name)


def is_scp_address(url: str) -> bool:
    """user@host:path"""
    return "@" in url and ":" in url and "://" not in url


def _check_repo(r: Repo) -> None:
    if not r.name or ".." in r.name or "\0" in r.name or r.name[0] in "/~":
        raise ConfigError(f"bad repo name {r.name!r}")
    if not is_scp_address(r.url) and not r.url.startswith(SCHEMES):
        raise ConfigError(f"bad url of repo {r.name}")
    if r.auth_token is not None and (is_scp_address(r.url) or r.url.startswith("ssh://")):
        raise ConfigError(f"repo {r.name} has a token, but its ssh address doesn't use one")
    if r.ref is not None and (".." in r.ref or not re.fullmatch(r"[A-Za-z0-9/_.-]+", r.ref)):
        raise ConfigError(f"bad ref of repo {r.name}")
