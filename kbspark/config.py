"""Bundle options, read from TOML on the driver. Precedence: overrides, bundle, defaults."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

CONFIG_NAME = "bundles.toml"
#: The newest format version that may be written.
NEWEST = (0, 2)


class ConfigError(ValueError):
    """The configuration can't be used."""


class VersionError(ValueError):
    """A declared format version that isn't understood."""


def parse_version(text: str) -> tuple[int, int]:
    # Fixed value: how a version is written.
    m = re.fullmatch(r"(0|[1-9]\d*)\.(0|[1-9]\d*)", text) if isinstance(text, str) else None
    if not m:
        raise VersionError(f"Invalid version: {text!r}")
    return int(m[1]), int(m[2])


def is_supported(text: str) -> bool:
    return parse_version(text) <= NEWEST


@dataclass(frozen=True)
class Taxonomy:
    allowed_types: tuple[str, ...] = ()
    known_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class TypeFields:
    required: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    required: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    taxonomy: Taxonomy = Taxonomy()
    types: dict[str, TypeFields] = field(default_factory=dict)


@dataclass(frozen=True)
class Bundle:
    """One collection of Markdown documents."""

    name: str
    root: str
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ()
    reserved: tuple[str, ...] = ("index.md", "log.md")
    listing_fields: tuple[str, ...] = ()
    version: str | None = None
    #: The frontmatter key of a root index in which a bundle declares its format version.
    version_key: str = "format_version"
    profile: Profile | None = None
    taxonomy: Taxonomy = Taxonomy()
    directory_file: str = "_directory.yml"
    cache_dir: str | None = None
    stable_id_field: str | None = None

    def __post_init__(self) -> None:
        if self.version is not None and not is_supported(self.version):
            raise ConfigError(f"bundle {self.name!r}: version {self.version!r} is newer than {NEWEST[0]}.{NEWEST[1]}")
        if "/" in self.directory_file or not self.directory_file:
            raise ConfigError("directory_file must be a bare file name")
        if self.stable_id_field is not None and not self.stable_id_field.strip():
            raise ConfigError("stable_id_field must not be blank")


def discover(start: str | os.PathLike = ".") -> Path | None:
    """The nearest configuration file in a folder or those above."""
    here = Path(start).resolve()
    return next((p / CONFIG_NAME for p in (here, *here.parents) if (p / CONFIG_NAME).is_file()), None)


def _built(kind: type, values: dict[str, Any], where: str):
    known = {f.name for f in fields(kind)}
    if extra := set(values) - known:
        raise ConfigError(f"{where}: unknown option {sorted(extra)[0]!r}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def _profile(values: dict[str, Any], where: str) -> Profile:
    values = dict(values)
    taxonomy = _built(Taxonomy, values.pop("taxonomy", {}), where)
    types = {k: _built(TypeFields, v, f"{where}.{k}") for k, v in values.pop("types", {}).items()}
    return replace(_built(Profile, values, where), taxonomy=taxonomy, types=types)


def load(path: str | os.PathLike | None = None, overrides: dict[str, Any] | None = None) -> dict[str, Bundle]:
    """The bundles of a configuration file by name. Relative roots count from the file's folder."""
    path = Path(path) if path else discover()
    if path is None or not path.is_file():
        raise ConfigError(f"no configuration file: {path or CONFIG_NAME}")
    try:
        data = tomllib.loads(path.read_text("utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if extra := set(data) - {"defaults", "bundles", "profiles"}:
        raise ConfigError(f"{path}: unknown table {sorted(extra)[0]!r}")
    profiles = {k: _profile(v, f"profiles.{k}") for k, v in data.get("profiles", {}).items()}
    out = {}
    for name, own in data.get("bundles", {}).items():
        values = {**data.get("defaults", {}), **own, **(overrides or {})}
        if "root" not in values:
            raise ConfigError(f"bundles.{name}: root is missing")
        if "taxonomy" in values:
            values["taxonomy"] = _built(Taxonomy, values["taxonomy"], f"bundles.{name}.taxonomy")
        if (wanted := values.pop("profile", None)) is not None:
            if wanted not in profiles:
                raise ConfigError(f"bundles.{name}: unknown profile {wanted!r}")
            values["profile"] = profiles[wanted]
        for key in ("root", "cache_dir"):
            if values.get(key) and "://" not in values[key]:
                values[key] = str((path.parent / values[key]).resolve())
        out[name] = _built(Bundle, {"name": name, **values}, f"bundles.{name}")
    return out
