"""Configuration of a transformation: closed, frozen and checked when it is made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from quayside.functions.converters import REGISTRY, Context
from quayside.plans.contract import CONTRACT


@dataclass(frozen=True)
class ValueMap:
    words: dict[str, str]
    unmapped: str = "error"
    rule: int | None = None

    def __post_init__(self):
        if self.unmapped not in ("error", "default", "null"):
            raise ValueError(f"unmapped must be error, default or null, not {self.unmapped!r}")
        for k, v in self.words.items():
            if not isinstance(k, str) or not isinstance(v, str):
                raise ValueError(f"{k!r}: {v!r} must both be text; quote words that YAML reads as yes, no, on or off")


@dataclass(frozen=True)
class Config:
    as_of: str
    date_formats: tuple[str, ...] = ("%Y-%m-%d",)
    datetime_formats: tuple[str, ...] = ("%Y-%m-%dT%H:%M:%S%z",)
    placeholders: tuple[str, ...] = ()
    value_maps: dict[str, ValueMap] = field(default_factory=dict)
    overrides: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        for target, chain in self.overrides.items():
            for name in chain:
                if name not in REGISTRY:
                    raise ValueError(f"{target}: unknown converter {name!r}")

    def context(self, target: str) -> Context:
        own = self.value_maps.get(target)
        spec = CONTRACT.get(target)
        return Context(target, tuple(spec.enum) if spec else (), own.words if own else None, own.rule if own else None, own.unmapped if own else "error", self.date_formats, self.datetime_formats, self.placeholders)

    def chain(self, target: str) -> tuple[str, ...]:
        """trim and blank_to_null, then an override, or what the target's type asks for."""
        spec = CONTRACT[target]
        by_type = {"enum": "enum_map", "decimal": "money", "integer": "integer", "boolean": "boolean", "date": "date", "datetime": "datetime", "email": "email", "url": "url", "list": "string_list", "identifier": "identifier"}
        return ("trim", "blank_to_null", *self.overrides.get(target, (by_type.get(spec.kind, "string"),)))


def config_from(raw: dict[str, Any]) -> Config:
    """From plain data, such as a YAML file; unknown keys are refused."""
    known = {f.name for f in fields(Config)}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    out = dict(raw)
    out["value_maps"] = {k: v if isinstance(v, ValueMap) else ValueMap(v.get("map", {}), v.get("unmapped", "error"), v.get("rule")) for k, v in raw.get("value_maps", {}).items()}
    for name in ("date_formats", "datetime_formats", "placeholders"):
        if name in out:
            out[name] = tuple(out[name])
    out["overrides"] = {k: tuple(v) for k, v in raw.get("overrides", {}).items()}
    return Config(**out)
