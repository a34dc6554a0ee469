"""What a collection's configuration declares, compiled to schemas, prompts and columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.functions.text import flag_label
from gristmill.operators.flags import regex_flags
from gristmill.operators.gates import GateLimits
from gristmill.operators.infer import COSIGNERS, ENTITY, POLITICAL, STATE, known_or, only_known


#: what the second pass works on beside the fields that a collection declares
CHECKED = {"stances": "array<string>", "verified_stance": "string", "verification_reasoning": "string"}
for _v in (ENTITY, STATE, POLITICAL):
    CHECKED |= {n: "string" for n in (_v.value, _v.quote, _v.verified, _v.reasoning) if n}
CHECKED |= COSIGNERS


@dataclass(frozen=True)
class FieldSpec:
    """A field of the analysis: ``multi_enum``, ``single_enum``, ``enum_or_empty``, ``text``, or a regex dimension."""

    name: str
    type: str = "text"
    options: tuple[str, ...] = ()
    default: str = ""
    description: str = ""
    source: str = "model"
    pattern: str = ""
    label: str = ""


@dataclass(frozen=True)
class Config:
    fields: tuple[FieldSpec, ...] = ()
    regex_flags: dict[str, list[str]] = field(default_factory=dict)
    flag_labels: dict[str, str] = field(default_factory=dict)
    derived_flags: dict[str, dict[str, Any]] = field(default_factory=dict)
    campaigns: dict[str, Any] = field(default_factory=dict)
    gate: GateLimits = GateLimits()

    def schema(self) -> StructType:
        """The analysis record: the declared fields, and from the start all that a second pass reads and adds."""
        own = {f.name: "array<string>" if f.type == "multi_enum" else "string" for f in self.fields if f.source == "model"}
        return StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in (own | {n: t for n, t in CHECKED.items() if n not in own}).items()))

    def repaired(self, analysis: Column) -> Column:
        """The record with values outside the declared options taken out; what a second pass has added stays."""
        own, out = {f.name for f in self.fields if f.source == "model"}, []
        for f in self.fields:
            if f.source == "model":
                c = analysis[f.name]
                c = only_known(c, list(f.options)) if f.type == "multi_enum" else known_or(c, list(f.options), f.default) if f.type in ("single_enum", "enum_or_empty") else F.coalesce(c, F.lit(""))
                out.append(c.alias(f.name))
        out += [analysis[n].alias(n) for n in CHECKED if n not in own]
        return F.when(analysis.isNotNull(), F.struct(*out))

    def prompt(self) -> str:
        """Instructions for a model, from the declaration."""
        lines = ["Read the comment and fill in these fields."]
        for f in self.fields:
            if f.source == "model":
                lines.append(f"- {f.name}: {f.description or f.label or f.name}")
                lines += [f"    * {o}" for o in f.options]
        return "\n".join(lines)

    def flags(self, text: Column) -> list[Column]:
        return regex_flags(text, self.regex_flags)

    def label(self, flag: str) -> str:
        return flag_label(flag, self.flag_labels.get(flag))


def _resolved(declared: dict[str, Any], raw: dict[str, Any]) -> dict[str, Any]:
    """A field with its options, which may be those that the configuration declares elsewhere."""
    named = {"stances": [s["name"] for s in raw.get("stances") or []], "entity_types": list(raw.get("entity_types") or [])}
    source = declared.get("options_from")
    return {k: v for k, v in declared.items() if k != "options_from"} | ({"options": named[source]} if source in named else {})


def parse(raw: dict[str, Any]) -> Config:
    declared = raw.get("fields") or {}
    if isinstance(declared, list):  # records with a name
        declared = {d["name"]: d for d in declared}
    raw = raw | {"fields": {n: _resolved(d or {}, raw) for n, d in declared.items()}}
    fields = tuple(FieldSpec(name=n, **{k: tuple(v) if k == "options" else v for k, v in (d or {}).items() if k in FieldSpec.__dataclass_fields__ and k != "name"}) for n, d in (raw.get("fields") or {}).items())
    flags = {k: v for k, v in (raw.get("regex_flags") or {}).items() if isinstance(v, dict)}
    gate = {k: v for k, v in (raw.get("quality_gate") or {}).items() if k in GateLimits.__dataclass_fields__}
    return Config(fields, {k: list(v.get("patterns", [])) for k, v in flags.items()}, {k: v["label"] for k, v in flags.items() if v.get("label")}, raw.get("derived_flags") or {}, raw.get("campaigns") or {}, GateLimits(**gate))


def load(folder: str | Path, name: str = "config") -> Config:
    """YAML where there is one, else JSON, else nothing declared."""
    base = Path(folder)
    for suffix in (".yaml", ".yml"):
        if (p := base / f"{name}{suffix}").exists():
            import yaml

            return parse(yaml.safe_load(p.read_text()) or {})
    p = base / f"{name}.json"
    return parse(json.loads(p.read_text())) if p.exists() else Config()
