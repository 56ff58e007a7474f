"""Flow specifications: plain data, loadable from JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.operators.mapping import map_fields
from millrace.operators.template import expression_template

AFTER_READ, BEFORE_WRITE, AFTER_WRITE = "AFTER_READ", "BEFORE_WRITE", "AFTER_WRITE"
TEMPLATE, MAPPING = "TEMPLATE", "MAPPING"


class Strategy(Enum):
    FULL = "FULL"
    INCREMENTAL_TIME = "INCREMENTAL_TIME"
    INCREMENTAL_ID = "INCREMENTAL_ID"
    SYNCED_SET = "SYNCED_SET"

    @classmethod
    def parse(cls, name: str | None) -> Strategy:
        """Unknown or missing names mean FULL."""
        return cls.__members__.get(name or "", cls.FULL)


# Declared column types and the Spark types they stand for.
COLUMN_TYPES = {
    "string": T.StringType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "text": T.StringType(),
    "json": T.VariantType(),
    "blob": T.BinaryType(),
    "file": T.BinaryType(),
}


@dataclass(frozen=True)
class ColumnSpec:
    """One receive or push column: key, label, declared type, linked template."""

    key: str
    label: str = ""
    type: str = "string"
    template: str | None = None

    @staticmethod
    def parse(entry: Mapping[str, Any]) -> ColumnSpec:
        linked = entry.get("templateId")
        return ColumnSpec(entry["key"], entry.get("value") or "", entry.get("type") or "string",
                          None if linked is None else str(linked))


def column_schema(columns: Sequence[ColumnSpec]) -> T.StructType:
    """Declared columns as a Spark schema; the label goes into the field metadata."""
    return T.StructType([T.StructField(c.key, COLUMN_TYPES[c.type], True, {"label": c.label})
                         for c in columns])


@dataclass(frozen=True)
class Step:
    type: str
    ref: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def parse(entry: Mapping[str, Any]) -> Step:
        ref = entry.get("mappingTemplateId" if entry["type"] == MAPPING else "templateId")
        return Step(entry["type"], None if ref is None else str(ref), entry.get("params") or {})


@dataclass(frozen=True)
class Stage:
    position: str
    name: str = ""
    steps: tuple[Step, ...] = ()


@dataclass(frozen=True)
class FieldMapping:
    """Pairs ``(receive, push)`` and the columns whose values pass a column function first."""

    pairs: tuple[tuple[str, str], ...]
    columns: tuple[ColumnSpec, ...] = ()


@dataclass
class Registry:
    """What the steps of a flow refer to by name. Resolved once, on the driver."""

    templates: dict[str, Callable[..., DataFrame] | Mapping[str, str]] = field(default_factory=dict)
    column_functions: dict[str, Callable] = field(default_factory=dict)
    mappings: dict[str, FieldMapping] = field(default_factory=dict)


@dataclass(frozen=True)
class FlowSpec:
    flow_id: int
    name: str
    strategy: Strategy = Strategy.FULL
    incremental_column: str | None = None
    incremental_type: str = "STRING"
    stages: tuple[Stage, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    key: tuple[str, ...] = ("id",)
    sequence: tuple[str, ...] = ()
    cap: int | None = None

    @staticmethod
    def from_json(text: str) -> FlowSpec:
        """From a JSON document; without stages the three older fields are read instead."""
        doc = json.loads(text)
        stages = tuple(
            Stage(s["position"], s.get("name") or "", tuple(Step.parse(e) for e in s.get("steps") or ()))
            for s in doc.get("pipelineConfig") or ()
        ) or _stages_of_older_fields(doc)
        return FlowSpec(
            flow_id=int(doc["id"]), name=doc.get("name") or "",
            strategy=Strategy.parse(doc.get("syncStrategy")),
            incremental_column=doc.get("incrementalColumn") or None,
            incremental_type=doc.get("incrementalColumnType") or "STRING",
            stages=stages, params=doc.get("templateParams") or {},
            key=tuple(doc.get("key") or ("id",)), sequence=tuple(doc.get("sequence") or ()),
            cap=doc.get("cap"))

    def compile(self, registry: Registry, positions: Sequence[str] = (AFTER_READ, BEFORE_WRITE)
                ) -> list[Callable[[DataFrame], DataFrame]]:
        """The steps at ``positions``, in list order, as DataFrame functions."""
        return [self._function(step, registry) for stage in self.stages
                if stage.position in positions for step in stage.steps]

    def _function(self, step: Step, registry: Registry) -> Callable[[DataFrame], DataFrame]:
        params = dict(step.params or self.params)
        if step.type == MAPPING:
            mapping = registry.mappings[step.ref or ""]
            exprs = {c.key: registry.column_functions[c.template] for c in mapping.columns if c.template}
            return lambda df: map_fields(df, mapping.pairs, exprs)
        if step.type == TEMPLATE:
            template = registry.templates[step.ref or ""]
            if callable(template):
                return lambda df: template(df, **params)
            return lambda df: expression_template(df, template, params)
        raise ValueError(f"unknown step type: {step.type}")


def _stages_of_older_fields(doc: Mapping[str, Any]) -> tuple[Stage, ...]:
    def present(name: str) -> bool:
        return bool(doc.get(name)) and int(doc[name]) > 0

    first = []
    if present("preTemplateId"):
        first.append(Step(TEMPLATE, str(doc["preTemplateId"])))
    if present("mappingTemplateId"):
        first.append(Step(MAPPING, str(doc["mappingTemplateId"])))
    stages = [Stage(AFTER_READ, "read", tuple(first))] if first else []
    if present("postTemplateId"):
        stages.append(Stage(BEFORE_WRITE, "write", (Step(TEMPLATE, str(doc["postTemplateId"])),)))
    return tuple(stages)
