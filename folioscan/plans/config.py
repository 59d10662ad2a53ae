"""Audit configuration: which dimensions and rules run, and how they weigh."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from importlib import resources

from folioscan.rules import catalog as cat


@dataclass(frozen=True)
class RuleConfig:
    enabled: bool = True
    severity: str | None = None

    def __post_init__(self):
        if self.severity not in (None, *cat.SEVERITIES):
            raise ValueError(f"unknown severity {self.severity!r}")


@dataclass(frozen=True)
class DimensionConfig:
    enabled: bool = True
    weight: float = 1.0
    threshold: int = 70
    rules: dict[str, RuleConfig] = field(default_factory=dict)

    def __post_init__(self):
        if not 0.0 <= self.weight <= 1.0:
            raise ValueError("weight must lie between 0 and 1")


def _defaults() -> dict[str, DimensionConfig]:
    return {d: DimensionConfig(weight=cat.DIMENSION_WEIGHTS[d], threshold=cat.DIMENSION_THRESHOLDS[d])
            for d in cat.DIMENSIONS}


@dataclass(frozen=True)
class AuditConfig:
    dimensions: dict[str, DimensionConfig] = field(default_factory=_defaults)
    fail_threshold: int | None = None
    override_severity: bool = False  # let RuleConfig.severity replace the rule's own

    def enabled_dimensions(self) -> tuple[str, ...]:
        return tuple(d for d in cat.DIMENSIONS if d in self.dimensions and self.dimensions[d].enabled)

    def rule(self, rule_id: str) -> RuleConfig:
        dim = self.dimensions.get(cat.RULE[rule_id].dimension)
        return dim.rules.get(rule_id, RuleConfig()) if dim else RuleConfig()

    def runs(self, rule_id: str) -> bool:
        if cat.RULE[rule_id].dimension not in self.enabled_dimensions():
            return False
        return rule_id == "prompt_missing" or self.rule(rule_id).enabled

    def weight(self, dimension: str) -> float:
        return self.dimensions[dimension].weight

    def severity(self, rule_id: str, own: str) -> str:
        return (self.rule(rule_id).severity or own) if self.override_severity else own

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def digest(self) -> str:
        """Identifies the configuration in stored results."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:16]


def merge_layers(*layers: dict) -> dict:
    """Nested maps merged key by key; later layers win; inputs stay untouched."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, dict) and isinstance(out.get(key), dict)
            out[key] = merge_layers(out[key], value) if both else (
                merge_layers(value) if isinstance(value, dict) else value)
    return out


def default_layer() -> dict:
    return {"dimensions": {d: {"enabled": True, "weight": c.weight, "threshold": c.threshold}
                           for d, c in _defaults().items()}}


def layered_config(*layers: dict, override_severity: bool = False) -> AuditConfig:
    """Default, preset and user layers (parsed YAML or JSON), later ones winning."""
    merged = merge_layers(default_layer(), *layers)
    dimensions = {}
    for name, body in merged["dimensions"].items():
        rules = {r: RuleConfig(v.get("enabled", True), v.get("severity")) for r, v in body.get("rules", {}).items()}
        dimensions[name] = DimensionConfig(
            body.get("enabled", True), body.get("weight", 1.0), body.get("threshold", 70), rules)
    return AuditConfig(dimensions, merged.get("fail_threshold"), override_severity)


def preset(name: str) -> dict:
    """A layer that comes with the package."""
    return json.loads((resources.files("folioscan.presets") / f"{name}.json").read_text(encoding="utf-8"))


def load_layer(path: str) -> dict:
    """A layer from a JSON file, or a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return json.load(handle)
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("reading YAML layers needs the yaml module") from missing
        return yaml.safe_load(handle) or {}
