"""Configuration of a corpus build: sources, their selection, and the rules that values keep."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

#: Tokens of a source in a trial build.
TRIAL_QUOTA = 5000
#: What settings may be, by their name.
CHOICES = {
    "trainable.attention": ("freeze", "lora", "full"), "trainable.shared_expert": ("freeze", "lora", "full"), "trainable.routed_expert": ("freeze", "lora", "full"), "trainable.router": ("freeze", "full"),
    "lr_scheduler.type": ("cosine", "linear", "constant"), "prune.expert_selection": ("first_n", "manual", "router_top"),
}
#: Least and largest values of settings, the second excluded where the third is true.
RANGES = {"lr_scheduler.min_lr_ratio": (0.0, 1.0, False), "layerwise.warmup_ratio": (0.0, 1.0, True), "layerwise.batch_size": (1, None, False), "layerwise.gradient_accumulation_steps": (1, None, False), "layerwise.log_every_steps": (1, None, False), "eval_steps": (0, None, False), "val_split": (0.0, 0.5, True)}


@dataclass(frozen=True)
class SourceSpec:
    """One source of a build."""

    name: str
    transform: str = "plain_text"
    quota: int = 0
    enabled: bool = True
    extra: dict[str, Any] = field(default_factory=dict)


def read_config(text: str) -> dict:
    """A configuration in JSON, or in YAML where that library is there."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def sources_of(config: dict) -> list[SourceSpec]:
    """The sources in their order; an unknown field or a repeated name raises ValueError."""
    known = {f.name for f in dataclasses.fields(SourceSpec)}
    out = []
    for raw in config.get("sources", []):
        if unknown := set(raw) - known:
            raise ValueError(f"unknown fields of a source: {sorted(unknown)}")
        out.append(SourceSpec(**raw))
    if len({s.name for s in out}) < len(out):
        raise ValueError("two sources have one name")
    return out


def selected(sources: Sequence[SourceSpec], only: Sequence[str] = (), trial: bool = False) -> list[SourceSpec]:
    """The enabled sources, of `only` if it names any; in a trial with small quotas."""
    chosen = [s for s in sources if s.enabled and (not only or s.name in set(only))]
    return [dataclasses.replace(s, quota=min(s.quota, TRIAL_QUOTA)) for s in chosen] if trial else chosen


def violations(settings: dict[str, Any]) -> list[str]:
    """What breaks a rule in flat settings (`part.name`); names without a rule pass."""
    out = [f"{k} must be one of {', '.join(CHOICES[k])}" for k, v in settings.items() if k in CHOICES and v not in CHOICES[k]]
    for k, v in settings.items():
        if k in RANGES:
            least, most, open_end = RANGES[k]
            if v < least or most is not None and (v >= most if open_end else v > most):
                out.append(f"{k} must be in {least}..{most if most is not None else ''}")
    return out
