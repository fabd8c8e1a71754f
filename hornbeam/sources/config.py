"""Experiment configurations: a flat JSON object of strings."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


#: The keys of a configuration.
@dataclass
class Config:
    dataset_name: str = ""
    graph: str = ""
    train: str = ""
    valid: str = ""
    test: str = ""
    test_debug: str = ""
    schema: str = ""
    types_file: str = ""
    anyburl_rules: str = ""
    anyburl_rules_CP: str = ""  # noqa: N815
    amie_rules: str = ""
    amie_rules_CP: str = ""  # noqa: N815
    predictions_dir: str = ""
    def_uri: str = ""
    materialize_rules: str = "full"
    grounding_type: str = "both"

    def engines(self) -> list[str]:
        kind = self.grounding_type.lower()
        both = "both" in kind or not kind
        return [e for e in ("standard", "semantic") if both or e in kind]

    def rule_sets(self) -> dict[str, tuple[str, bool]]:
        """Name, path and whether rules are patterns, of the sets that materialize_rules selects and that are given."""
        kind = self.materialize_rules.lower()
        named = {"ALL": (self.anyburl_rules, False), "CP": (self.anyburl_rules_CP, False), "AMIE": (self.amie_rules, True), "AMIE_CP": (self.amie_rules_CP, True)}
        wanted = {"anyburl": ("ALL", "CP"), "amie": ("AMIE", "AMIE_CP")}.get(kind, tuple(named))  # "full", "both": all
        return {k: v for k, v in named.items() if k in wanted and v[0]}


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    known = {x.name for x in fields(Config)}
    return Config(**{k: str(v) for k, v in given.items() if k in known})


def percentages(text: str | None, default: tuple[float, ...] = ()) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()] if text else list(default)
