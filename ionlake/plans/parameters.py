"""Saving and loading of preprocessing parameters and of reference peaks as JSON."""

from __future__ import annotations

import json

from ionlake.plans.preprocessing import Step
from ionlake.schema import FileFormatError


def dumps(steps: list[Step], references: list[tuple[float, str]] = ()) -> str:
    """Steps in their order, parameters as flat strings 'step.name', and the reference peaks."""
    flat = {f"{s.name}.{k}": json.dumps(v) for s in steps for k, v in s.params.items()}
    enabled = {s.name: s.enabled for s in steps}
    return json.dumps({"order": [s.name for s in steps], "enabled": enabled, "params": flat, "standards": [{"mz": m, "label": n} for m, n in references]}, indent=1, sort_keys=True)


def loads(text: str) -> tuple[list[Step], list[tuple[float, str]]]:
    found = json.loads(text)
    steps = []
    for name in found.get("order", []):
        params = {k.split(".", 1)[1]: json.loads(v) for k, v in found.get("params", {}).items() if k.split(".", 1)[0] == name}
        steps.append(Step(name, params, bool(found.get("enabled", {}).get(name, True))))
    return steps, standards(found.get("standards", []))


def standards(entries) -> list[tuple[float, str]]:
    """Reference peaks from a list of {mz, label}; anything else is refused."""
    if not isinstance(entries, list) or any(not isinstance(e, dict) or not {"mz", "label"} <= e.keys() for e in entries):
        raise FileFormatError("reference peaks are a list of objects with mz and label")
    return [(float(e["mz"]), str(e["label"])) for e in entries]
