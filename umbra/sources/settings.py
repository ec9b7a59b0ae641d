"""Settings, acronyms and patterns from files: small things that the driver reads."""

from __future__ import annotations

import csv
import json
from pathlib import Path
from typing import Any

from umbra.functions.catalog import Catalogue, Definition


class Settings:
    """Nested settings with dotted paths, JSON by default, YAML where a parser is installed."""

    def __init__(self, values: dict[str, Any] | None = None):
        self.values = values or {}

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, path: str, value: Any) -> None:
        *parts, last = path.split(".")
        at = self.values
        for part in parts:
            at = at.setdefault(part, {})
        at[last] = value

    def load(self, path: str | Path) -> bool:
        try:
            text = Path(path).read_text()
            self.values = _yaml().safe_load(text) if str(path).endswith((".yaml", ".yml")) else json.loads(text)
        except (OSError, ValueError, RuntimeError):
            return False
        return True

    def save(self, path: str | Path) -> bool:
        try:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(_yaml().safe_dump(self.values) if str(path).endswith((".yaml", ".yml")) else json.dumps(self.values, indent=2))
        except (OSError, TypeError, RuntimeError):
            return False
        return True


    def export(self, path: str | Path, metadata: bool = True) -> bool:
        """Writes the part of the settings that reproduces what they do, with counts and examples as metadata."""
        out: dict[str, Any] = {"version": self.get("version", "1.0.0"), "description": "Configuration for sharing"}
        if types := self.get("entity_types.active"):
            out["entity_types"] = {"active": types}
        if operators := self.get("anonymization.operators"):
            out["anonymization"] = {"operators": operators}
        out["processing"] = {k: self.get(f"processing.{k}", v) for k, v in {"batch_size": 1000, "worker_count": None, "expand_acronyms": True, "use_pyarrow": True}.items()}
        words, known = self.get("acronyms.dictionary") or {}, self.get("patterns") or []
        if words:
            out["acronyms"] = {"case_sensitive": self.get("acronyms.case_sensitive", False), "dictionary": words}
        if metadata and words:
            out.setdefault("metadata", {})["acronyms"] = {"count": len(words), "examples": dict([*words.items()][:10])}
        if metadata and known:
            out.setdefault("metadata", {})["patterns"] = {"count": len(known), "types": sorted({p["entity_type"] for p in known if "entity_type" in p})}
        return str(path).endswith((".json", ".yaml", ".yml")) and Settings(out).save(path)


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need a YAML parser") from e
    return yaml


def acronyms(path: str | Path, acronym: str = "acronym", expansion: str = "expansion") -> tuple[bool, dict[str, str]]:
    """Acronyms of a CSV file; False where the file or its columns are missing. Blank rows don't count."""
    try:
        with open(path, newline="", encoding="utf-8") as f:
            rows = csv.DictReader(f)
            if not {acronym, expansion} <= set(rows.fieldnames or []):
                return False, {}
            pairs = (((r[acronym] or "").strip(), (r[expansion] or "").strip()) for r in rows)
            return True, {a: e for a, e in pairs if a and e}
    except OSError:
        return False, {}


def patterns(path: str | Path, catalogue: Catalogue) -> tuple[Catalogue, int]:
    """The catalogue with a CSV file's patterns (entity_type, pattern; context split at commas, name, score), and how many came."""
    count = 0
    with open(path, newline="", encoding="utf-8") as f:
        for r in csv.DictReader(f):
            kind, regex = (r.get("entity_type") or "").strip(), (r.get("pattern") or "").strip()
            if kind and regex:
                context = [c.strip() for c in (r.get("context") or "").split(",") if c.strip()]
                grown = catalogue.add(Definition(kind, [regex], context, (r.get("name") or "").strip(), float(r.get("score") or 0.85)))
                count += grown is not catalogue
                catalogue = grown
    return catalogue, count
