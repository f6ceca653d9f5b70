"""Settings of the checks: strict about their names and ranges, read from dicts, JSON or YAML."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from textward.operators.capability import AUDIENCE, named
from textward.operators.resilience import Policy
from textward.operators.sessions import Limits

#: Who a session belongs to: a principal that the caller has verified, or whoever names the session.
IDENTITIES = ("authenticated", "anonymous")


@dataclass(frozen=True)
class Settings:
    input_threshold: float = 0.6
    output_overlap: float = 0.35
    max_scan_chars: int | None = 200_000
    enforcement: str = "enforce"
    session_identity: str = "authenticated"
    allowed_hosts: tuple[str, ...] = ()
    scan_output_urls: bool = True
    scan_tool_arguments: bool = True
    scan_tool_results: bool = True
    pattern_file: str | None = None
    default_patterns: bool = True
    system_prompt: str | None = None
    canary: bool = False
    audience: str | None = None
    key_reload_s: float = 60.0
    limits: Limits = field(default_factory=Limits)
    failures: Policy = field(default_factory=Policy)

    def __post_init__(self) -> None:
        if self.enforcement not in ("enforce", "shadow"):
            raise ValueError(f"enforcement is enforce or shadow, not {self.enforcement!r}")
        if self.session_identity not in IDENTITIES:
            raise ValueError(f"session_identity is one of {IDENTITIES}, not {self.session_identity!r}")
        for name in ("input_threshold", "output_overlap"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} lies in 0..1")
        if self.max_scan_chars is not None and self.max_scan_chars <= 0:
            raise ValueError("max_scan_chars is positive or None")
        if self.key_reload_s <= 0:
            raise ValueError("key_reload_s is positive")
        if self.pattern_file is None and not self.default_patterns:
            raise ValueError("no patterns: neither a file nor the defaults")
        if self.canary and self.system_prompt is None:
            raise ValueError("a canary is planted in a system_prompt, which is missing")
        if self.audience is not None and not named(AUDIENCE, self.audience):
            raise ValueError(f"no valid audience: {self.audience!r}")

    @classmethod
    def from_dict(cls, data: dict) -> Settings:
        """Settings of nested dicts; a name that isn't known is an error."""
        data = _known(cls, data, "settings")
        for name, kind in (("limits", Limits), ("failures", Policy)):
            if isinstance(data.get(name), dict):
                data[name] = kind(**_known(kind, data[name], name))
        if "allowed_hosts" in data:
            data["allowed_hosts"] = tuple(data["allowed_hosts"])
        return cls(**data)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings of a file, YAML by its ending (where a YAML library is installed), else JSON."""
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as e:
                    raise ValueError(f"{path}: no YAML library is installed") from e
                data = yaml.safe_load(f)
            else:
                data = json.load(f)
        if data is not None and not isinstance(data, dict):
            raise ValueError(f"{path}: not a table of settings")
        return cls.from_dict(data or {})

    def to_dict(self) -> dict:
        return dataclasses.asdict(self) | {"allowed_hosts": list(self.allowed_hosts)}


def _known(kind: type, data: dict, what: str) -> dict:
    if unknown := sorted(set(data) - {f.name for f in dataclasses.fields(kind)}):
        raise ValueError(f"unknown {what} {unknown}")
    return dict(data)
