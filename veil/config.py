"""What to look for and what to keep. Everything here is resolved on the driver before a plan exists."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from veil.lexicons import Lexicons

# Detector switches and their defaults.
DETECTORS = {
    "EMAIL": True, "CREDIT_CARD": True, "SA_ID": True, "SSN": True, "PHONE": True, "IPV4": True, "IBAN": True,
    "IPV6": True, "MAC": True, "VIN": True, "PAN_INDIA": True, "NINO_UK": True, "AADHAAR": True,
    "ETH_ADDRESS": True, "BTC_ADDRESS": True, "STREET_ADDRESS": True, "PERSON": False, "SECRETS": True,
}
# Network identifiers the default profile leaves alone.
NOISY_IN_CODE = ("IPV4", "IPV6", "MAC")
# What a level name means as a numeric floor.
LEVEL_FLOOR = {"high": 0.95, "medium": 0.70, "low": 0.50}


def resolve_detectors(profile: str = "code", explicit=None, person: bool = False) -> dict[str, bool]:
    """Switches for a named profile; an explicit list replaces the profile altogether."""
    if explicit:
        wanted = {name.strip().upper() for name in explicit if name.strip()}
        flags = {name: name in wanted for name in {**DETECTORS, **dict.fromkeys(wanted)}}
    else:
        quiet = () if profile == "strict" else NOISY_IN_CODE
        flags = {name: on and name not in quiet for name, on in DETECTORS.items()}
    if person:
        flags["PERSON"] = True
    return flags


@dataclass(frozen=True)
class Config:
    detectors: dict[str, bool] = field(default_factory=dict)  # merged over DETECTORS
    person_mode: str = "balanced"  # or "strict"
    custom_terms: tuple[str, ...] = ()
    allow_terms: tuple[str, ...] = ()
    custom_patterns: tuple[dict, ...] = ()
    reject_ids: tuple[str, ...] = ()
    min_confidence: float | None = None
    min_confidence_level: str | None = None
    instance_threshold: dict[str, int] = field(default_factory=dict)
    token_prefix: str = "["
    token_suffix: str = "]"
    labels: bool = True
    tables: bool = True
    encoded: bool = True
    sweep: bool = True
    paired_names: int | None = None  # single names of a session that are tried together as first and last name; None: all
    header_lines: int | None = 5  # lines of a text among which a table's header is looked for; None: all
    lexicons: Lexicons = field(default_factory=Lexicons)

    def on(self, name: str) -> bool:
        return bool({**DETECTORS, **self.detectors}.get(name, False))

    @property
    def confidence_floor(self) -> float:
        if self.min_confidence is not None:
            return self.min_confidence
        return LEVEL_FLOOR.get(self.min_confidence_level or "", 0.0)

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    @classmethod
    def only(cls, *names: str, **kw) -> "Config":
        """Just the named detectors, nothing label-, table- or memory-driven."""
        flags = {**dict.fromkeys(DETECTORS, False), **dict.fromkeys(names, True)}
        defaults = dict(labels=False, tables=False, encoded=False, sweep=False)
        return cls(detectors=flags, **{**defaults, **kw})

    @classmethod
    def profile(cls, name: str = "code", explicit=None, person: bool = False, **kw) -> "Config":
        return cls(detectors=resolve_detectors(name, explicit, person), **kw)
