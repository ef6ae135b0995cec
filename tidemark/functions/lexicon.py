"""Word lists and settings.  Every operator takes its lists as arguments; these are the defaults.

Order matters: where one term or family of several is chosen, the first wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# ---- fixed values: lists that results must agree on, in their given order

ENVIRONMENTAL = (
    "emission", "emissions", "carbon", "co2", "co2e", "ghg", "greenhouse gas", "climate", "scope 1", "scope 2", "scope 3", "energy",
    "electricity", "renewable", "solar", "wind", "fossil", "coal", "water", "waste", "recycl", "circular", "material", "packaging",
    "biodiversity", "deforestation", "supply chain", "sustainab", "environment", "decarbonis", "decarboniz", "offset", "removal",
    "sequestration", "intensity", "footprint",
)
WEAK = ("sustainab", "environment", "supply chain", "material", "packaging")
ATTRIBUTE = (
    "recyclable", "recycled", "carbon neutral", "carbon-neutral", "climate neutral", "climate-neutral", "net zero", "net-zero",
    "carbon negative", "carbon free", "carbon-free", "zero emission", "zero-emission", "zero waste", "eco-friendly",
    "environmentally friendly", "green energy", "green electricity", "green product", "green hydrogen", "clean energy",
    "clean electricity", "clean technology", "conscious choice", "conscious collection", "responsibly sourced", "responsibly produced",
    "sustainably sourced", "sustainably produced", "sustainable material", "sustainable cotton", "sustainable fashion",
    "sustainable aviation fuel", "biodegradable", "compostable", "plastic free", "plastic-free", "organic cotton",
    "certified sustainable", "nature positive", "climate positive",
)
STRENGTH = {
    "firm": ("will", "shall", "commit", "committed", "commitment", "is reducing", "are reducing", "we reduce", "must", "guarantee", "pledge", "have to"),
    "hedged": (
        "aim", "aims", "aiming", "strive", "striving", "hope", "work towards", "working towards", "working toward", "aspire", "ambition",
        "intend", "seek", "may", "could", "might", "should", "plan to", "explore", "consider", "help to", "contribute to", "support",
    ),
    "achievement": (
        "stopped", "ceased", "ended", "eliminated", "phased out", "discontinued", "launched", "installed", "switched", "transitioned",
        "achieved", "reached", "delivered", "reduced", "cut", "completed", "avoided", "surpassed", "exceeded",
    ),
}
VAGUE = (
    "significant", "significantly", "substantial", "substantially", "considerable", "meaningful", "leading", "world-class",
    "best-in-class", "ambitious", "robust", "strong", "strongly", "broadly", "largely", "various", "numerous", "many", "several",
    "appropriate", "relevant", "responsible", "better", "improved", "enhanced", "continued", "ongoing", "where possible",
    "as far as possible", "wherever feasible",
)
HEDGING = (
    "may", "might", "could", "would", "potentially", "possibly", "likely", "expect", "expects", "expected", "anticipate", "believe",
    "believes", "estimate", "estimated", "approximately", "around", "about", "roughly", "up to", "as much as", "intend", "seek",
    "subject to", "where feasible",
)
VERIFICATION = (
    "assured", "assurance", "audited", "verified", "verification", "third party", "third-party", "independent", "sbti",
    "science based targets", "science-based targets", "iso 14064", "iso 14001", "ghg protocol", "cdp", "gri", "accredited",
    "certified by", "limited assurance", "reasonable assurance",
)
SCOPE_MARKERS = (
    ("scope 1", "Scope 1"), ("scope 2", "Scope 2"), ("scope 3", "Scope 3"), ("own operations", "own operations"),
    ("our operations", "own operations"), ("value chain", "value chain"), ("supply chain", "supply chain"), ("upstream", "upstream"),
    ("downstream", "downstream"), ("tier 1", "supply chain (tier 1)"), ("group-wide", "group-wide"), ("globally", "global"),
)
POSITIVE = (
    "proud", "proudly", "excited", "exciting", "pleased", "delighted", "passionate", "committed", "leading", "leader", "pioneering",
    "innovative", "transformative", "groundbreaking", "ambitious", "bold", "remarkable", "outstanding", "excellent", "success",
    "successful", "achievement", "milestone", "progress", "advance", "strengthen", "accelerate", "empower", "inspire", "positive",
    "responsible", "thriving", "vibrant", "world-leading", "best-in-class",
)
NEGATIVE = (
    "concern", "concerned", "concerning", "challenge", "challenging", "shortfall", "shortfalls", "delay", "delayed", "delays",
    "setback", "setbacks", "unable", "difficult", "difficulty", "difficulties", "risk", "risks", "risky", "failed", "failure", "miss",
    "missed", "behind schedule", "behind target", "struggle", "struggled", "underperform", "underperformed",
)
FUTURE = ("will", "aim", "target", "goal", "ambition", "plan", "by 2030", "by 2040", "by 2050", "future", "intend", "commit")
FAMILIES = (
    ("total_emissions", ("scope 1, 2 and 3", "scope 1, 2 & 3", "absolute emissions", "total emissions", "total ghg")),
    ("scope_3", ("scope 3",)),
    ("scope_2", ("scope 2",)),
    ("scope_1", ("scope 1",)),
    ("recycled_share", ("recycled material", "recycled materials", "recycled content", "recycled polyester", "recycled cotton")),
    ("renewable_share", ("renewable electricity", "renewable energy", "renewable power")),
    ("carbon_intensity", ("carbon intensity", "emissions intensity", "carbon-intensity")),
)
#: Families whose targets are levels to reach; the others' are cuts.
UP_FAMILIES = ("recycled_share", "renewable_share")


@dataclass(frozen=True)
class Lexicon:
    environmental: tuple[str, ...] = ENVIRONMENTAL
    weak: tuple[str, ...] = WEAK
    attribute: tuple[str, ...] = ATTRIBUTE
    strength: dict[str, tuple[str, ...]] = field(default_factory=lambda: STRENGTH)
    vague: tuple[str, ...] = VAGUE
    hedging: tuple[str, ...] = HEDGING
    verification: tuple[str, ...] = VERIFICATION
    scope_markers: tuple[tuple[str, str], ...] = SCOPE_MARKERS
    positive: tuple[str, ...] = POSITIVE
    negative: tuple[str, ...] = NEGATIVE
    future: tuple[str, ...] = FUTURE
    families: tuple[tuple[str, tuple[str, ...]], ...] = FAMILIES

    @property
    def core(self) -> tuple[str, ...]:
        return tuple(t for t in self.environmental if t not in self.weak)

    @classmethod
    def of(cls, given: dict) -> Lexicon:
        """From a parsed configuration: known names replace the defaults, lower-cased; unknown ones are ignored."""
        low = lambda x: tuple(str(t).lower() for t in x)
        out = {}
        for f in fields(cls):
            value = given.get({"positive": "positive_tone", "negative": "negative_tone", "families": "metric_families"}.get(f.name, f.name))
            if value is None:
                continue
            if f.name == "strength":
                out[f.name] = {k: low(v) for k, v in value.items()}
            elif f.name == "families":
                out[f.name] = tuple((k, low(v)) for k, v in value.items())
            elif f.name == "scope_markers":
                out[f.name] = tuple((k.lower(), v) for k, v in value.items())
            else:
                out[f.name] = low(value)
        return cls(**out)


@dataclass(frozen=True)
class Settings:
    """Weights and thresholds; :meth:`of` overlays known names of a parsed configuration."""

    noise_floor_pct: float = 0.5
    magnitude_saturation_pct: float = 30.0
    rate_weight: float = 0.45
    magnitude_weight: float = 0.40
    redefinition_weight: float = 0.15
    target_cut_saturation_pct: float = 50.0
    target_rate_weight: float = 0.60
    target_magnitude_weight: float = 0.40
    actuals_block_weight: float = 0.65
    targets_block_weight: float = 0.35
    weights: dict[str, float] = field(default_factory=lambda: {"vagueness": 0.15, "unsupported_claims": 0.20, "sins_severity": 0.25, "goalpost_drift": 0.15})
    assurance_credit: dict[str, float] = field(default_factory=lambda: {"reasonable": 0.70, "limited": 0.90, "unspecified": 0.95, "none": 1.00})
    min_components: int = 3
    quotes_for_medium: int = 2
    quotes_for_high: int = 5
    components_for_medium: int = 3
    components_for_high: int = 4
    #: Links that a say-do score needs.
    min_links: int = 3
    #: Characters within which a phrase and a number or a verb of reduction belong together.
    near: int = 100

    @classmethod
    def of(cls, given: dict) -> Settings:
        flat = {k: v for k, v in given.items() if not isinstance(v, dict)} | given.get("drift", {}) | {k: given[k] for k in ("weights", "assurance_credit") if k in given}
        confidence = given.get("confidence", {})
        renamed = {"restatement_noise_floor_pct": "noise_floor_pct", "min_verified_quotes_for_medium": "quotes_for_medium", "min_verified_quotes_for_high": "quotes_for_high", "min_components_for_medium": "components_for_medium", "min_components_for_high": "components_for_high"}
        flat = {renamed.get(k, k): v for k, v in (flat | confidence).items()}
        return cls(**{f.name: flat[f.name] for f in fields(cls) if f.name in flat})
