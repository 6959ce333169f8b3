"""Parameters of the operators, with the values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# Title words that reject a posting.
TITLE_DENY = (
    "sales", "recruiter", "teacher", "nurse", "driver", "warehouse", "account executive", "counsel",
    "customer success", "technical support", "accountant", "paralegal", "tax analyst", "fp&a",
    "strategic finance", "treasury", "payroll", "credit risk", "business controller",
    "recruiting coordinator", "talent sourcer", "technical sourcer", "executive assistant",
    "executive business partner", "people analytics", "employee relations", "benefits analyst",
    "total rewards", "talent acquisition", "product designer", "brand designer", "motion designer",
    "web designer", "production designer", "content designer", "design systems lead", "asic",
    "rtl design", "design verification", "pcba", "manufacturing engineer", "data center",
    "power trading", "power delivery",
)

# Words that mark another kind of role in a description.
ROLE_MARKERS = (
    "quota", "pipeline generation", "outbound pipeline", "prospecting", "cold outreach",
    "discovery calls", "deal cycle", "sales cycle", "closing deals", "book of business", "upsell",
    "cross-sell", "icp", "meddic", "bant", "on-target earnings", "salesforce", "gong", "hubspot",
    "developer advocate", "developer advocacy", "devrel", "evangelism", "on camera", "on stage",
    "conference talks", "growing audience", "twitch",
)

# Seniorities that reject a posting.
SENIORITY_DENY = ("intern", "staff", "principal", "manager", "director", "executive")

# Trust in an adapter's data, for precedence among duplicates.
FIDELITY = {
    "manual": 95, "ashby": 90, "greenhouse": 90, "lever": 88, "workday": 85, "smartrecruiters": 82,
    "workable": 80, "recruitee": 78, "google": 75, "microsoft": 74, "amazon": 72, "mail_alert": 20,
}

# Phrases of requirements that are conditions rather than skills.
BOILERPLATE = (
    "communication skill", "verbal and written", "written and verbal", "excellent communicator",
    "communicate with clarity", "bachelor's degree", "bachelor degree", "graduate degree",
    "bs degree", "bs (or higher)", "minimum education", "field of study",
    "equivalent practical experience", "fast-paced", "fast paced", "fast-moving",
    "thrives in ambiguity", "take ownership of your growth", "taking ownership of complex",
    "bias toward action", "highly adaptable", "coachability",
    "relentless commitment to excellence", "proactive approach", "cultural nuances",
    "problem-solving skills", "fluency in english", "fluency in spanish", "near-native fluency",
    "high quality code that is easily understood",
)

# Statuses of a source's run.
COMPLETED_STATUSES = ("ok", "empty", "disabled")
SEEN_STATUSES = ("ok", "empty")
NON_FAULT_STATUSES = ("ok", "empty", "rate_limited", "circuit_open", "disabled")

# Requirement kinds by bucket.
HARD_KINDS = ("hard",)
NICE_KINDS = ("nice", "tool")

# Gates of the evaluation, with whether higher is better.
GATES = {
    "hard_recall": (0.90, True),
    "hard_precision": (0.85, True),
    "kind_accuracy": (0.88, True),
    "normalisation_accuracy": (0.95, True),
    "coverage_kappa": (0.70, True),
    "ranking_rho": (0.75, True),
    "grounding_violations": (0.0, False),
}

# Events of an application by how far they lead.
STATUS_RANKS = {"submitted": 0, "acknowledged": 1, "screening": 2, "interview": 3, "offer": 4}
TERMINAL_STATUSES = ("rejected", "withdrawn")


@dataclass(frozen=True)
class Settings:
    """Everything a plan depends on besides its inputs."""

    title_deny: tuple[str, ...] = TITLE_DENY
    role_markers: tuple[str, ...] = ROLE_MARKERS
    role_marker_min: int = 2
    seniority_deny: tuple[str, ...] = SENIORITY_DENY
    default_locations: tuple[str, ...] = ("IN", "Remote")
    max_years: int = 5
    min_description_chars: int = 400
    max_description_chars: int | None = 60_000  # None: whole texts
    extract_alerts: bool = False
    close_after: int = 2
    company_match: float = 0.45
    blend_hard: Decimal = Decimal("0.80")
    partial_credit: Decimal = Decimal("0.50")
    adjacency_min: Decimal = Decimal("0.40")
    tier_dream: Decimal = Decimal("1.10")
    tier_strong: Decimal = Decimal("1.00")
    tier_volume: Decimal = Decimal("0.90")
    recency_grace: int = 14
    recency_half_life: int = 45
    recency_floor: Decimal = Decimal("0.65")
    gate_pass: Decimal = Decimal("0.60")
    gate_warn: Decimal = Decimal("0.40")
    gate_warn_factor: Decimal = Decimal("0.85")
    gate_fail_factor: Decimal = Decimal("0.65")
    tie_band: Decimal = Decimal("1.00")
    max_regression: float = 0.02
    score_version: str = "score.v1"


DEFAULT = Settings()
