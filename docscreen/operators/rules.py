"""The rules snapshot: an immutable configuration that a DataFrame captures when it is defined."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

FIELDS = ("iqama_no", "name_ar", "name_en", "birth_date", "expiry_date", "nationality", "occupation", "employer_id", "employer_name", "issue_place", "work_place", "version_no")


@dataclass(frozen=True)
class Rules:
    """Thresholds and modes. Every value can be replaced; validate() refuses what makes no sense."""

    min_quality: float = 0.45
    old_layout_action: str = "REVIEW"
    old_layout_note: str = "older layout, check dates by hand"
    min_field_confidence: float = 0.75
    critical_fields: tuple[str, ...] = ("iqama_no", "expiry_date", "nationality", "occupation", "employer_id")
    order: tuple[str, ...] = ("NATIONALITY", "EXPIRY", "EMPLOYER", "OCCUPATION")
    further_checks: tuple[str, ...] = ()
    list_mode: str = "ALL_APPROVED"
    warn_days: int = 30
    time_zone: str = "UTC"
    individual_threshold: float = 0.85
    individual_with_eligible: str = "REVIEW"
    id_prefixes: tuple[tuple[str, str], ...] = (("1", "INDIVIDUAL"), ("2", "INDIVIDUAL"), ("7", "COMPANY"))
    occupation_model: str = "ALLOWLIST"
    fuzzy_threshold: float = 0.88
    review_below: float = 0.95
    auto_approve: bool = False
    confirm_rejections: bool = False
    hard_fail: tuple[tuple[str, float], ...] = (("EXPIRY", 0.75),)
    hard_fail_default: float = 0.85
    skipped_for_identity: tuple[str, ...] = ("EMPLOYER", "OCCUPATION")
    identity_critical: tuple[str, ...] = ("iqama_no", "expiry_date")
    company_threshold: float = 0.85
    default_companies: tuple[str, ...] = ()
    export_statuses: tuple[str, ...] = ("APPROVED",)
    retention_days: int = 365
    government: tuple[str, ...] = ("ministry", "municipality", "university")
    legal_forms: tuple[str, ...] = ("company", "ltd", "llc", "group")
    activities: tuple[str, ...] = ("trading", "contracting", "holding")
    person_patterns: tuple[str, ...] = (r"^\S+ \S+ \S+( \S+)?$",)
    version: str = field(default="", compare=False)

    def threshold(self, check: str) -> float:
        return dict(self.hard_fail).get(check, self.hard_fail_default)

    def validate(self) -> Rules:
        if self.list_mode not in ("ALL_APPROVED", "BLOCKLIST", "ALLOWLIST"):
            raise ValueError(f"list_mode {self.list_mode}")
        if self.occupation_model not in ("ALLOWLIST", "BLOCKLIST"):
            raise ValueError(f"occupation_model {self.occupation_model}")
        if self.warn_days < 0:
            raise ValueError("warn_days is negative")
        if unknown := set(self.order) - {"NATIONALITY", "EXPIRY", "EMPLOYER", "OCCUPATION", *self.further_checks}:
            raise ValueError(f"unknown checks {sorted(unknown)}")
        return replace(self, version=self.version or fingerprint({"rules": repr(replace(self, version=""))}))


def fingerprint(files: dict[str, str]) -> str:
    """The first 12 hex digits of the SHA-256 over names and contents, in the order given."""
    h = hashlib.sha256()
    for name, content in files.items():
        h.update(name.encode())
        h.update(content.encode())
    return h.hexdigest()[:12]


def load(path: str) -> Rules:
    """Rules from a YAML mapping of the fields above."""
    import yaml

    with open(path, encoding="utf-8-sig") as f:
        given = yaml.safe_load(f) or {}
    tuples = {k: tuple(map(tuple, v.items())) if isinstance(v, dict) else tuple(v) for k, v in given.items() if isinstance(v, list | dict)}
    return Rules(**(given | tuples)).validate()


def today(rules: Rules):
    """The date in the rules' time zone, as a column; tests give a literal instead."""
    from pyspark.sql import functions as F

    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(rules.time_zone), F.current_timestamp().cast("timestamp_ntz")))


def load_lists(path: str) -> dict[str, tuple[str, ...]]:
    """A YAML mapping of names to lists of words: employer rules, or the labels printed on cards."""
    import yaml

    with open(path, encoding="utf-8-sig") as f:
        given = yaml.safe_load(f) or {}
    if wrong := [k for k, v in given.items() if not isinstance(v, list)]:
        raise ValueError(f"not lists: {wrong}")
    return {k: tuple(str(x).strip() for x in v if str(x).strip()) for k, v in given.items()}


def with_employer_rules(rules: Rules, lists: dict[str, tuple[str, ...]]) -> Rules:
    """rules with the word lists of an employer file: government, legal_forms, activities, person_patterns."""
    if unknown := set(lists) - {"government", "legal_forms", "activities", "person_patterns"}:
        raise ValueError(f"unknown lists {sorted(unknown)}")
    return replace(rules, **lists, version="").validate()
