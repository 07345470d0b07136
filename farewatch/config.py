"""Rule parameters.

The defaults below are fixed values that must equal the reference pipeline's
configuration for results to match; they are grouped here, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values (category codes, thresholds, hours) -------------------------------------
BANK_CARD_CATS = (91, 92, 93)
CASH_CAT = 151
BENEFIT_CATS = (201, 202, 203, 204, 205, 206, 207, 208, 209, 210, 303, 304)
SCHOOL_CATS = (203, 208, 209, 303)
SENIOR_CATS = (207,)
KNOWN_CATS = (91, 92, 93, 151, 201, 202, 203, 204, 205, 206, 207, 208, 209, 210, 303, 304)
ALLOWED_ZERO_CATS = (151, 201, 202, 203, 204, 205, 206, 207, 208, 209, 210, 303, 304)
PEAK_HOURS_MORNING = (7, 8, 9)
PEAK_HOURS_EVENING = (17, 18, 19)
SEGMENT_CATS = ("201", "203", "204")
# tokens the reference's CSV reader turns into missing values in every column (pandas' default
# NA strings), plus the text form of a missing value after ``astype(str)``
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
NEAR_DUPLICATE_SECONDS = 2
# --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class H1Config:
    threshold_raw: int = 6
    threshold_strong: int = 12
    exclude_service_cards: bool = True
    service_card_threshold: int = 12


@dataclass(frozen=True)
class H2Config:
    threshold_raw: float = 3
    threshold_strong: float = 5
    min_history_days: int = 90


@dataclass(frozen=True)
class H3Config:
    threshold_raw: int = 3
    threshold_strong: int = 5
    time_window_seconds: int = 1
    min_cards_in_burst: int = 2
    exclude_service_cards: bool = True
    service_card_threshold: int = 12


@dataclass(frozen=True)
class H4Config:
    series_length: int = 3
    interval_seconds: int = 60
    atypical_hours_start: int = 22
    atypical_hours_end: int = 6
    benefit_cats: tuple = BENEFIT_CATS


@dataclass(frozen=True)
class H7Config:
    night_start_hour: int = 0
    night_end_hour: int = 6
    school_cats: tuple = SCHOOL_CATS


@dataclass(frozen=True)
class H8Config:
    min_consecutive: int = 2
    interval_seconds: int = 60
    school_cats: tuple = SCHOOL_CATS
    same_validator_required: bool = True


@dataclass(frozen=True)
class H10Config:
    school_peak_threshold: float = 30
    senior_peak_threshold: float = 20
    peak_hours_morning: tuple = PEAK_HOURS_MORNING
    peak_hours_evening: tuple = PEAK_HOURS_EVENING
    school_cats: tuple = SCHOOL_CATS
    senior_cats: tuple = SENIOR_CATS


@dataclass(frozen=True)
class H11Config:
    cash_cat: int = CASH_CAT
    min_transactions: int = 10
    threshold_raw: float = 0.21
    threshold_strong: float = 0.47


@dataclass(frozen=True)
class H12Config:
    cash_cat: int = CASH_CAT
    min_transactions: int = 10
    threshold_raw: float = 0.07
    threshold_strong: float = 0.00


@dataclass(frozen=True)
class H17Config:
    allowed_zero_cats: tuple = ALLOWED_ZERO_CATS  # carried for completeness; the rule does not read it
    fraud_zero_cats: tuple = BANK_CARD_CATS


@dataclass(frozen=True)
class H19Config:
    known_cats: tuple = KNOWN_CATS


@dataclass(frozen=True)
class H20Config:
    mass_threshold: int = 5
    single_threshold: int = 2


@dataclass(frozen=True)
class H21Config:
    p_value_threshold: float = 0.05
    test_method: str = "Kolmogorov-Smirnov"
    min_history_days: int = 30


@dataclass(frozen=True)
class ReportConfig:
    target_percentile: float = 95
    min_weight: float = 0.01
    max_weight: float = 10.0


@dataclass(frozen=True)
class RulesConfig:
    h1: H1Config = field(default_factory=H1Config)
    h2: H2Config = field(default_factory=H2Config)
    h3: H3Config = field(default_factory=H3Config)
    h4: H4Config = field(default_factory=H4Config)
    h7: H7Config = field(default_factory=H7Config)
    h8: H8Config = field(default_factory=H8Config)
    h10: H10Config = field(default_factory=H10Config)
    h11: H11Config = field(default_factory=H11Config)
    h12: H12Config = field(default_factory=H12Config)
    h17: H17Config = field(default_factory=H17Config)
    h19: H19Config = field(default_factory=H19Config)
    h20: H20Config = field(default_factory=H20Config)
    h21: H21Config = field(default_factory=H21Config)
