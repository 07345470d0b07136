"""Rule registry: name -> ``DataFrame -> DataFrame`` operator over de-duplicated transactions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame

from farewatch.config import RulesConfig
from farewatch.operators.rules.bursts import h3_bursts
from farewatch.operators.rules.cash import h11_high_cash, h12_low_cash
from farewatch.operators.rules.categories import (
    h7_night_school, h10_atypical_benefit, h17_zero_sum, h19_unknown_categories,
)
from farewatch.operators.rules.frequency import h1_high_frequency, h20_duplicates
from farewatch.operators.rules.poisson import h21_ks_exponential, h21_poisson_deviation
from farewatch.operators.rules.route import h2_route_spike, h2_route_spike_daily
from farewatch.operators.rules.series import (
    h4_benefit_series, h4_benefit_sessions, h8_school_card_multiple, h8_school_sessions,
)
from farewatch.operators.rules.taps import SharedTaps, Taps

Rule = Callable[[DataFrame | Taps, RulesConfig], DataFrame]

# the thirteen rules of the default run, in their usual order
RULES: dict[str, Rule] = {
    "H1": lambda tx, c: h1_high_frequency(tx, c.h1),
    "H2": lambda tx, c: h2_route_spike(tx, c.h2),
    "H3": lambda tx, c: h3_bursts(tx, c.h3),
    "H4": lambda tx, c: h4_benefit_series(tx, c.h4),
    "H7": lambda tx, c: h7_night_school(tx, c.h7),
    "H8": lambda tx, c: h8_school_card_multiple(tx, c.h8),
    "H10": lambda tx, c: h10_atypical_benefit(tx, c.h10),
    "H11": lambda tx, c: h11_high_cash(tx, c.h11),
    "H12": lambda tx, c: h12_low_cash(tx, c.h12),
    "H17": lambda tx, c: h17_zero_sum(tx, c.h17),
    "H19": lambda tx, c: h19_unknown_categories(tx, c.h19),
    "H20": lambda tx, c: h20_duplicates(tx, c.h20),
    "H21": lambda tx, c: h21_poisson_deviation(tx, c.h21),
}

# opt-in variants that do what the parity rules were meant to do
EXTRA_RULES: dict[str, Rule] = {
    "H2d": lambda tx, c: h2_route_spike_daily(tx, c.h2),
    "H4s": lambda tx, c: h4_benefit_sessions(tx, c.h4),
    "H8s": lambda tx, c: h8_school_sessions(tx, c.h8),
    "H21k": lambda tx, c: h21_ks_exponential(tx, c.h21),
}


def register_rule(name: str, rule: Rule) -> None:
    """Extension point: add a rule usable by ``run_rules(selected=[name])``. It gets a ``Taps``
    (``.tx`` is the table) and the configuration."""
    EXTRA_RULES[name] = rule


def run_rules(tx: DataFrame, selected: Iterable[str] | None = None,
              config: RulesConfig | None = None) -> dict[str, DataFrame]:
    """Build every selected rule (all thirteen when ``selected`` is empty). Unknown names raise
    ``KeyError``. ``tx`` should be read from a written table. A single rule reads it lazily by
    itself; several share what they count and filter through two tables written here."""
    config = config or RulesConfig()
    names = list(selected) if selected else list(RULES)
    table = {**RULES, **EXTRA_RULES}
    unknown = [n for n in names if n not in table]
    if unknown:
        raise KeyError(f"unknown rules: {', '.join(unknown)}; known: {', '.join(table)}")
    source = SharedTaps(tx, config) if len(names) > 1 else Taps(tx)
    return {name: table[name](source, config) for name in names}


def union_anomalies(results: dict[str, DataFrame]) -> DataFrame:
    frames = list(results.values())
    if not frames:
        raise ValueError("no rule results")
    return reduce(lambda a, b: a.unionByName(b), frames)


__all__ = ["RULES", "EXTRA_RULES", "register_rule", "run_rules", "union_anomalies"]
