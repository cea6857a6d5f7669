"""Connections to beacon alerts in one shuffle on the group key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pulseloom.operators import gaps, scoring, sequences
from pulseloom.plans.hotgroups import DEFAULT, Limits, spread
from pulseloom.schemas import FEATURES, GAP_HISTORY, GROUP_KEYS, SEQUENCE_LENGTH, SORT_COLUMN

HISTORY = GAP_HISTORY + SEQUENCE_LENGTH - 1


def scored_windows(connections: DataFrame, tie: list[str], score: Callable = scoring.regularity,
                   limits: Limits = DEFAULT) -> DataFrame:
    """Gap features, windows and a score that is a window aggregate: one exchange, no Python."""
    s = spread(connections, GROUP_KEYS, SORT_COLUMN, tie=tie, rows_back=HISTORY, limits=limits)
    return sequences.windows_on(gaps.gap_features_on(s, tie), tie, extra={"probability": score})


def modelled_windows(connections: DataFrame, tie: list[str], scorer: Callable, features: list[str] = FEATURES,
                     batch_size: int = scoring.SCORE_BATCH, limits: Limits = DEFAULT) -> DataFrame:
    """The same with a batch scorer on float32 windows; rows cross to Python once, not ten times."""
    s = spread(connections, GROUP_KEYS, SORT_COLUMN, tie=tie, rows_back=HISTORY, limits=limits)
    s = gaps.gap_features_on(s, tie)
    return scoring.score_rows(s, tie, sequences.feature_vector(s.df, features), scorer, batch_size=batch_size)


def beacon_alerts(connections: DataFrame, tie: list[str], threshold, score: Callable = scoring.regularity,
                  limits: Limits = DEFAULT) -> DataFrame:
    """Which communication groups look like beacons?"""
    best = scoring.best_windows(scored_windows(connections, tie, score, limits))
    return scoring.by_confidence(scoring.alerts(best, threshold))
