"""The chain from scored points to sessions: anomalies, spoofing, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wayfold.operators import anomaly, iforest, risk, spoofing, summary
from wayfold.sources.staging import staged


def prepared(points: DataFrame) -> DataFrame:
    """Scored points, computed once into the shared folder: all branches read from there the columns they need."""
    return staged(summary.with_trips(points), "scored-points")


def known(points: DataFrame, **mature: int) -> DataFrame:
    """A row per user of prepared points, computed once: anomalies and deviations both look there."""
    return staged(summary.users(points, **mature), "users")


def detected(points: DataFrame, users: DataFrame | None = None, *, iso: DataFrame | None = None, detectors: anomaly.Detectors | None = None) -> DataFrame:
    """Prepared points with anomalies. Isolation scores come from `iso`, or from the points' own iso_score."""
    users = known(points) if users is None else users
    return anomaly.detect(points, users, iso, detectors, fits=anomaly.fit_hbos_arrays(points, users.select("user_id", "ends.*")))


def located(points: DataFrame, *, mature_trips: int = 5, mature_points: int = 100, iso: DataFrame | None = None, forest: bool = False) -> DataFrame:
    """Scored points with anomalies, baseline deviation, session spoofing, risk and trust.

    Points and the row per user are written when this is called, not first when
    the result is read. iso: isolation scores (event_id, iso_score), if the
    points have none of their own; forest: learn and apply isolation forests.
    """
    points = prepared(points)
    users = known(points, mature_trips=mature_trips, mature_points=mature_points)
    found = detected(points, users, iso=iforest.score(points) if forest else iso)
    return risk.locations(risk.baseline_deviation(found, users), spoofing.sessions(points))


def sessions(points: DataFrame, **options) -> DataFrame:
    return risk.session_risk(located(points, **options))
