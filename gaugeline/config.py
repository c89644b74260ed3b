"""Parameters and fixed values of the quality-control jobs."""

from __future__ import annotations

from dataclasses import dataclass

VARIABLES = ("temperature", "pressure", "humidity")
VOTES = ("rule_score", "statistical_score", "isolation_score", "temporal_score")

# Fault labels in priority order.
NORMAL = "NORMAL"
FAULT_FAMILIES = ("MISSING", "SPIKE", "FROZEN", "DRIFT", "NOISE")
SUSPICIOUS = "SUSPICIOUS"

# Health points lost per confirmed fault.
FAULT_PENALTIES = {
    "temperature_spike": 15,
    "temperature_drift": 10,
    "temperature_frozen": 12,
    "temperature_drop": 10,
    "humidity_spike": 8,
    "humidity_drift": 8,
    "humidity_frozen": 10,
    "humidity_drop": 8,
    "pressure_spike": 8,
    "pressure_drift": 8,
    "pressure_frozen": 10,
    "pressure_drop": 8,
    "temperature_missing": 5,
    "humidity_missing": 5,
    "pressure_missing": 5,
    "multivariate_inconsistency": 10,
}
DEFAULT_PENALTY = 5

# Which penalty a diagnosed label maps to.
LABEL_PENALTY_KEY = {
    "SPIKE": "temperature_spike",
    "DRIFT": "temperature_drift",
    "FROZEN": "temperature_frozen",
    "MISSING": "temperature_missing",
    "NOISE": "multivariate_inconsistency",
    "SUSPICIOUS": "multivariate_inconsistency",
}

# Magnitudes of injected faults by severity.
SEVERITIES = ("mild", "moderate", "severe")
SEVERITY_MAGNITUDE = {
    "temperature": {"mild": 5.0, "moderate": 10.0, "severe": 20.0},
    "pressure": {"mild": 5.0, "moderate": 10.0, "severe": 20.0},
    "humidity": {"mild": 10.0, "moderate": 25.0, "severe": 40.0},
}
DRIFT_STEP = {"mild": 0.2, "moderate": 0.5, "severe": 1.0}
MULTIVARIATE_SHIFT = {"mild": 5.0, "moderate": 10.0, "severe": 15.0}
NOISE_SIGNS = (1, -1, 1, 1, -1, 1)
FAULT_DURATIONS = (1, 2, 3, 4, 6)

# Columns that carry ground truth; no detector, model or diagnosis may read them.
TRUTH_COLUMNS = (
    "is_anomaly",
    "fault_type",
    "fault_severity",
    "original_temperature",
    "original_pressure",
    "original_humidity",
)


@dataclass(frozen=True)
class QCConfig:
    """Thresholds of all operators, and the sizes that steer the physical plan."""

    # The published thresholds, down to confidence_boost.
    # plausibility limits: a null reading is flagged
    temperature_limits: tuple[float, float] = (-50.0, 60.0)
    humidity_limits: tuple[float, float] = (0.0, 100.0)
    pressure_limits: tuple[float, float] = (870.0, 1085.0)
    # tight physical range: a null reading is not flagged
    tight_temperature: tuple[float, float] = (-20.0, 50.0)
    tight_humidity: tuple[float, float] = (0.0, 100.0)
    tight_pressure: tuple[float, float] = (950.0, 1050.0)

    z_limit: float = 3.0
    z_cap: float = 6.0
    deviation_limit: float = 10.0
    change_limit: float = 6.0
    trend_limit: float = 3.0
    freeze_run: int = 6
    freeze_std: float | None = 1.0

    weight_temporal: float = 0.4
    weight_ml: float = 0.6
    ensemble_cut: float = 0.5
    reason_ml_cut: float = 0.7

    baseline_min_rows: int = 3
    std_min_rows: int = 6

    spike_k: float = 5.0
    residual_k: float = 5.0
    frozen_min_repeat: int = 4
    frozen_std_quantile: float = 0.1
    noise_flip_min: int = 2
    noise_std_k: float = 1.0
    drift_change_k: float = 3.0
    drift_flip_max: int = 2
    min_confidence: float = 0.3

    neighbor_km: float = 100.0
    spatial_threshold: float = 5.0
    confidence_boost: float = 0.2

    # Length of the time slices a station's history is cut into for window work.
    slice_hours: int = 336
    # Largest table that is broadcast, in rows (checked, never assumed).
    broadcast_rows: int = 200_000
    # Largest group for which the one-pass exact percentile aggregate is used.
    percentile_group_rows: int = 2_000_000


DEFAULT = QCConfig()
