"""Run parameters and their defaults.

Everything here is an argument somewhere in the library; nothing reads these
names behind the caller's back except as a default value.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# --- fixed values: they must equal the published study set-up ---------------
CHANGE_DATE = dt.date(2023, 10, 7)
PRE_PERIOD = (dt.date(2021, 10, 7), dt.date(2022, 10, 6))
FIRST_POST_START = dt.date(2022, 10, 7)
POST_MONTHS = 2
N_POST = 19
RADAR_BANDS = ("VV", "VH")
OPTICAL_BANDS = ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B11", "B12")
REDUCERS = ("mean", "stdDev", "median", "min", "max", "skew", "kurtosis")
ORBITS = (87, 94, 160)
EXTRACT_WINDOW = "1x1"
SEVERE_CLASSES = (1, 2)
N_EPOCHS = 14
CLASS_NAMES = {
    1: "Destroyed",
    2: "Severely damaged",
    3: "Moderately damaged",
    4: "Possibly damaged",
    5: "Possible damage from adjacent impact",
    6: "No visible damage",
    11: "Unknown/other",
}
UNKNOWN_CLASS = "Unknown"
SPLIT_SEED = 42
TRAIN_FRACTION = 0.2
MIN_AREA_M2 = 50.0
LABEL_BUFFER_M = 5.0
POINT_BUFFER_M = 10.0
RULE_THRESHOLD = int(0.670 * 255)
HALF_THRESHOLD = 127
SCALE_MAX = 255
TILE_ZOOM = 12
PIXEL_M = 10.0
CLOUD_SCORE_MIN = 0.6
MIN_IMAGES_PRE = 10
MIN_IMAGES_EACH = 5
PRECISION_TARGET = 0.9
OOB_EPSILON = 0.0005
OOB_COUNTS = tuple(range(1, 151, 5))
MTRY_VALUES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 28)
TREE_COUNTS = (10, 25, 50, 75, 100)
BASELINE_RUN = {
    "run_name": "published baseline",
    "f1": 0.749,
    "precision": 0.671,
    "recall": 0.846,
    "roc_auc": 0.813,
    "model": "random_forest",
    "numberOfTrees": 50,
    "split_strategy": "aoi",
}
# -----------------------------------------------------------------------------


def month_windows(
    first_start: dt.date = FIRST_POST_START, n: int = N_POST, months: int = POST_MONTHS
) -> list[tuple[dt.date, dt.date]]:
    """``n`` back-to-back windows of ``months`` months; both ends are inclusive."""

    def shift(k: int) -> dt.date:
        m = first_start.month - 1 + k * months
        return first_start.replace(year=first_start.year + m // 12, month=m % 12 + 1)

    return [(shift(k), shift(k + 1) - dt.timedelta(days=1)) for k in range(n)]


def linspace_thresholds(start: float, stop: float, step: float) -> list[float]:
    """Evenly spaced thresholds ``start, start+step, ... < stop``, free of drift."""
    out, k = [], 0
    while start + k * step < stop - 1e-9:
        out.append(round(start + k * step, 6))
        k += 1
    return out


COARSE_THRESHOLDS = linspace_thresholds(0.1, 0.96, 0.025)
FINE_THRESHOLDS = linspace_thresholds(0.1, 0.95, 0.005)


@dataclass(frozen=True)
class RunConfig:
    """One train/score/evaluate run."""

    model_name: str = "random_forest"
    bands: tuple[str, ...] = RADAR_BANDS
    reducers: tuple[str, ...] = REDUCERS
    extract_window: str = EXTRACT_WINDOW
    aggregation: str = "mean"
    threshold: float = 0.5
    thresholds: tuple[float, ...] = (0.5, 0.655)
    seed: int = 0
    balanced: bool = False
    train_on_all: bool = False
    split_strategy: str = "aoi"
    model_args: dict = field(default_factory=lambda: {"numTrees": 50, "minInstancesPerNode": 3})
