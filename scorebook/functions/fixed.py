"""Fixed values the results depend on.

These must equal the published ones for results to agree; they are parameters of the
operators everywhere, and only the defaults live here.
"""

from __future__ import annotations

from dataclasses import dataclass

# A group publishes an outcome only with this many rows of each outcome.
MIN_CELL = 20

# Two-sided 95 % normal quantile of the Wilson interval.
Z_95 = 1.959963984540054

# Months, right-closed: (-1, 3], (3, 6], ...
TENURE_EDGES = (-1, 3, 6, 12, 24, 48, 72)
TENURE_LABELS = ("0-3", "4-6", "7-12", "13-24", "25-48", "49-72")

# Monthly amount, left-closed: [0, 35), [35, 55), ...
CHARGE_EDGES = (0.0, 35.0, 55.0, 75.0, 95.0, 1e9)
CHARGE_LABELS = ("<$35", "$35-55", "$55-75", "$75-95", "$95+")

# Score bands [low, high), lowest first.
RISK_BANDS = (
    ("Low", 0.0, 0.25),
    ("Moderate", 0.25, 0.5),
    ("High", 0.5, 0.75),
    ("Critical", 0.75, 1.01),
)

HISTOGRAM_BINS = 20
RELIABILITY_BINS = 10
RANKED = 7
GRID_CUTS = 101

# Bounds on how offending values are quoted back.
QUOTED_VALUES = 5
QUOTED_CHARS = 40

# Attribution settings.
BACKGROUND_ROWS = 100
ORDERINGS = 10
ADDITIVITY_TOLERANCE = 1e-9
DEPENDENCE_BINS = 12
DEPENDENCE_MIN = 5

# Outcomes that may be shown, and the codes they read as.
SHOWN_PARTITIONS = ("train", "validation")
SYNTHETIC = "synthetic"

# Simplest first; ties in model selection go to the earlier one.
COMPLEXITY_ORDER = ("dummy", "logistic_regression", "random_forest", "hist_gradient_boosting")
BASELINE = "dummy"
DISPLAY_NAMES = {
    "dummy": "Baseline (predicts the prior)",
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "hist_gradient_boosting": "Hist Gradient Boosting",
}


@dataclass(frozen=True)
class Business:
    """Assumptions a threshold is priced under."""

    offer_cost: float = 50.0
    success_rate: float = 0.30
    horizon_months: int = 12
    margin: float = 0.65

    def __post_init__(self) -> None:
        if not 0.0 <= self.success_rate <= 1.0 or not 0.0 <= self.margin <= 1.0:
            raise ValueError("success_rate and margin are shares in [0, 1]")
        if self.offer_cost < 0 or self.horizon_months <= 0:
            raise ValueError("the offer cost is >= 0 and the horizon >= 1 month")

# The sentence of one contribution, as it has to read.
RAISES, LOWERS = ") raises", ") lowers"
RISK_SENTENCE = " the estimated risk by %.1f percentage points, relative to an average customer."
