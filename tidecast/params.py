"""Job parameters (replace the reference's YAML files and CLI flags)."""

from __future__ import annotations

from dataclasses import dataclass

FREQS = ("daily", "weekly", "monthly")

# Per-grain presets that must equal the reference's.
LAG_PRESETS = {"daily": [1, 7, 14, 30], "weekly": [1, 2, 4, 8], "monthly": [1, 2, 3]}
ROLLING_PRESETS = {"daily": [7, 14, 30], "weekly": [2, 4, 8], "monthly": [2, 3]}
SEQUENCE_LENGTH_PRESETS = {"daily": 14, "weekly": 8, "monthly": 6}
WORD_SEQUENCE_LENGTH = 12
WORD_LAGS = [1, 3, 6, 12]
DEFAULT_LAGS = [1, 2, 3, 6]
DEFAULT_WINDOWS = [2, 3, 6]
# Seven per-period features used as the sequence input, in this order.
SEQUENCE_FEATURES = ["order_count", "total_sales", "avg_order_value", "total_quantity",
                     "unique_customers", "avg_delivery_time", "avg_rating"]
# Prefixes of the pivot columns used as same-row extra features.
EXTRA_PREFIXES = ("cat_", "seg_", "delivery_", "sentiment_", "payment_")
TARGETS = ("total_sales", "order_count", "avg_order_value")
MIN_ROWS_FOR_YOY = 13          # yoy growth only when there are more than 12 rows
MIN_DATA_MONTHS = 6            # sufficiency gate of the word pipeline
MIN_SAMPLES = 4                # sufficiency gate of the demand forecast
MIN_WINDOWS_COMPARE = 10       # a grain with fewer windows is skipped in the comparison
VALIDATION_SHARE = 0.2
TOP_ITEMS_PER_MONTH = 10


@dataclass
class ForecastParams:
    freq: str = "monthly"
    target: str = "total_sales"
    lags: list[int] | None = None
    windows: list[int] | None = None
    sequence_length: int | None = None
    validation_share: float = VALIDATION_SHARE
    same_period_extras: bool = False   # True reproduces the reference's same-row extras
    min_windows: int = MIN_SAMPLES
    max_iter: int = 50
    seed: int = 42
    drop_partial_last: bool = False    # True leaves out a last period whose days the data don't reach the end of
    next_from_training: bool = False   # True predicts from the last training window, as the reference does: its target is known already
    scale_on_all: bool = False         # True fits the scalers on the validation windows too, as the reference does

    def resolved_lags(self) -> list[int]:
        return self.lags if self.lags is not None else LAG_PRESETS[self.freq]

    def resolved_windows(self) -> list[int]:
        return self.windows if self.windows is not None else ROLLING_PRESETS[self.freq]

    def resolved_sequence_length(self) -> int:
        return self.sequence_length or SEQUENCE_LENGTH_PRESETS[self.freq]
