"""Business rules and tunables, passed as arguments; nothing here reads the environment."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
EVENT_REQUIRED = ("event_id", "user_id", "event_type", "timestamp")
EVENT_TYPES = ("page_view", "click", "purchase", "signup")
TRANSFER_REQUIRED = ("txn_id", "account_id", "payee_id", "amount", "timestamp", "currency")
CURRENCIES = ("SGD", "USD", "EUR", "GBP")
HOLD_REASON = "account under active drain alert"
WINDOW_MINUTES = 10
MAX_COUNT = 3
MAX_AMOUNT = 5000.0
PAYEE_THRESHOLD = 1000.0
SPIKE_FACTOR = 5.0
MIN_HISTORY = 3
START_HOUR = 2
END_HOUR = 5
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class EventRules:
    allowed_types: tuple[str, ...] = EVENT_TYPES


@dataclass(frozen=True)
class TransferRules:
    currencies: tuple[str, ...] = CURRENCIES


@dataclass(frozen=True)
class DetectorParams:
    """Thresholds of the four rules."""

    window_minutes: int = WINDOW_MINUTES
    max_count: int = MAX_COUNT
    max_amount: float = MAX_AMOUNT
    payee_threshold: float = PAYEE_THRESHOLD
    spike_factor: float = SPIKE_FACTOR
    min_history: int = MIN_HISTORY
    start_hour: int = START_HOUR
    end_hour: int = END_HOUR

    @property
    def window_micros(self) -> int:
        return self.window_minutes * 60 * 1_000_000


@dataclass(frozen=True)
class SkewParams:
    """When an account's history is split over several tasks.

    Accounts with more than `hot_rows` transfers are split into blocks of
    `block_rows` consecutive log offsets, so a block never holds more rows than
    that. Up to `hot_keys` names of such accounts are broadcast, more are joined
    by shuffle with salts.
    `slices` bounds how many runs of the time order the hot rows are cut into.
    """

    hot_rows: int = 1 << 20
    hot_keys: int = 1 << 16
    block_rows: int = 1 << 20
    slices: int = 1 << 16
