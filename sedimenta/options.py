"""Settings of a table."""

from __future__ import annotations

from dataclasses import dataclass, replace

MIB = 1 << 20


@dataclass(frozen=True)
class Options:
    """Immutable settings; the fluent methods return changed copies."""

    root: str = ""
    memtable_bytes: int = 256 * MIB
    max_pending_batches: int = 5
    min_batches_to_flush: int = 2
    level_base_bytes: int = 2560 * MIB
    level_multiplier: int = 10
    target_file_bytes: int = 256 * MIB
    target_run_bytes: int = 64 * MIB
    num_levels: int = 6
    compression: str = "snappy"
    row_group_bytes: int = 128 * MIB
    false_positive_rate: float | None = 0.1
    wait_entries: int = 10
    wait_seconds: float = 0.05
    background: bool = True
    compactions_at_once: int = 4
    verify_on_open: bool = False
    retain_versions: int = 10

    def __post_init__(self):
        if not 2 <= self.num_levels <= 6:
            raise ValueError("num_levels must be 2 to 6")
        if self.false_positive_rate is not None and not 0 < self.false_positive_rate < 1:
            raise ValueError("false_positive_rate must lie between 0 and 1, or be None for no filter")
        if self.compression not in ("none", "snappy", "lz4_raw", "zstd", "gzip"):
            raise ValueError(f"unknown compression {self.compression!r}")
        if min(self.memtable_bytes, self.max_pending_batches, self.min_batches_to_flush, self.level_base_bytes, self.level_multiplier, self.target_file_bytes, self.target_run_bytes) < 1:
            raise ValueError("sizes and counts must be positive")

    def path(self, root: str) -> Options:
        return replace(self, root=root)

    def block_size(self, n: int) -> Options:
        return replace(self, row_group_bytes=n)

    def with_(self, **changes) -> Options:
        return replace(self, **changes)
