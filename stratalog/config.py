"""Tuning constants of a store, all of them parameters."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20


@dataclass(frozen=True)
class StoreConfig:
    #: Flush when the memtable's size is at least this.
    flush_bytes: int = MIB
    #: A run is closed before the record that would take it beyond this.
    run_bytes: int = 2 * MIB
    #: Every so many records a run's sparse index has an entry. (A store's runs are Parquet files, whose page indexes do that.)
    index_interval: int = 16
    #: Level 0 is compacted when it has this many runs.
    level0_runs: int = 4
    #: Level L >= 1 is compacted when it holds more than level_base ** L * level_unit bytes.
    level_base: int = 10
    level_unit: int = MIB
    #: So long, in seconds, the files of a manifest version are kept after a newer one, for readers that have opened it.
    keep_seconds: float = 600.0
    #: False-positive rate and least number of expected keys of a run's key filter.
    bloom_rate: float = 0.05
    bloom_keys: int = 4096
    #: Size model: bytes of a put besides key and value, and of a delete besides its key.
    put_overhead: int = 20
    delete_overhead: int = 12

    def level_limit(self, level: int) -> int:
        return self.level_base**level * self.level_unit
