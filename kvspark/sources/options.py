"""Options of a table, of reads, of writes and of flushes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from kvspark.functions.keys import BYTEWISE, KeyOrder

if TYPE_CHECKING:
    from kvspark.operators.compaction import CompactionFilter

CODECS = ("none", "snappy", "zstd")


@dataclass
class Options:
    """max_file_size is the goal for files of a compaction, write_buffer_size the bytes of unflushed writes that start a flush.

    retention_seconds: how long files that are out of use stay, for scans that were made before. pin_seconds: how long a
    snapshot or cursor holds if its process never gives it back.

    ``max_open_files``, ``block_restart_interval`` and ``block_cache_bytes`` are accepted and have no effect: Parquet and Spark
    decide those.
    """

    create_if_missing: bool = False
    error_if_exists: bool = False
    paranoid_checks: bool = False
    write_buffer_size: int = 4 << 20
    max_open_files: int = 1000
    block_size: int = 4 << 10
    block_restart_interval: int = 16
    max_file_size: int = 128 << 20
    compression: str = "snappy"
    zstd_level: int = 1
    reuse_logs: bool = False
    bloom_bits_per_key: int | None = None
    bloom_keys: int = 1_000_000
    block_cache_bytes: int = 8 << 20
    key_order: KeyOrder = BYTEWISE
    compaction_filter: CompactionFilter | None = None
    retention_seconds: float = 600.0
    pin_seconds: float = 86_400.0

    def parquet(self) -> dict[str, str]:
        """Write options of a Parquet file. Bloom filters are on the sort key."""
        out = {"compression": self.compression, "parquet.page.size": str(max(self.block_size, 1 << 16)), "parquet.page.write-checksum.enabled": "true"}
        if self.compression == "zstd":
            out["parquet.compression.codec.zstd.level"] = str(min(22, max(1, self.zstd_level)))
        if self.bloom_bits_per_key:
            out |= {"parquet.bloom.filter.enabled#sort_key": "true", "parquet.bloom.filter.expected.ndv#sort_key": str(self.bloom_keys), "parquet.bloom.filter.fpp#sort_key": f"{0.6185 ** self.bloom_bits_per_key:.6f}"}
        return out


@dataclass
class ReadOptions:
    verify_checksums: bool = False
    fill_cache: bool = True
    snapshot: object | None = None


@dataclass
class WriteOptions:
    sync: bool = False  # a commit is always durable


@dataclass
class FlushOptions:
    wait: bool = True
