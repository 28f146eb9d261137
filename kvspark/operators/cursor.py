"""A cursor in both directions over the live keys of a fixed state.

It fetches pages by key: the next page begins after the last key seen, in either direction,
so turning round is exact whatever the number of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.operators.resolve import visible


class Cursor:
    """Starts unpositioned. ``log`` has key, sort_key, seq, vtype and value. ``close``, or leaving a ``with`` block, lets go of what it pins."""

    def __init__(self, log: DataFrame, as_of: int, encode, page: int = 1000, release=None):
        self.log, self.as_of, self.encode, self.size, self.release = log, as_of, encode, page, release
        self.rows: list[tuple[bytes, bytes, bytes]] = []
        self.at = -1
        self.forward_page = True

    def _load(self, forward: bool, bound: bytes | None, inclusive: bool) -> None:
        rows = self.log
        if bound is not None:
            key = F.col("sort_key")
            rows = rows.filter((key >= F.lit(bound) if inclusive else key > F.lit(bound)) if forward else (key <= F.lit(bound) if inclusive else key < F.lit(bound)))
        live = visible(rows, self.as_of).orderBy(F.col("sort_key").asc() if forward else F.col("sort_key").desc()).limit(self.size)
        self.rows = [(bytes(r.sort_key), bytes(r.key), bytes(r.value)) for r in live.select("sort_key", "key", "value").collect()]  # one page
        self.at, self.forward_page = (0 if self.rows else -1), forward

    def seek_to_first(self) -> None:
        self._load(True, None, True)

    def seek_to_last(self) -> None:
        self._load(False, None, True)

    def seek(self, key: bytes) -> None:
        """To the first key at or after ``key``."""
        self._load(True, self.encode(key), True)

    def seek_for_prev(self, key: bytes) -> None:
        """To the last key at or before ``key``."""
        self._load(False, self.encode(key), True)

    def valid(self) -> bool:
        return 0 <= self.at < len(self.rows)

    def _step(self, forward: bool) -> None:
        if not self.valid():
            return
        k = self.at + (1 if forward == self.forward_page else -1)
        if 0 <= k < len(self.rows):
            self.at = k
        else:
            self._load(forward, self.rows[self.at][0], False)

    def next(self) -> None:
        self._step(True)

    def prev(self) -> None:
        self._step(False)

    def key(self) -> bytes:
        return self.rows[self.at][1]

    def value(self) -> bytes:
        return self.rows[self.at][2]

    def close(self) -> None:
        if self.release is not None:
            self.release()
        self.rows, self.at = [], -1

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def status(self) -> None:
        """Errors surface where they occur, so nothing is pending."""

    def forward(self) -> Iterator[tuple[bytes, bytes]]:
        """(key, value) from the current position on."""
        while self.valid():
            yield self.key(), self.value()
            self.next()
