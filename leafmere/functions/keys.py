"""Document keys (UUIDv7 as 32 hexadecimal signs) and hybrid logical clocks (milliseconds << 16 | counter)."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_PATTERN = "^[0-9a-f]{12}7[0-9a-f]{3}[89ab][0-9a-f]{15}$"
MAX_DRIFT_MS = 60_000


def is_key(key: Column) -> Column:
    """Whether ``key`` is a well-formed document key; false for null."""
    return F.coalesce(key.rlike(KEY_PATTERN), F.lit(False))


def key_millis(key: Column) -> Column:
    """Milliseconds in a key's first 48 bits; null for a malformed key."""
    return F.when(is_key(key), F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint"))


def new_keys() -> Column:
    """A new key a row: the current time, then random bits."""
    bits = F.lower(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))
    millis = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    return F.concat(millis, F.lit("7"), F.substring(bits, 14, 3), F.substring(F.lit("89ab"), F.floor(F.rand() * 4).cast("int") + 1, F.lit(1)), F.substring(bits, 18, 15))


def sequence_key(n: Column) -> Column:
    """The n-th key of the deterministic sequence that tests use."""
    return F.concat(F.lit("00000000000070008000"), F.lpad(F.lower(F.hex(n.cast("bigint"))), 12, "0"))


def hlc_of(millis: Column, counter: Column) -> Column:
    return F.shiftleft(millis.cast("bigint"), 16).bitwiseOR(counter.cast("bigint").bitwiseAND(F.lit(65535)))


def hlc_millis(hlc: Column) -> Column:
    return F.shiftright(hlc, 16)


def hlc_counter(hlc: Column) -> Column:
    return hlc.bitwiseAND(F.lit(65535)).cast("int")


def hlc_time(hlc: Column) -> Column:
    return F.timestamp_millis(hlc_millis(hlc))


def hlc_hex(hlc: Column) -> Column:
    """16 hexadecimal signs that sort as the clock does."""
    return F.lpad(F.lower(F.hex(hlc)), 16, "0")


class Clock:
    """A writer's clock. ``now`` never repeats or goes back; ``observe`` follows another clock that is not too far ahead."""

    def __init__(self, last: int = 0, wall=lambda: time.time_ns() // 1_000_000):
        self.last, self.wall = last, wall

    def now(self) -> int:
        self.last = max(self.wall() << 16, self.last + 1)
        return self.last

    def observe(self, other: int) -> int:
        if (other >> 16) - self.wall() > MAX_DRIFT_MS:
            raise ValueError(f"clock {other} is more than {MAX_DRIFT_MS} ms ahead")
        self.last = max(self.wall() << 16, self.last + 1, other + 1)
        return self.last


def new_key(millis: int | None = None) -> str:
    """One new key, for the driver."""
    stamp = f"{millis if millis is not None else time.time_ns() // 1_000_000:012x}"
    bits = os.urandom(10).hex()
    return f"{stamp}7{bits[:3]}{'89ab'[int(bits[3], 16) % 4]}{bits[4:19]}"
