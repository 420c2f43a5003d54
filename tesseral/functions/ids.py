"""Generated keys: prefixed ids and UUIDs of versions 4 and 7, for single rows and for columns."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefixed_id(accessor: str) -> str:
    """``post_<uuid4>`` for the table ``posts``: four characters of its singular, and a random part."""
    return f"{accessor.removesuffix('s')[:4]}_{uuid.uuid4()}"


def uuid_v7(now_ms: int | None = None) -> str:
    """Time-ordered UUID: 48 bits of Unix milliseconds, then version, variant and random bits."""
    stamp = int(time.time() * 1000) if now_ms is None else now_ms
    value = (stamp & (1 << 48) - 1) << 80 | int.from_bytes(os.urandom(10), "big")
    value = value & ~(0xF << 76) | 0x7 << 76
    return str(uuid.UUID(int=value & ~(0x3 << 62) | 0x2 << 62))


def uuid_v7_column() -> Column:
    """The same for each row of a DataFrame, in built-in functions: milliseconds in hex, then parts of a random UUID."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.uuid()
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(rest, 16, 21))


def prefixed_id_column(accessor: str) -> Column:
    return F.concat(F.lit(accessor.removesuffix("s")[:4] + "_"), F.uuid())
