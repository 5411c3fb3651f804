"""CRC-32C of binary columns, by Arrow batches: Spark's own crc32 has another polynomial."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

POLYNOMIAL = 0x82F63B78  # fixed value: Castagnoli's, reflected
LANE = 256  # bytes


def _stepped(register: np.ndarray, table: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        register = table[register & 255] ^ (register >> 8)
    return register


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ (t & 1) * np.uint32(POLYNOMIAL)
    return t


TABLE = _table()
#: By byte of a register, what it becomes after a lane of zeros; a register's four are xored, as the sum is linear.
PAST_LANE = [_stepped(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), TABLE, LANE) for k in range(4)]


def checksums(blobs: Iterable[bytes | None]) -> list[int | None]:
    """Each blob is cut into lanes that end with it, zeros before the first; all lanes of all blobs go forward side by side and are
    then put together lane by lane. Zeros before the data don't change a register of zero, so the start value is xored into the data."""
    blobs = [None if b is None else bytes(b) for b in blobs]
    data = [(b or b"").ljust(4, b"\0") for b in blobs]  # the start value covers four bytes; shorter ones are done apart
    lanes = np.array([-(-len(b) // LANE) for b in data], dtype=np.int64)
    first = np.cumsum(lanes) - lanes
    flat = np.zeros(int(lanes.sum()) * LANE, dtype=np.uint8)
    for b, f, n in zip(data, first.tolist(), lanes.tolist(), strict=True):
        at = (f + n) * LANE - len(b)
        flat[at : at + len(b)] = np.frombuffer(b, dtype=np.uint8)
        flat[at : at + 4] ^= 255
    register = np.zeros(int(lanes.sum()), dtype=np.uint32)
    for column in np.ascontiguousarray(flat.reshape(-1, LANE).T):
        register = TABLE[(register ^ column) & 255] ^ (register >> 8)
    order = np.argsort(-lanes, kind="stable")  # the longest first, so that those still going on are a prefix
    going, total = lanes[order], np.zeros(len(data), dtype=np.uint32)
    for k in range(int(lanes.max(initial=0))):
        live = order[: int(np.searchsorted(-going, -k, side="left"))]
        held = total[live]
        moved = PAST_LANE[0][held & 255] ^ PAST_LANE[1][held >> 8 & 255] ^ PAST_LANE[2][held >> 16 & 255] ^ PAST_LANE[3][held >> 24]
        total[live] = moved ^ register[first[live] + k]
    done = (total ^ np.uint32(0xFFFFFFFF)).tolist()
    return [None if b is None else _short(b) if len(b) < 4 else x for b, x in zip(blobs, done, strict=True)]


def _short(b: bytes) -> int:
    register = 0xFFFFFFFF
    for x in b:
        register = int(TABLE[(register ^ x) & 255]) ^ (register >> 8)
    return register ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def _crc32c(data: pd.Series) -> pd.Series:
    return pd.Series(checksums(data), dtype="Int64")


def crc32c(data: Column) -> Column:
    """The unsigned CRC-32C of a binary column; null for null."""
    return _crc32c(data)
