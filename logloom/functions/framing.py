"""Record framing: u64 offset, i64 milliseconds, key flag, [u32 key length, key], u32 payload length, payload; little-endian."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian_hex(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def epoch_millis(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def frame_hex(offset: Column, ts: Column, key: Column, payload: Column) -> Column:
    """The frame in lower-case hex digits."""
    payload = payload.cast("binary")
    with_key = F.concat(F.lit("01"), little_endian_hex(F.octet_length(key), 4), F.hex(F.encode(key, "UTF-8")))
    return F.lower(F.concat(little_endian_hex(offset, 8), little_endian_hex(epoch_millis(ts), 8), F.coalesce(with_key, F.lit("00")), little_endian_hex(F.octet_length(payload), 4), F.hex(payload)))


def frame(offset: Column, ts: Column, key: Column, payload: Column) -> Column:
    return F.unhex(frame_hex(offset, ts, key, payload))


def parse(data: bytes) -> tuple[list[tuple[int, int, str | None, bytes]], int]:
    """Whole records of a segment, and how many bytes they take; what follows is a cut-off tail."""
    view, at, out = memoryview(data), 0, []
    size = len(view)
    while at + 17 <= size:
        offset, millis, flag = struct.unpack_from("<QqB", view, at)
        p, key = at + 17, None
        if flag == 1:
            if p + 4 > size:
                break
            n = struct.unpack_from("<I", view, p)[0]
            if p + 4 + n > size:
                break
            key = bytes(view[p + 4 : p + 4 + n]).decode("utf-8", "replace")
            p += 4 + n
        if p + 4 > size:
            break
        n = struct.unpack_from("<I", view, p)[0]
        if p + 4 + n > size:
            break
        out.append((offset, millis, key, bytes(view[p + 4 : p + 4 + n])))
        at = p + 4 + n
    return out, at
