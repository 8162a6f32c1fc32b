"""Validation codes as column expressions: null where a value is fine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import schemas

NAME_PATTERN = "^[A-Za-z0-9._-]+$"


def payload_code(payload: Column) -> Column:
    size = F.octet_length(payload)
    return F.when(size == 0, "EMPTY_PAYLOAD").when(size > schemas.MAX_PAYLOAD_BYTES, "PAYLOAD_TOO_LARGE")


def _name_code(name: Column, most: int) -> Column:
    size = F.octet_length(name)
    return F.when(size == 0, "EMPTY_TOPIC_NAME").when(size > most, "TOPIC_NAME_TOO_LONG").when(~name.rlike(NAME_PATTERN) | name.endswith("\n"), "INVALID_TOPIC_CHAR")


def topic_code(name: Column) -> Column:
    return _name_code(name, schemas.MAX_TOPIC_BYTES)


def connector_code(name: Column) -> Column:
    """Connector ids share the topic codes."""
    return _name_code(name, schemas.MAX_CONNECTOR_BYTES)


def config_code(partitions: Column, segment_max_records: Column) -> Column:
    return F.when(partitions == 0, "ZERO_PARTITIONS").when(segment_max_records == 0, "ZERO_SEGMENT_SIZE")
