"""Schemas, options and error codes of the log."""

from __future__ import annotations

import dataclasses

#: Limits of the data model.
MAX_PAYLOAD_BYTES = 1_048_576
MAX_TOPIC_BYTES = 255
MAX_CONNECTOR_BYTES = 128
DEFAULT_SEGMENT_RECORDS = 1024
DEFAULT_MAX_RECORDS = 1_000_000

LOG = "topic string, partition int, segment_base long, offset long, timestamp timestamp_ntz, key string, payload binary"
TOPICS = "name string, partitions int, segment_max_records long, max_records long"
CHECKPOINTS = "connector string, topic string, partition int, offset long, version long"
DEAD_LETTERS = "connector string, topic string, partition int, offset long, payload binary, reason string, attempts int, failed_at timestamp"
STATUSES = "id string, kind string, guarantee string, running boolean, processed long, dead_lettered long, checkpoint long, version long"
EVENTS = "kind string, topic string, partition int, offset long, count int"

#: Error classes that may be retried.
RETRYABLE = ("unavailable", "transient")


@dataclasses.dataclass(frozen=True)
class LogOptions:
    max_topics: int = 1024
    default_partitions: int = 3
    rate_per_second: float = 1_000_000.0
    burst: int = 100_000
    fetch_max: int = 1024


@dataclasses.dataclass(frozen=True)
class SinkOptions:
    guarantee: str = "at_least_once"
    max_attempts: int = 3
    batch_size: int = 500
    base_backoff_ms: int = 20
    max_backoff_ms: int = 1000


class LogError(Exception):
    """A rejected command; ``code`` is stable."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code
