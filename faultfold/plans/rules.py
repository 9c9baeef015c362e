"""The default rule list.

Fixed values: keywords and labels, in the order in which the rules are tried.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    keywords: list[str]
    classification: str
    severity: str
    component: str
    fingerprint: str


DEFAULT_RULES = [
    Rule(
        ["postgres", "mysql", "connection", "timeout", "db"],
        "database_connection_timeout", "critical", "database", "database connection timeout",
    ),
    Rule(
        ["nullpointerexception", "nil pointer", "null pointer"],
        "null_pointer_exception", "high", "application", "null pointer dereference",
    ),
    Rule(
        ["oom", "out of memory", "oom killer"],
        "out_of_memory", "critical", "runtime", "process killed by oom killer",
    ),
    Rule(
        ["panic", "runtime error", "index out of range", "goroutine"],
        "runtime_panic", "critical", "application", "go runtime panic",
    ),
    Rule(
        ["500", "503", "upstream", "retry"],
        "upstream_service_error", "high", "http-client",
        "upstream service returned 5xx after retries",
    ),
    Rule(
        ["redis", "lock", "distributed lock"],
        "distributed_lock_failure", "high", "redis", "failed to acquire distributed lock",
    ),
    Rule(
        ["ssl", "certificate", "tls", "handshake"],
        "tls_certificate_error", "critical", "tls", "ssl certificate error",
    ),
    Rule(
        ["disk", "no space", "write failed"],
        "disk_full", "critical", "storage", "disk write failed no space left",
    ),
    Rule(
        ["kafka", "consumer", "lag"],
        "kafka_consumer_lag", "high", "kafka", "kafka consumer lag exceeded threshold",
    ),
    Rule(
        ["authentication", "access denied", "auth failed"],
        "authentication_failure", "medium", "auth", "database authentication failure",
    ),
    Rule(
        ["slow query", "4823ms", "query"],
        "slow_database_query", "medium", "database", "slow database query detected",
    ),
    Rule(
        ["circuit breaker", "open", "failures"],
        "circuit_breaker_open", "high", "circuit-breaker",
        "circuit breaker opened for downstream service",
    ),
    Rule(
        ["s3", "putobject", "requesttimeout"],
        "s3_timeout", "high", "s3", "s3 put object request timeout",
    ),
    Rule(
        ["grpc", "unavailable", "connection refused"],
        "grpc_connection_refused", "high", "grpc", "grpc call failed connection refused",
    ),
    Rule(
        ["queue overflow", "pending jobs", "dropping"],
        "task_queue_overflow", "high", "task-queue", "task queue overflow jobs dropped",
    ),
]

FALLBACK = Rule([], "unknown_error", "medium", "unknown", "unclassified error")


def effective_keywords(rules: list[Rule]) -> list[list[str]]:
    """Keywords that can decide something.

    A keyword that contains an earlier one never adds a hit: wherever it occurs, the earlier
    one does too. Dropping it saves a pass over the text.
    """
    kept: list[list[str]] = []
    seen: list[str] = []
    for rule in rules:
        own = []
        for word in rule.keywords:
            if not any(earlier in word for earlier in seen):
                own.append(word)
                seen.append(word)
        kept.append(own)
    return kept
