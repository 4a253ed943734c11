"""The engine's exception and its codes."""

from __future__ import annotations

#: Codes in use. Fixed values.
CODES = (
    "QUERY_PARSE_ERROR", "ADAPTER_NOT_FOUND", "ADAPTER_EXISTS", "AUTH_REQUIRED", "GRAYLOG_SEARCH_ERROR", "GRAYLOG_STREAMS_ERROR",
    "LOKI_QUERY_ERROR", "LOKI_LABELS_ERROR", "WEBSOCKET_MAX_RETRIES", "PROMQL_PARSE_ERROR", "PROMQL_QUERY_ERROR",
)


class CorrelationError(Exception):
    """An error with a code and, where there are any, details."""

    def __init__(self, message: str, code: str, details: object = None):
        super().__init__(message)
        self.message, self.code, self.details = message, code, details
