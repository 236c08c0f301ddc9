"""Configuration dataclasses and fixed values.

Parameters are frozen dataclasses passed explicitly into operators; nothing
reads global state and no operator calls ``current_timestamp()``: every time
dependent operator takes an explicit ``as_of``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the behaviour being reproduced (lists,
# patterns, texts and defaults).  Kept together, in their natural order.
# ---------------------------------------------------------------------------

# Security: key fragments for contains-match masking, exact sensitive keys for
# request bodies, exact sensitive header names.
MASK_PATTERNS = ("password", "token", "secret", "api_key", "credit_card", "ssn")
SENSITIVE_KEYS = (
    "password",
    "password_confirmation",
    "secret",
    "token",
    "api_key",
    "access_token",
    "refresh_token",
    "private_key",
)
SENSITIVE_HEADERS = (
    "authorization",
    "x-api-key",
    "password",
    "secret",
    "token",
    "cookie",
    "x-csrf-token",
)
MASK_STRING = "***REDACTED***"
KEY_REDACTED = "[REDACTED]"

# Typed-tag PII patterns, applied in this order (email, phone, ip).
TAG_PATTERNS = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"\+?[1-9]\d{1,14}"),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
)

# Partial-mask PII patterns, applied in this order: ip, email, phone.
PII_IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PII_EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PII_PHONE_PATTERN = r"\+[1-9]\d{7,14}"

# Secret masking in free text, applied in this order ($1 keeps the prefix).
SECRET_PATTERNS = (
    (r"(password=)[^\s&]+", "$1" + MASK_STRING),
    (r"(token=)[^\s&]+", "$1" + MASK_STRING),
    (r"(api_key=)[^\s&]+", "$1" + MASK_STRING),
    (r"(Authorization:\s*Bearer\s+)\S+", "$1" + MASK_STRING),
    (r"(Authorization:\s*Basic\s+)\S+", "$1" + MASK_STRING),
    (r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "****-****-****-****"),
)

# Query-text sanitising, applied in this order.
SQL_SANITIZE_PATTERNS = (
    (r'"([^"]+)"', "[value]"),
    (r"`([^`]+)`\s*=", "[column] ="),
    (r"`([^`]+)`", "[table]"),
    (r"\b(FROM|JOIN|INTO|UPDATE)\s+([a-zA-Z_]\w*)", "$1 [table]"),
)

# Error categories by status code.
CATEGORIES = (
    ("client_error", (400, 401, 403, 404, 422, 429)),
    ("server_error", (500, 502, 503, 504)),
    ("critical", (500, 502)),
    ("recoverable", (400, 422, 429)),
)
CRITICAL_STATUS = (500, 502)

# Status-code defaults.
STATUS_DEFAULT = 500
STATUS_VALIDATION = 422
VALIDATION_EXCEPTION = "ValidationException"
VALIDATION_TITLE = "Validation Failed"
VALIDATION_ITEM_TITLE = "Validation Error"
VALIDATION_MESSAGE = "Validation failed"

# GraphQL: metadata members that are not repeated among the extensions.
GRAPHQL_LIFTED = ("locations", "line", "column", "path")
# Causes rendered before the chain is cut off.
CAUSES_DEPTH = 6

# HTTP titles (default "Error").
STATUS_TITLES = (
    (400, "Bad Request"),
    (401, "Unauthorized"),
    (403, "Forbidden"),
    (404, "Not Found"),
    (422, "Unprocessable Entity"),
    (429, "Too Many Requests"),
    (500, "Internal Server Error"),
    (502, "Bad Gateway"),
    (503, "Service Unavailable"),
    (504, "Gateway Timeout"),
)

# Transient classification: patterns in a message (any case) and status codes.
TRANSIENT_PATTERNS = ("timeout", "connection", "network", "temporary", "temporarily", "503", "502", "504", "429")
TRANSIENT_STATUS = (429, 502, 503, 504)

# Recovery suggestions: first keyword contained in the lower-cased message wins.
SUGGESTIONS = (
    (
        "timeout",
        "The operation timed out. Consider increasing the timeout or optimizing the request.",
        ("Try again with a longer timeout", "Check if the request payload can be optimized", "Verify network connectivity"),
    ),
    (
        "connection",
        "Connection to the service failed. The service may be temporarily unavailable.",
        ("Retry the operation in a few moments", "Check service status", "Verify network configuration"),
    ),
    (
        "rate_limit",
        "Rate limit exceeded. Too many requests were made in a short period.",
        ("Wait before retrying", "Implement exponential backoff", "Consider reducing request frequency"),
    ),
    (
        "authentication",
        "Authentication failed. Invalid or expired credentials.",
        ("Refresh authentication tokens", "Verify API credentials", "Check token expiration"),
    ),
    (
        "validation",
        "Request validation failed. The request data is invalid.",
        ("Check request format", "Validate required fields", "Review API documentation"),
    ),
)
GENERAL_SUGGESTION = (
    "general",
    "An unexpected error occurred. Please try again or contact support if the problem persists.",
    ("Retry the operation", "Check service status", "Contact support team"),
)
NON_RECOVERABLE_SUGGESTION = (
    "non_recoverable",
    "This error cannot be automatically recovered. Please contact support.",
    ("Check the request parameters", "Verify your permissions", "Contact support team if the problem persists"),
)
CRITICAL_ERROR_CODES = ("DATABASE_CONNECTION_FAILED", "EXTERNAL_SERVICE_UNAVAILABLE", "TIMEOUT_ERROR")

# Default fallbacks when no strategy is registered.
FALLBACK_TRANSIENT = (
    "transient_error",
    "Service temporarily unavailable",
    "The service is experiencing temporary issues. Please try again later.",
    60,
)
FALLBACK_PERMANENT = (
    "permanent_error",
    "Service unavailable",
    "The service is currently unavailable. Please contact support if the problem persists.",
    None,
)

# Standard error catalogue: code, status, title, description, example.
ERROR_CATALOGUE = (
    ("BAD_REQUEST", 400, "Bad Request", "The request was invalid or malformed", "Invalid JSON payload"),
    ("UNAUTHORIZED", 401, "Unauthorized", "Authentication is required to access this resource", "Missing or invalid API token"),
    ("FORBIDDEN", 403, "Forbidden", "You do not have permission to access this resource", "Insufficient privileges"),
    ("RESOURCE_NOT_FOUND", 404, "Not Found", "The requested resource does not exist", "User ID not found"),
    ("VALIDATION_FAILED", 422, "Validation Failed", "The request data failed validation", "Email field is required"),
    ("RATE_LIMIT_EXCEEDED", 429, "Rate Limit Exceeded", "Too many requests, please slow down", "Maximum 100 requests per minute"),
    ("SERVER_ERROR", 500, "Internal Server Error", "An unexpected error occurred on the server", "Database connection failed"),
)

# Validation code rules: first contained word wins.
VALIDATION_CODES = (
    ("required", "FIELD_REQUIRED"),
    ("email", "INVALID_EMAIL"),
    ("numeric", "MUST_BE_NUMERIC"),
    ("string", "MUST_BE_STRING"),
)
VALIDATION_DEFAULT_CODE = "VALIDATION_ERROR"

PROBLEM_TYPE_PREFIX = "https://api.example.com/errors/"
GENERIC_MESSAGE = "An error occurred."
HIDDEN_MESSAGE = "An error occurred while processing your request."

# Breaker and retry defaults.
BREAKER_FAILURE_THRESHOLD = 5
BREAKER_RECOVERY_TIMEOUT_S = 60
BREAKER_SUCCESS_THRESHOLD = 3
RETRY_MAX = 3
RETRY_BASE_DELAY_MS = 1000
RETRY_MULTIPLIER = 2.0
RETRY_MAX_DELAY_MS = 10000

# Paging and windows.
PAGE_SIZE_DEFAULT = 25
PAGE_SIZE_MAX = 100
ANALYTICS_DAYS_DEFAULT = 7
LIVE_FEED_LIMIT = 50
RETENTION_DAYS = 30


@dataclass(frozen=True)
class Rule:
    """One step of a text mask: matches of ``pattern`` become ``replacement`` ($1 is the first group), or, where that is
    None, the partial mask of the ``kind`` (ip, email or phone)."""

    kind: str
    pattern: str
    replacement: str | None = None


#: Rules in the order in which they apply.
SECRET_RULES = tuple(Rule("secret", p, r) for p, r in SECRET_PATTERNS)
PII_RULES = (Rule("ip", PII_IP_PATTERN), Rule("email", PII_EMAIL_PATTERN), Rule("phone", PII_PHONE_PATTERN))
TAG_RULES = tuple(Rule(kind, p, f"[{kind}:REDACTED]") for kind, p in TAG_PATTERNS)


@dataclass(frozen=True)
class RedactionConfig:
    mask_sensitive_data: bool = True
    pii_redaction: bool = True
    mask_patterns: tuple[str, ...] = MASK_PATTERNS
    sensitive_keys: tuple[str, ...] = SENSITIVE_KEYS
    sensitive_headers: tuple[str, ...] = SENSITIVE_HEADERS
    sanitize_sql: bool = True
    production: bool = True
    secret_rules: tuple[Rule, ...] = SECRET_RULES
    pii_rules: tuple[Rule, ...] = PII_RULES


@dataclass(frozen=True)
class BreakerConfig:
    failure_threshold: int = BREAKER_FAILURE_THRESHOLD
    recovery_timeout_s: int = BREAKER_RECOVERY_TIMEOUT_S
    success_threshold: int = BREAKER_SUCCESS_THRESHOLD


@dataclass(frozen=True)
class RetryConfig:
    max_retries: int = RETRY_MAX
    base_delay_ms: int = RETRY_BASE_DELAY_MS
    multiplier: float = RETRY_MULTIPLIER
    max_delay_ms: int | None = None  # optional cap, off by default


@dataclass(frozen=True)
class RenderConfig:
    include_error_id: bool = True
    include_timestamp: bool = True
    include_suggestions: bool = True
    include_error_codes: bool = True
    include_request_id: bool = True
    include_user_info: bool = False
    include_debug: bool = False
    include_trace: bool = False
    include_exception_chain: bool = False
    hide_message: bool = False
    type_prefix: str = PROBLEM_TYPE_PREFIX
    redaction: RedactionConfig = field(default_factory=RedactionConfig)
