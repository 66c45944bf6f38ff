"""Typed failures. Each has a stable code; per-document failures carry it in an ``errors`` column."""

from __future__ import annotations


class RedactionError(Exception):
    code = "REDACTION_ERROR"

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code or type(self).code


class UnsupportedInput(RedactionError):
    code = "UNSUPPORTED_INPUT"


class UnknownTarget(RedactionError):
    code = "UNKNOWN_TARGET"


class ProviderFailure(RedactionError):
    code = "PROVIDER_ERROR"

    def __init__(self, message: str, provider: str):
        super().__init__(message)
        self.provider = provider


class MissingDependency(RedactionError):
    code = "MISSING_DEPENDENCY"

    def __init__(self, package: str, purpose: str):
        super().__init__(f"{package} is needed to {purpose}; install it on every executor")
        self.package = package


class ContextUnavailable(RedactionError):
    code = "CONTEXT_FAILED"
