"""What a request can fail with; `code` is the name callers see."""

from __future__ import annotations


class RequestError(Exception):
    code = "ExecutionFailed"


class WireFormatError(RequestError):
    code = "WireFormat"


class ValidationError(RequestError):
    code = "Validation"


class StaleClient(RequestError):
    code = "StaleClient"


class Forbidden(RequestError):
    code = "Forbidden"


class NotFound(RequestError):
    code = "NotFound"


class TooLarge(RequestError):
    code = "PayloadTooLarge"


class SubscriptionLimit(RequestError):
    code = "SubscriptionLimit"


class CommandLimit(RequestError):
    code = "CommandLimit"
