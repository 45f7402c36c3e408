"""Errors by scope: a request, a mapping, a target's schema."""


class TabulonError(Exception):
    """Base of all errors raised on purpose."""


class InvalidMapping(TabulonError):
    """The mapping cannot be compiled; the run fails."""


class TargetSchemaError(TabulonError):
    """The target's tables do not fit the mapping; the run fails."""


class InvalidRequest(TabulonError):
    """What was asked for is not allowed (HTTP 400)."""

    status = 400


class NotFound(TabulonError):
    """No such connection, job or run (HTTP 404)."""

    status = 404


class Conflict(TabulonError):
    """Not in the present state, such as a running job (HTTP 409)."""

    status = 409


class Unreachable(TabulonError):
    """A source or target does not answer (HTTP 502)."""

    status = 502


class TransientError(TabulonError):
    """A failure that a retry may mend."""
