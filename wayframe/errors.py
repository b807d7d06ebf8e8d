"""Errors that callers may want to tell apart."""


class PlanError(ValueError):
    """The traversal is not valid."""


class NotFound(KeyError):
    """No element, job, graph or index of this name."""
