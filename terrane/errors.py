"""Errors of this engine."""


class EngineError(Exception):
    """Base of all of them."""


class Closed(EngineError):
    """The engine was closed."""


class InvalidQuery(EngineError, ValueError):
    """A query that can't be run."""


class NotIndexed(EngineError, LookupError):
    """A path that the index doesn't hold."""


class UnsafePath(EngineError, ValueError):
    """A path that must not be changed."""


class IncompatibleSchema(EngineError):
    """A snapshot of a version that this engine doesn't read."""
