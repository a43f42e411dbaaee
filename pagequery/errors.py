"""Errors of the engine."""


class SelectionError(ValueError):
    """An expression that cannot be read, or that a document cannot answer."""


class PatternError(ValueError):
    """An extraction pattern, trimmer or template that cannot be read."""


class ConflictError(Exception):
    """Outputs that exist already; paths holds them."""

    def __init__(self, message: str, paths=()):
        super().__init__(message)
        self.paths = list(paths)
