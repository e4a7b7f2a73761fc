"""Errors of schemas and queries."""


class WeftError(ValueError):
    """An error with a stable kind, such as ``UnknownField``."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind
