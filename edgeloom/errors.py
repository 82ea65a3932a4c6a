"""Typed refusals: an answer that would not be sound is refused, not guessed."""


class RefusedError(RuntimeError):
    """The index cannot support the question (missing contract, unknown kinds, unknown root, missing tables)."""


class LoadError(ValueError):
    """Input records break the loader's rules; nothing is loaded."""
