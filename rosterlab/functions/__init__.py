"""Column expressions: text, identifiers, numbers, matching."""

from . import ids, match, num, text  # noqa: F401
