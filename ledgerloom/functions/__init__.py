"""Column expressions and library functions."""

from . import keys, merge, text, tickets, vectors

__all__ = ["keys", "merge", "text", "tickets", "vectors"]
