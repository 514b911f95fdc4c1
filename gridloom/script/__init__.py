"""A small matrix-style script language that lowers to Column expressions and matrix plans."""

from .interpreter import Interpreter, column

__all__ = ["Interpreter", "column"]
