"""Errors raised on the driver; row-level problems become columns or rows of a report instead."""


class TesseraError(Exception):
    """Base of the library's errors."""


class SchemaError(TesseraError, ValueError):
    """An invalid schema, an unknown type, or a change that isn't allowed."""


class FormatError(TesseraError, ValueError):
    """Stored bytes that aren't what they should be."""


class DataError(TesseraError, ValueError):
    """Input that breaks an operator's precondition."""
