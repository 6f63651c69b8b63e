"""Errors. Argument errors are raised; troubles with single columns are logged and the column is skipped."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException, NumberFormatException


class MLToolkitError(Exception):
    """Root of all errors of this library."""


class ValidationError(MLToolkitError):
    """An argument or the data can't be used."""


class ColumnNotFoundError(ValidationError):
    def __init__(self, column_name: str, available_columns: list[str] | None = None):
        self.column_name, self.available_columns = column_name, list(available_columns or [])
        hint = f"; there are {self.available_columns}" if self.available_columns else ""
        super().__init__(f"no column {column_name!r}{hint}")


class InvalidStrategyError(ValidationError):
    def __init__(self, strategy: str, valid_strategies: list[str]):
        self.strategy, self.valid_strategies = strategy, list(valid_strategies)
        super().__init__(f"strategy {strategy!r} is none of {self.valid_strategies}")


class InvalidMethodError(ValidationError):
    def __init__(self, method: str, valid_methods: list[str]):
        self.method, self.valid_methods = method, list(valid_methods)
        super().__init__(f"method {method!r} is none of {self.valid_methods}")


class DataTypeError(ValidationError):
    def __init__(self, message: str, column: str | None = None, expected: str | None = None, actual: str | None = None):
        self.column, self.expected, self.actual = column, expected, actual
        super().__init__(message)


class EmptyDataFrameError(ValidationError):
    def __init__(self, message: str = "the frame has no rows"):
        super().__init__(message)


class InsufficientDataError(ValidationError):
    def __init__(self, message: str, required: int | None = None, actual: int | None = None):
        self.required, self.actual = required, actual
        super().__init__(message)


class ConstantColumnError(ValidationError):
    def __init__(self, column_name: str):
        self.column_name = column_name
        super().__init__(f"column {column_name!r} has a single value")


class TransformerNotFittedError(MLToolkitError):
    def __init__(self, message: str = "nothing has been fitted yet"):
        super().__init__(message)


#: What data or arguments cause; a lost executor or a lack of memory is none of these.
DATA_FAULTS = (MLToolkitError, ValueError, TypeError, LookupError, ArithmeticError, AnalysisException, ArithmeticException, IllegalArgumentException, NumberFormatException)
