"""The holder of a frame that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from ..errors import ValidationError
from ..schema import check_frame, quoted, without_nan


class FeatureEngineeringBase:
    """Holds ``df``, with NaN as null. Frames are immutable, so nothing is copied.

    order_by: the columns that give rows an order, for operations that need one; best a unique key.
    """

    def __init__(self, df: DataFrame, order_by: str | list[str] | None = None):
        self.df = without_nan(check_frame(df))
        self.order_by = [order_by] if isinstance(order_by, str) else list(order_by or [])

    def get_dataframe(self) -> DataFrame:
        return self.df

    @property
    def spark(self):
        return self.df.sparkSession

    def _ordered(self, order_by: str | list[str] | None = None) -> list[Column]:
        names = [order_by] if isinstance(order_by, str) else list(order_by or self.order_by)
        if not names:
            raise ValidationError("rows of a Spark frame have no order: give order_by")
        return [quoted(c).asc_nulls_last() for c in names]

    def _window(self, order_by=None):
        return Window.orderBy(*self._ordered(order_by))

    def _done(self, df: DataFrame, inplace: bool):
        """The frame, or this object holding it."""
        if not inplace:
            return df
        self.df = df
        return self


