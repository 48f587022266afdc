"""A column together with the type it has in its table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Operand:
    column: Column
    dtype: T.DataType

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, (T.StringType, T.CharType, T.VarcharType))

    @property
    def is_bool(self) -> bool:
        return isinstance(self.dtype, T.BooleanType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.dtype, T.NumericType)

    @property
    def is_float(self) -> bool:
        return isinstance(self.dtype, (T.DoubleType, T.FloatType))

    @property
    def is_array(self) -> bool:
        return isinstance(self.dtype, T.ArrayType)

    @property
    def is_void(self) -> bool:
        return isinstance(self.dtype, T.NullType)

    @property
    def family(self) -> str:
        """Values of different families are never equal."""
        if self.is_number or self.is_bool:
            return "number"
        if self.is_text:
            return "text"
        if isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType)):
            return "timestamp"
        return self.dtype.typeName()


def operand(df: DataFrame, name: str) -> Operand:
    """The operand for a column of ``df``; quoted, so names such as ``0_val_a`` work."""
    return Operand(F.col(quoted(name)), df.schema[name].dataType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
