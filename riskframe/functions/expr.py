"""Column expressions shared by all operators.

NULL is the only missing value in this engine. NaN is turned into NULL where
it can arise; infinities are kept, since a ratio with a zero denominator is a
meaningful (and later filtered) signal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def col(name: str) -> Column:
    """Column by literal name; names may hold dots, blanks, slashes or colons."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b`` with x/0 = signed infinity; 0/0 and missing sides are missing."""
    a, b = a.cast("double"), b.cast("double")
    return (
        F.when(b != 0, a / b)
        .when((b == 0) & (a > 0), F.lit(INF))
        .when((b == 0) & (a < 0), F.lit(-INF))
    )


def difference(a: Column, b: Column) -> Column:
    return a - b


def clamp_positive(c: Column) -> Column:
    """The value when it is above zero, otherwise 0; missing becomes 0."""
    return F.when(c > 0, c).otherwise(F.lit(0))


def sentinel_to_null(c: Column, sentinel) -> Column:
    return F.when(c != sentinel, c)


def differs(c: Column, value) -> Column:
    """``c != value`` where a missing value passes."""
    return ~c.eqNullSafe(F.lit(value))


def to_double(c: Column, default: float | None = None) -> Column:
    """Parse to double; text that is no number, and NaN, become ``default``."""
    parsed = nan_to_null(c.try_cast("double"))
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def finite(c: Column) -> Column:
    """The value when it is finite, otherwise missing."""
    return F.when(F.abs(c) < INF, c)


def label_text(c: Column) -> Column:
    return F.when(c == 0, "No Default").when(c == 1, "Default")


def status_text(prediction: Column) -> Column:
    return F.when(prediction == 1, "High Risk (Default)").otherwise("Low Risk (No Default)")


def digest(parts: Sequence[Column | str | int]) -> Column:
    """md5 of the parts joined by ``:``; the source of every pseudo-random choice.

    It depends on row values alone, so it is the same after a task is rerun
    and for every partitioning.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def unit_interval(hexdigest: Column) -> Column:
    """Map an md5 text to [0, 1) by its first eight hex digits."""
    return F.conv(F.substring(hexdigest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)) and f.name not in exclude
    ]


def integral_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType) and f.name not in exclude]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def bool_to_int(df: DataFrame) -> DataFrame:
    return df.withColumns({c: col(c).cast("int") for c in boolean_columns(df)})


def int_to_double(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({c: col(c).cast("double") for c in integral_columns(df, exclude)})


def select_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    wanted = set(numeric_columns(df)) | set(keep)
    return df.select(*[col(c) for c in df.columns if c in wanted])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def nan_frame_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, once, at the source."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(col(c)) for c in floats})


def combine(items: Sequence[Column], operation) -> Column:
    """Fold many columns pairwise; the expression is shallow, so planning stays fast."""
    level = list(items)
    while len(level) > 1:
        pairs = [operation(a, b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def chunks(items: Sequence, size: int):
    for start in range(0, len(items), size):
        yield items[start : start + size]
