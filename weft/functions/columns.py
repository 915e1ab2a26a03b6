"""Scalar Column expressions (JVM side, inside whole-stage codegen; no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def overdue_flag(*dpd: str | Column) -> Column:
    """``case when (d7 = '1' or d15 = '1' or d30 = '1' or d90 = '1') then 1 else 0 end``.

    Three-valued logic as in SQL: a NULL comparison makes the OR NULL unless another
    term is true, and a NULL condition falls to the ELSE branch (0)."""
    cond = None
    for d in dpd:
        term = col(d) == F.lit("1")
        cond = term if cond is None else (cond | term)
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def flag_if(condition: Column) -> Column:
    """1 when the condition holds, else 0 (NULL counts as false)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def risk_code(end_result: str | Column, overdue: str | Column, passed: str = "0", rejected: str = "1",
              overdue_value: str = "1") -> Column:
    """Per-vertex class: passed and overdue 11, passed and not overdue 22, rejected 33,
    anything else NULL (the pattern match had no branch for it)."""
    er, od = col(end_result).cast("string"), col(overdue).cast("string")
    return (F.when((er == passed) & (od == overdue_value), F.lit(11))
            .when(er == passed, F.lit(22))
            .when(er == rejected, F.lit(33)))


def scala_string(c: str | Column) -> Column:
    """Text of a value as a JVM ``toString`` prints it: NULL becomes ``null``."""
    return F.coalesce(col(c).cast("string"), F.lit("null"))


def scala_tuple(*cols: str | Column) -> Column:
    """``(a,b,...)`` as a Scala tuple prints."""
    return F.concat(F.lit("("), F.concat_ws(",", *[scala_string(c) for c in cols]), F.lit(")"))


def fixed_decimals(c: str | Column, digits: int = 9) -> Column:
    """``x.formatted("%.9f")``."""
    return F.format_string(f"%.{digits}f", col(c))
