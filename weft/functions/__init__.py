from weft.functions.columns import (fixed_decimals, flag_if, overdue_flag, risk_code, scala_string,
                                    scala_tuple)

__all__ = ["fixed_decimals", "flag_if", "overdue_flag", "risk_code", "scala_string", "scala_tuple"]
