"""Refusals: every operation turns invalid input away with a stable code instead of guessing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Refused(ValueError):
    def __init__(self, code: str, message: str, arg: str | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.arg = code, arg


def refuse_when(bad: Column, code: str, message: str, value: Column) -> Column:
    """``value``, unless ``bad`` holds: then the query fails with the code. Use on results only, where no filter can hide it."""
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"{code}: {message}"))).otherwise(value)


def choice(value: str, allowed, arg: str) -> str:
    if value not in allowed:
        raise Refused("NOT_A_CHOICE", f"{value!r} is none of {', '.join(allowed)}", arg)
    return value


def whole(value, arg: str, least: int = 1) -> int:
    if isinstance(value, bool) or value != int(value) or value < least:
        raise Refused("NOT_A_COUNT", f"{value!r} is no whole number of {least} or more", arg)
    return int(value)
