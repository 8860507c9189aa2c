"""Commands as rows: each is answered by the transform registered under its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcome of a command, given its argument.
COMMANDS: dict[str, Callable[[Column], Column]] = {
    "delete": lambda a: F.lit("deleted"),
    "extract": lambda a: F.lit("extracted"),
    "rotate": lambda a: F.when(a.isin(90, 180, 270), F.concat(F.lit("rotated "), a.cast("string"))).otherwise("not a quarter turn"),
}


def dispatch(commands: DataFrame, name: str = "command", argument: str = "argument") -> DataFrame:
    """Adds `outcome`; a name that nothing is registered for says so, and stops no other row."""
    outcome = F.lit("unknown command")
    for key, answer in COMMANDS.items():
        outcome = F.when(F.col(name) == key, answer(F.col(argument))).otherwise(outcome)
    return commands.withColumn("outcome", outcome)
