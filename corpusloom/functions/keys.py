"""Key normalisation and joins that stay balanced under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key above which a join splits it.  A million million rows have at most a million such keys.
SPLIT_ROWS = 1_000_000


def norm_id(col: str | Column) -> Column:
    """Identifier for comparison: blanks trimmed, lower case, blank becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lower(F.btrim(c, F.lit(" \t\r\n")))
    return F.when(out != "", out)


def strip(col: str | Column) -> Column:
    """Text without white space at its ends (blanks, tabs, line ends, no-break spaces and the other Unicode spaces)."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", "")


def join_verdicts(rows: DataFrame, verdicts: DataFrame, keys: list[str], weight: str, split: int = SPLIT_ROWS) -> DataFrame:
    """Inner-join *rows* with one-row-per-key *verdicts* without a hot task.

    A key whose *weight* (its number of rows) exceeds *split* is salted: its rows
    are spread over parts by a hash of the row, and its verdict is repeated for each part.  Only these keys are
    broadcast, and the rows are read once.
    """
    parts = F.greatest(F.ceil(F.col(weight) / split), F.lit(1)).cast("int")
    hot = verdicts.where(F.col(weight) > split).select(*keys, parts.alias("_parts"))
    hashable = [c for c in rows.columns if "map<" not in rows.schema[c].dataType.simpleString()]
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashable]), F.col("_parts")).cast("int"), F.lit(0))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    spread = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")
