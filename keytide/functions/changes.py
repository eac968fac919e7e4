"""Column expressions shared by the operators on change feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as stray blanks around an enum's spelling.
BLANKS = " \t\r\n "


def enum_name(col: Column) -> Column:
    """An enum's spelling without blanks, in capitals; null becomes the empty string."""
    return F.upper(F.btrim(F.coalesce(col, F.lit("")), F.lit(BLANKS)))


def is_delete(event_type: Column) -> Column:
    """Whether a change deletes its key: DELETE by name or by number 1.

    Absent, empty or any other spelling is the enum's zero value, a put. Never null.
    """
    return enum_name(event_type).isin("DELETE", "1")
