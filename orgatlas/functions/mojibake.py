"""Repair of UTF-8 text that was once read as Windows-1252; only rows with the tell-tale letters reach Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Letters that begin a mis-read sequence, those that may follow, and bytes cp1252 leaves open.
MARKER = "[ÃÂâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
OPEN_BYTES = frozenset((0x81, 0x8D, 0x8F, 0x90, 0x9D))


def as_bytes(line: str) -> bytes:
    parts = []
    for char in line:
        code = ord(char)
        if 0xDC80 <= code <= 0xDCFF:
            parts.append(bytes((code - 0xDC00,)))
        elif code in OPEN_BYTES or code < 0x80 or 0xA0 <= code < 0x100:
            parts.append(bytes((code,)))
        else:
            parts.append(char.encode("cp1252"))
    return b"".join(parts)


def repaired(line: str) -> str:
    try:
        return as_bytes(line).decode("utf-8")
    except UnicodeError:
        return line


def repair(text: str) -> str:
    """Each line on its own; a line that is no such text stays."""
    marker = re.compile(MARKER)
    return "\n".join(repaired(x) if marker.search(x) else x for x in text.split("\n"))


@pandas_udf(StringType())
def _repair(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield some.map(repair, na_action="ignore")


def fix_mojibake(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` shows the marks are repaired, the others do not leave the JVM."""
    marked = F.coalesce(F.col(column).rlike(MARKER), F.lit(False))
    return rows.where(~marked).unionByName(rows.where(marked).withColumn(column, _repair(F.col(column))))
