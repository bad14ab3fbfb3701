"""What several operators share: the byte-level notions of white space, case and split, and shipping of bounded models."""

from __future__ import annotations

import string
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is these six characters and no others.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same on plain ASCII and is much faster there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(c: Column) -> Column:
    """Words between white space; an empty array where there is none."""
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def fold_of(c: Column) -> Column:
    """crc32 of the id as text, modulo five: the fold by which models keep rows apart. A null id counts as an empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def fold(value: object) -> int:
    """:func:`fold_of` for one Python value."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % 5
