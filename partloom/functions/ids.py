"""Keys as the tables spell them: part ids in lists, usable hashes, family names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part_ref(c: Column) -> Column:
    """The part id that a list entry names: outer blanks and a leading ``./`` dropped, separators ``/``; blank gives null."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    s = F.regexp_replace(F.translate(s, "\\", "/"), r"^\./", "")
    return F.when(F.length(s) > 0, s)


def usable_hash(c: Column) -> Column:
    """64 lower-case hex digits, or null; drops outer blanks, letter case and an algorithm prefix ending in a colon."""
    s = F.regexp_extract(F.lower(c), r"^\s*(?:[^:]*:)?\s*([0-9a-f]{64})\s*$", 1)
    return F.when(F.length(s) == 64, s)


def family_key(c: Column) -> Column:
    """Family name without letter case and outer blanks; blank and the noise family ``fam_-1`` give null."""
    s = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.when((F.length(s) > 0) & (s != "fam_-1"), s)


def key128(*cols: Column) -> Column:
    """16-byte key of one or more strings, for grouping on long values with short shuffles; null if any part is null."""
    out = F.unhex(F.md5(F.concat_ws("\x1f", *cols)))
    for c in cols:
        out = F.when(c.isNotNull(), out)
    return out
