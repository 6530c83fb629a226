"""Digests of whole tables that are merged from parts: two tables are compared without moving either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A row's SHA-256 in parts of 15 hex digits: 60 bits each, whose sums over 2 ** 60 rows still fit a decimal.
_LANES = (1, 16, 31, 46)
_MODULUS = 1 << 60


def _lanes(row: Column) -> list[Column]:
    digest = F.sha2(row, 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in _LANES]


def ordered_digest(rows: DataFrame, place: str, *ids: str) -> tuple[int, str]:
    """(rows, digest) of a list: of each row's place and ids. Lists with the same ids in another order differ.

    Every row is hashed with its place, and the hashes are added up modulo 2 ** 60 in four lanes, so the
    digest is one aggregation that is combined before the shuffle: nothing is sorted. Nulls differ from empty texts.
    """
    said = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in (place, *ids)]
    lanes = _lanes(F.concat_ws("|", *said))
    got = rows.agg(F.count(F.lit(1)), *[F.sum(x) for x in lanes]).first()
    return got[0], "".join(f"{int(x or 0) % _MODULUS:015x}" for x in got[1:])
