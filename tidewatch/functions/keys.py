"""Deterministic identifiers and small text helpers."""

from pyspark.sql import Column, functions as F


def stable_id(*parts) -> Column:
    """Reproducible id: SHA-256 over the natural key (re-runs give equal ids)."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def ts_text(ts) -> Column:
    """Microsecond text of a timestamp, the same in every engine."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def details_json(**fields) -> Column:
    """JSON object with the given columns, NULL fields left out."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def once(column: Column) -> Column:
    """A costly column as a generated one, with the same rows: Spark copies filters on it, and their reading of it, to below
    a projection, and so would work it out once per use, but not to below a generator."""
    return F.explode_outer(F.array(column))
