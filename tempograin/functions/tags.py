"""Series identity: tag sets, their canonical keys, and selectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of a canonical key, and the limits of keys and values.
KEY_END, PAIR_END = "\x1f", "\x1e"
KEY_PATTERN = r"^(?!__)[A-Za-z_][A-Za-z0-9_.-]{0,127}$"
MOST_TAGS, MOST_VALUE_BYTES, MOST_KEY_BYTES = 16, 256, 1024


def series_key(tags: Column) -> Column:
    """Canonical text of a tag map: pairs sorted by key; the empty or null map is the empty text."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit(KEY_END), e["value"]))
    return F.coalesce(F.array_join(pairs, PAIR_END), F.lit(""))


def tags_of(key: Column) -> Column:
    """The tag map of a canonical text."""
    pairs = F.filter(F.split(key, PAIR_END), lambda p: F.length(p) > 0)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(KEY_END), F.lit(1)), F.split_part(p, F.lit(KEY_END), F.lit(2)))))


def valid_tags(tags: Column) -> Column:
    """Whether a tag set keeps the rules on names, lengths and number."""
    keys = F.forall(F.map_keys(tags), lambda k: k.rlike(KEY_PATTERN))
    values = F.forall(F.map_values(tags), lambda v: v.isNotNull() & (F.octet_length(v).between(1, MOST_VALUE_BYTES)) & ~v.rlike(r"[\x00-\x1F\x7F]"))
    return F.coalesce(keys & values & (F.size(tags) <= MOST_TAGS) & (F.octet_length(series_key(tags)) <= MOST_KEY_BYTES), tags.isNull())


def select_series(tags: Column, wanted: dict[str, str | None], exact: bool = False) -> Column:
    """Whether a tag set has exactly each wanted value (None: lacks the key), and with ``exact`` nothing else."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (~F.coalesce(F.map_contains_key(tags, k), F.lit(False)) if v is None else F.coalesce(F.element_at(tags, k) == v, F.lit(False)))
    return out & (F.coalesce(F.size(tags), F.lit(0)) == sum(v is not None for v in wanted.values())) if exact else out
