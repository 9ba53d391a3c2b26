"""The small languages of page annotations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the attribute `custom`; the first is greedy, so a second key is part of the type.
TYPE_PATTERN = r"^.*structure \{.*type:(.*);.*\}"
ORDER_PATTERN = r"readingOrder \{index:(\d+);"
# Fixed value: what stands where an id should, the name of a Python module with the path of its file.
UUID_PATTERN = r"&lt;module 'uuid' from '[^']*'>"


def region_type(custom: Column) -> Column:
    """The type in "structure {type:X;}"; null if none."""
    return F.nullif(F.regexp_extract(custom, TYPE_PATTERN, 1), F.lit(""))


def reading_order(custom: Column) -> Column:
    return F.nullif(F.regexp_extract(custom, ORDER_PATTERN, 1), F.lit("")).cast("int")


def type_custom(rtype: Column) -> Column:
    return F.concat(F.lit("structure {type:"), rtype, F.lit(";}"))


def order_custom(index: Column) -> Column:
    return F.concat(F.lit("readingOrder {index:"), index.cast("string"), F.lit(";}"))


def name_of(path: Column) -> Column:
    """The last part of a path, without what follows '?' or '#'."""
    return F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name_of(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    """The last extension with its point, in lower case; '' if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def natural_key(text: Column) -> Column:
    """A key whose order is the natural one: letters in lower case; before each run of digits, without its leading zeros, the length of it, and the length of that length."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|[^\d]+)"), F.lit(1))

    def one(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(\d)", "$1")
        n = F.length(digits).cast("string")
        return F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.length(n).cast("string"), n, digits)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def repaired_uuid(text: Column, new: Column | None = None) -> Column:
    """Text in which each escaped name of the uuid module, whatever its path, is a fresh id: `new` and the number of the place, or random.

    The pieces between the placeholders are kept and joined by the ids.
    """
    pieces = F.split(text, UUID_PATTERN)
    own = (lambda i: F.concat(new, F.lit("_"), i.cast("string"))) if new is not None else (lambda i: F.uuid())
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(own(i), p))), "")


def xml_path(image: Column) -> Column:
    """dir/name.ext -> dir/page/name.xml."""
    return F.regexp_replace(image, r"^(.*/)?([^/]+?)(\.[^./]*)?$", "$1page/$2.xml")


def unit_text(value: Column) -> Column:
    """Null as ''."""
    return F.coalesce(value, F.lit(""))
