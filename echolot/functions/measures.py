"""Column expressions over units and pairs of units; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTION_LIKE = ("function", "method")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays without repeats; 0.0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(both / either)


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Closed intervals share a point."""
    return ~((end_a < start_b) | (end_b < start_a))


def statement_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger count; 0.0 if both are 0."""
    return F.when(F.greatest(a, b) == 0, 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def kind_class(kind: Column) -> Column:
    """Functions and methods compare with each other, other kinds with their own only."""
    return F.when(kind.isin(*FUNCTION_LIKE), "callable").otherwise(kind)


def is_test(kind: Column, name: Column) -> Column:
    return kind.isin(*FUNCTION_LIKE) & name.startswith("test_")


def is_tiny(kind: Column, statements: Column, cutoff: int) -> Column:
    """A function or method of fewer statements than the cutoff; classes never are."""
    return kind.isin(*FUNCTION_LIKE) & (statements < cutoff)


def likely_api(name: Column, kind: Column, public: Column, dunder: Column, exported: Column) -> Column:
    return exported | dunder | (public & (kind == "class")) | name.isin("__init__", "__new__", "__call__")


def uid(path: Column, qualified_name: Column) -> Column:
    return F.concat_ws("::", path, qualified_name)


def normalised(tokens: Column, stop: list[str]) -> Column:
    """Distinct tokens that are neither empty, nor in the stop list, nor all digits."""
    kept = F.array_except(F.array_distinct(tokens), F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"))
    return F.filter(kept, lambda t: (t != "") & ~t.rlike(r"^\d+$"))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of a text, distinct; the text's counterpart of identifiers."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda t: t != "")


def suffixes(dotted: Column) -> Column:
    """All dotted suffixes: a.b.c, b.c and c."""
    parts = F.split(dotted, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def location(path: Column, line: Column) -> Column:
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit(":"), line.cast("string"))


def snippet(source: Column, lines: int = 5) -> Column:
    """The first lines of the stripped source, with a note of how many more there are."""
    parts = F.split(F.regexp_replace(source, r"^\s+|\s+$", ""), "\n")
    head = F.array_join(F.slice(parts, 1, lines), "\n")
    more = F.concat(head, F.lit("\n... ("), (F.size(parts) - lines).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(parts) <= lines, head).otherwise(more)
