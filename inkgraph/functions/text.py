"""Scalar functions of paths, headings and queries, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_each(text: Column) -> Column:
    """Lower case of each character on its own, without contextual forms."""
    return F.array_join(F.transform(F.split(text, ""), F.lower), "")


def tokens(text: Column) -> Column:
    """Runs of letters and numbers, lower-cased after they are cut out."""
    return F.transform(F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != ""), lower_each)


def matches(queries: Column, own: Column) -> Column:
    """How many query tokens begin, or begin with, one of ``own``."""
    near = lambda q: F.exists(own, lambda t: F.startswith(t, q) | F.startswith(q, t))
    return F.size(F.filter(queries, near))


def match_score(query: Column, heading: Column, path: Column) -> Column:
    """Rank of a section for query tokens, null where nothing matches.

    Fixed values: 40000 for the whole path, 30000 for the heading, 29000 for the heading in another order, 20000 and
    100 for each exact token if all match, 10000 and 100 for each match and 1 for each exact token if some do."""
    best = F.greatest(matches(query, path), matches(query, heading))
    exact = F.size(F.filter(query, lambda t: F.array_contains(path, t)))
    return (
        F.when(F.size(query) == 0, None)
        .when(query == path, 40000)
        .when(query == heading, 30000)
        .when(F.array_sort(query) == F.array_sort(heading), 29000)
        .when(best == 0, None)
        .when(best == F.size(query), 20000 + 100 * exact)
        .otherwise(10000 + 100 * best + exact)
        .cast("int")
    )


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, r" > ", -1)) - 1


def normalize_path(path: Column) -> Column:
    """Request path with forward slashes and without empty and ``.`` parts; null if a part is ``..``."""
    parts = F.split(F.translate(path, "\\", "/"), "/", -1)
    kept = F.filter(parts, lambda p: ~p.isin("", "."))
    return F.when(~F.array_contains(parts, ".."), F.array_join(kept, "/"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md\z", "")


def target_file(target: Column) -> Column:
    return F.substring_index(target, "#", 1)


def target_heading(target: Column) -> Column:
    """What follows the first ``#``; null without one."""
    at = F.instr(target, "#")
    return F.when(at > 0, F.substr(target, at + 1))


def prefixes(path: Column) -> Column:
    """All that stands before some `` > `` in the path, overlapping ones too."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(path), F.lit(1))), lambda i: F.substr(path, i, F.lit(3)) == " > ")
    return F.transform(at, lambda i: F.substr(path, F.lit(1), i - 1))


def nearest_distance(needle: Column, candidate: Column) -> Column:
    return F.levenshtein(F.lower(needle), F.lower(candidate))
