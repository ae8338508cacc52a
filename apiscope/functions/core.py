"""Small building blocks used by the other column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(patterns: Iterable[str]) -> str:
    """One alternation that matches where any of the patterns does."""
    return "(?:" + "|".join(patterns) + ")"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True where one of the plain words occurs."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def contains_all(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [text.contains(w) for w in words])


def hinted(text: Column, pattern: str, hint: str | tuple) -> Column:
    """The pattern's cheap pre-test: a short pattern, or words of which one occurs."""
    if isinstance(hint, str):
        return text.rlike(hint)
    return contains_any(F.lower(text) if pattern.startswith("(?i)") else text, hint)


def matches(text: Column, pattern: str | Column, group: int | Column = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def non_null(*items: Column) -> Column:
    """Array of the non-NULL items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def first_case(cases: Iterable[tuple[Column, Column]]) -> Column:
    """CASE WHEN c1 THEN v1 WHEN c2 THEN v2 ... END, NULL if none holds."""
    result = None
    for cond, value in cases:
        result = F.when(cond, value) if result is None else result.when(cond, value)
    return result


def rewrite_matches(text: Column, pattern: str, change: Callable[[Column, Column], Column],
                    group: int = 0) -> Column:
    """Replace every match by ``change(match, group_value)``.

    ``split`` and ``regexp_extract_all`` cut the text at the same places, so
    the pieces between and the changed matches are put together again.  Only
    the matched spans change, never an equal text elsewhere.
    """
    found = F.arrays_zip(matches(text, pattern).alias("m"),
                         matches(text, pattern, group).alias("g"))
    changed = F.transform(found, lambda x: change(x["m"], x["g"]))
    pieces = F.zip_with(F.split(text, pattern, -1), changed,
                        lambda between, new: F.concat(between, F.coalesce(new, F.lit(""))))
    return F.array_join(pieces, "")


_EDGE, _BLANK = "\u0002", "\u0001"
_PLACE = "array<struct<at:int,line:int,column:int>>"
_HIT = "array<struct<m:string,at:int,line:int,column:int>>"
_CHUNK = 256  # even, so that odd places stay odd in every chunk


def match_positions(text: Column, pattern: str | Column,
                    keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<m, at, line, column>> of the matches that ``keep`` lets pass.

    One regex pass puts an edge mark around every match; split at the marks,
    the pieces at odd places are the matches.  Folds over chunks of the pieces
    carry offset, line and column along, and the chunks are then shifted by
    what stands before them, so a text with very many matches costs little
    more than one with few.  ``at`` is 0-based, line and column 1-based.  A mark
    already in the text is blanked first (``exact_text`` restores it).
    """
    return marked_positions(marked(text, pattern), keep)


def marked(text: Column, pattern: str | Column) -> Column:
    """The text with an edge mark before and after every match."""
    return F.regexp_replace(F.translate(text, _EDGE, _BLANK), F.lit(pattern),
                            F.lit(f"{_EDGE}$0{_EDGE}"))


def marked_positions(marked_text: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """As ``match_positions``, from the marked text."""

    def moved(acc: Column, size: Column, breaks: Column, tail: Column) -> list[Column]:
        """Position after a piece; ``tail`` is its length after the last break."""
        return [(acc["at"] + size).alias("at"), (acc["line"] + breaks).alias("line"),
                F.when(breaks > 0, tail).otherwise(acc["column"] + size).alias("column")]

    def origin() -> list[Column]:
        return [F.lit(0).alias(n) for n in ("at", "line", "column")]

    def step(acc: Column, p: Column) -> Column:
        size = F.length(p)
        breaks = size - F.length(F.replace(p, F.lit("\n"), F.lit("")))
        wanted = acc["odd"] if keep is None else acc["odd"] & keep(p)
        hit = F.struct(p.alias("m"), acc["at"], acc["line"], acc["column"])
        return F.struct(
            (~acc["odd"]).alias("odd"),
            *moved(acc, size, breaks, F.length(F.substring_index(p, "\n", -1))),
            F.when(wanted, F.concat(acc["hits"], F.array(hit.cast(_HIT[6:-1]))))
            .otherwise(acc["hits"]).alias("hits"))

    def chunks(pieces: Column) -> Column:
        start = F.struct(F.lit(False).alias("odd"), *origin(), F.array().cast(_HIT).alias("hits"))
        last = F.floor((F.size(pieces) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(
            F.slice(pieces, b * _CHUNK + 1, F.lit(_CHUNK)), start, step))

    def bases(parts: Column) -> Column:
        """Where each chunk starts, by one running fold over the chunks."""
        start = F.struct(*origin(), F.array().cast(_PLACE).alias("all"))
        return F.aggregate(parts, start, lambda acc, c: F.struct(
            *moved(acc, c["at"], c["line"], c["column"]), F.concat(acc["all"], F.array(F.struct(
                acc["at"], acc["line"], acc["column"]))).alias("all")))["all"]

    def shifted(parts: Column) -> Column:
        return let(bases(parts), lambda starts: placed(parts, starts))

    def placed(parts: Column, starts: Column) -> Column:
        return F.flatten(F.transform(parts, lambda c, b: let(F.get(starts, b), lambda z: F.transform(
            c["hits"], lambda h: F.struct(
                h["m"].alias("m"), (h["at"] + z["at"]).alias("at"),
                (h["line"] + z["line"] + 1).alias("line"),
                (h["column"] + 1 + F.when(h["line"] == 0, z["column"]).otherwise(F.lit(0)))
                .alias("column"))))))

    return let(let(F.split(marked_text, _EDGE, -1), chunks), shifted)


def exact_text(text: Column, match: Column, at: Column) -> Column:
    """The match as it stands in ``text`` if blanks replace any of it."""
    return F.when(match.contains(_BLANK), F.substring(text, at + 1, F.length(match))) \
        .otherwise(match)
