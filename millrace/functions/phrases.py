"""Phrases within texts, by an index over the pieces of a text.

A text is cut once into pieces: words, and every other character by itself.  A
phrase is a run of pieces.  Where a piece begins some phrase, the runs from there
that are as long as phrases are looked up in the set of all phrases, so the work
follows the text and not the number of phrases: more phrases are a larger set, and
neither another pass over the text nor another pattern.

Words are whole words by construction.  A phrase that starts or ends with another
character (``c++``, ``.net``) must not touch a word there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, and single other characters.
PIECE = r"\w+|\W"
_PLACES = "array<struct<place:int,phrase:string>>"


def pieces(text: Column) -> Column:
    """The pieces of the lower-cased text, in order; joined they are the text again."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?U){PIECE}"), F.lit(0))


def _is_word(piece: Column) -> Column:
    return F.coalesce(piece.rlike(r"(?U)^\w"), F.lit(False))


def places(cut: Column, phrases: Iterable[str]) -> Column:
    """Array of (place, phrase) for each occurrence among the pieces, by place; overlaps all count.

    ``phrases`` are lower-cased.  Null pieces have none.
    """
    runs = {phrase: re.findall(PIECE, phrase) for phrase in phrases if phrase}
    nothing = F.array().cast(_PLACES)
    if not runs:
        return nothing
    heads, lengths = sorted({run[0] for run in runs.values()}), sorted({len(run) for run in runs.values()})
    touchy_head = [phrase for phrase, run in runs.items() if not re.match(r"\w", run[0])]
    touchy_tail = [phrase for phrase, run in runs.items() if not re.match(r"\w", run[-1])]

    def from_here(i: Column) -> Column:
        def stands(run: Column) -> Column:
            known = run["phrase"].isin(*runs)
            if touchy_head:
                known = known & ~(run["phrase"].isin(*touchy_head) & _is_word(F.get(cut, i - 1)))
            if touchy_tail:
                known = known & ~(run["phrase"].isin(*touchy_tail) & _is_word(F.get(cut, i + run["n"])))
            return known

        ahead = F.array(*(F.struct(i.alias("place"), F.array_join(F.slice(cut, i + 1, F.lit(n)), "").alias("phrase"), F.lit(n).alias("n")) for n in lengths))
        return F.transform(F.filter(ahead, stands), lambda run: F.struct(run["place"].alias("place"), run["phrase"].alias("phrase")))

    starts = F.array_compact(F.transform(cut, lambda piece, i: F.when(piece.isin(*heads), i)))
    # the last runs may be cut short by the end of the text, and be a shorter phrase once more
    return F.coalesce(F.array_distinct(F.flatten(F.transform(starts, from_here))).cast(_PLACES), nothing)


def first_place(found: Column) -> Column:
    return F.array_min(F.transform(found, lambda p: p["place"]))


def before(cut: Column, place: Column) -> Column:
    """The text ahead of a place."""
    return F.array_join(F.slice(cut, F.lit(1), place), "")


def onwards(cut: Column, place: Column) -> Column:
    """The text from a place on."""
    return F.array_join(F.slice(cut, place + 1, F.size(cut)), "")
