"""Search for words in text columns.

A text holds the words of a query if one of its lines holds all of them, in any order and any case, at places
that do not overlap. Words that can never overlap need no more than to occur. For the others the earliest place
at which a set of words can end is found from the sets with one word less: the last word goes to its first
occurrence after the rest. That is a fold over the sets of a group of words, whatever the number of words.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.errors import FacetryError

#: Words of one group; the cost of placing them doubles with each.
MOST_OVERLAPPING = 12


def words_of(query: str) -> list[str]:
    return query.lower().split()


def can_overlap(a: str, b: str) -> bool:
    """Whether two words can share a letter of a text."""
    if a in b or b in a:
        return True
    return any(a.endswith(b[:n]) or b.endswith(a[:n]) for n in range(1, min(len(a), len(b))))


def overlapping_groups(words: list[str]) -> list[list[str]]:
    """The words in groups; only words of one group can overlap."""
    groups: list[list[str]] = []
    for word in words:
        near = [g for g in groups if any(can_overlap(word, other) for other in g)]
        groups = [g for g in groups if g not in near] + [[word, *(w for g in near for w in g)]]
    return groups


def check_group(words: list[str]) -> None:
    """Refuse more words that can overlap each other than can be placed in a bounded time."""
    if len(words) > MOST_OVERLAPPING:
        raise FacetryError(f"more than {MOST_OVERLAPPING} search words that can overlap each other: {' '.join(words)}")


def _apart(line: Column, words: list[str]) -> Column:
    """Whether a line holds all words of a group at places that do not overlap."""
    if len(set(words)) == 1:
        freed = F.length(line) - F.length(F.replace(line, F.lit(words[0]), F.lit("")))
        return freed >= len(words) * len(words[0])
    check_group(words)

    def last_word(word: str, free_from: Column) -> Column:
        at = F.call_function("locate", F.lit(word), line, free_from)
        return F.when(at > 0, at + len(word))

    def add_set(ends: Column, members: Column) -> Column:
        options = [
            F.when(members.bitwiseAND(1 << i) != 0, last_word(word, F.get(ends, members - (1 << i))))
            for i, word in enumerate(words)
        ]
        return F.concat(ends, F.array(F.least(*options)))

    # The place after the words of each set, NULL where they do not fit; sets are numbered by their members' bits.
    sets = F.sequence(F.lit(1), F.lit(2 ** len(words) - 1))
    return F.element_at(F.aggregate(sets, F.array(F.lit(1)), add_set), -1).isNotNull()


def has_words(text: Column, query: str) -> Column:
    """True where one line of the text holds every word of the query."""
    words = words_of(query)
    if not words:
        return F.lit(False)
    lower = F.lower(text)
    somewhere = reduce(and_, [F.contains(lower, F.lit(w)) for w in dict.fromkeys(words)])
    if len(words) == 1:
        return somewhere
    groups = overlapping_groups(words)

    def holds(line: Column) -> Column:
        return reduce(and_, [_apart(line, group) for group in groups])

    # Texts that lack a word are ruled out before they are cut into lines.
    return F.when(somewhere, F.exists(F.split(lower, "\n"), holds)).otherwise(somewhere)


def text_has_words(text: str, query: str) -> bool:
    """``has_words`` for one text at hand, such as a column's name."""
    words = words_of(query)
    return bool(words) and any(_line_has_words(line, words) for line in text.lower().split("\n"))


def _line_has_words(line: str, words: list[str]) -> bool:
    """Each group of words that can overlap is placed by itself, as in ``has_words``."""
    return all(w in line for w in words) and all(_line_holds(line, group) for group in overlapping_groups(words))


def _line_holds(line: str, words: list[str]) -> bool:
    if len(set(words)) == 1:
        return line.count(words[0]) >= len(words)
    check_group(words)
    ends: list[int | None] = [0]
    for members in range(1, 2 ** len(words)):
        options = []
        for i, word in enumerate(words):
            free = ends[members - (1 << i)] if members >> i & 1 else None
            at = -1 if free is None else line.find(word, free)
            if at >= 0:
                options.append(at + len(word))
        ends.append(min(options, default=None))
    return ends[-1] is not None
