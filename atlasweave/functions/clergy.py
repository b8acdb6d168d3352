"""Lists of clergy as one string for each person.

A cleaned list is read as segments: one pattern cuts it into stretches of a kind, matter that names nobody, runs of titles, or
other text, and what is written follows from the kinds of neighbouring segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean
from .values import CLERGY_NOISE, JAMMED_TITLES, ROLES, TITLES

_TITLE = rf"(?<![A-Za-z0-9_])(?:{'|'.join(TITLES)})(?=[\s.;,]|$)"
#: A run of titles or the text up to the next one.
_SEGMENT = rf"(?is){_TITLE}(?:\s*{_TITLE})*|(?:(?!{_TITLE}).)+"
_RUN = rf"(?i)^{_TITLE}"
_ROLE = rf"(?i)(?:^|\s)(?:{'|'.join(ROLES)})\s+$"
#: What is parted by a blank: a bracket or full stop from a capital, and a title from a name written right after it.
_JAMMED = rf"(?<=[).])(?=[A-Z])|(?<=(?<![A-Za-z0-9_])(?:{'|'.join(JAMMED_TITLES)}))(?=[A-Z])"
_STRAY = r"[;,\s]"


def matter(s: Column) -> Column:
    """A cleaned list without what names nobody, jammed words parted."""
    bare = F.regexp_replace(s, rf"^{_STRAY}+|{_STRAY}+$", "")
    kept = F.regexp_replace(bare, "|".join(f"(?:{x})" for x in CLERGY_NOISE), "")  # its pattern is compiled once, that of a split for each row
    return F.regexp_replace(kept, _JAMMED, " ")


def persons(entry: Column) -> Column:
    """The persons that one entry names: a run of titles begins one unless lower case follows or a role's word stands before it.

    The first run of an entry never begins a second person, whatever stands before it.
    """
    found = F.regexp_extract_all(entry, F.lit(f"({_SEGMENT})"), F.lit(1))
    return F.flatten(F.transform(F.array(found), _named))  # a list of one, so that its segments are found once


def _named(segments: Column) -> Column:
    """The persons of an entry's segments."""
    at = lambda i: F.coalesce(F.try_element_at(segments, i), F.lit(""))
    first = F.when(at(F.lit(1)).rlike(_RUN), 1).otherwise(2)
    follows = lambda x, i: F.concat(x, at(i + 2)).rlike(rf"^(?i:{_TITLE})\s*[a-z]")
    before = lambda i: F.when(i > 0, at(F.greatest(i, F.lit(1)))).otherwise("")
    begins = lambda x, i: (i + 1 > first) & x.rlike(_RUN) & ~follows(x, i) & ~before(i).rlike(_ROLE)
    marked = F.array_join(F.transform(segments, lambda x, i: F.concat(F.when(begins(x, i), "\x01").otherwise(""), x)), "")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def listed(s: Column) -> Column:
    """The persons of matter(), joined by '; ', no stray marks before a joint, at the ends, or more than one blank."""
    people = F.filter(F.flatten(F.transform(F.split(F.regexp_replace(s, r";\s*", ";"), ";"), persons)), lambda x: x != "")
    tidied = lambda p: F.transform(p, lambda x, i: F.regexp_replace(F.when(i < F.size(p) - 1, F.regexp_replace(x, r"[.,]\s*$", "")).otherwise(x), r"\s{2,}", " "))
    tidy = F.flatten(F.transform(F.array(people), tidied))  # a list of one, so that the persons are found once and not once for each
    return F.regexp_replace(F.array_join(tidy, "; "), rf"^{_STRAY}+|{_STRAY}+$", "")


def clergy(c: Column) -> Column:
    """A cleaned list of persons joined by '; ', without phones, addresses and other matter; '' for none."""
    return listed(matter(clean(c)))
