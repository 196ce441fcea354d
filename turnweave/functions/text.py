"""Scalar functions over columns: spans, stamps, and the text normalisers.

The normalisers differ on purpose; each belongs to one comparison and they must not be unified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Python string method sees it, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85]"
#: Words that acknowledge the other speaker.
BACKCHANNELS = tuple("yeah yep yes yup mm-hmm -hmm mhm uh-huh ok okay no nope right sure correct exactly great cool thanks".split())
QUOTES = ".,?!\"'"


def overlap_seconds(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def gap_seconds(a_start, a_end, b_start, b_end) -> Column:
    """Silence between two spans; 0 where they touch or overlap."""
    return F.greatest(b_start - a_end, a_start - b_end, F.lit(0.0))


def stamp(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS under an hour; whole seconds, never negative."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def stamp_seconds(text: Column) -> Column:
    p = F.reverse(F.split(text, ":"))
    part = lambda i: F.coalesce(F.get(p, i).cast("long"), F.lit(0))
    return part(0) + part(1) * 60 + part(2) * 3600


def words(text: Column) -> Column:
    """Split at any Unicode white space, without empty words."""
    return F.filter(F.split(text, f"(?U){SPACE}+"), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def loop_token(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(QUOTES))


def containment_text(text: Column) -> Column:
    """Lower case, letters digits and spaces only, single spaces, no spaces at the ends."""
    # single spaces, which are nearly all, stay as they are and are not replaced one by one
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", ""), "  +", " "))


def duplicate_text(text: Column) -> Column:
    """Lower case, letters digits and spaces only; runs of spaces stay, line ends vanish."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")


#: All bytes that duplicate_string() leaves out.
_OTHERS = bytes(sorted(set(range(256)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789 ")))


def duplicate_string(text: str) -> str:
    """duplicate_text() of a string in a task, where a text is long and a pattern slow; never longer than the text."""
    return text.lower().encode("ascii", "ignore").translate(None, _OTHERS).decode("ascii")


def bag_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +"), lambda w: w != "")


def is_backchannel(text: Column) -> Column:
    """Every word that has letters or hyphens left is an acknowledgement, and there is one."""
    cleaned = F.filter(F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), "[^a-z-]", "")), lambda w: w != "")
    return (F.size(cleaned) > 0) & F.forall(cleaned, lambda w: w.isin(*BACKCHANNELS))


def squashed(text: Column) -> Column:
    """Lower-case letters and hyphens only."""
    return F.regexp_replace(F.lower(text), "[^a-z-]", "")


def is_backchannel_squashed(text: Column) -> Column:
    """The reports' rule: the whole text, squashed, is one acknowledgement."""
    return squashed(text).isin(*BACKCHANNELS)


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def words_per_second(text: Column, start: Column, end: Column) -> Column:
    return F.try_divide(F.size(words(text)).cast("double"), end - start)
