"""Folding of letters and white space, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, by their plain forms.
_MARKS = {
    "a": "áàâäãåāăą", "c": "çćč", "d": "ďđ", "e": "éèêëēėęě", "g": "ğ", "i": "íìîïīįı", "l": "ľĺł", "n": "ñńň",
    "o": "óòôöõøōő", "r": "ŕř", "s": "śšşș", "t": "ťţț", "u": "úùûüūůűų", "y": "ýÿ", "z": "źžż",
}
_MARKED = "".join(_MARKS.values())
_PLAIN = "".join(k * len(v) for k, v in _MARKS.items())
_LONG = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"}


def unmarked(text: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    low = F.lower(text)
    # no letter is looked up where all are of one byte
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _MARKED, _PLAIN))


def fold(text: Column) -> Column:
    """Lower case without marks on Latin letters; NULL stays NULL."""
    out = unmarked(text)
    for a, b in _LONG.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\p{M}+", "")


def words(text: Column) -> Column:
    """Folded text as words with single spaces: dots and apostrophes vanish, ``&`` and other marks become spaces."""
    bare = F.regexp_replace(F.regexp_replace(fold(text), r"[.'’`´]", ""), r"[^\p{L}\p{N}%#]+", " ")
    return F.trim(bare)
