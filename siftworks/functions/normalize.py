"""Normal forms of names, regions, dates and entities, as expressions; each has an SQL twin for checking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes of organizations, and words that count as such.
COMPANY_SUFFIXES = (
    "A/S", "AB", "AG", "AO", "AG & Co", "AG &", "AG & CO.", "AG & CO. KG", "AG & CO. KGaA", "AG & KG", "AG & KGaA", "AG & PARTNER", "ATE", "ASA", "B.V.", "BV", "Class A", "Class B", "Class C", "Class D", "Class E", "Class F",
    "Class G", "CO", "Company", "Corp", "Corporation", "DAC", "GmbH", "Inc", "Incorporated", "KGaA", "Limited", "LLC", "LLP", "LP", "Ltd", "N.V.", "NV", "Plc", "PC", "Pty Ltd", "Pty", "Pty. Ltd.", "S.A.", "S.A.B. de C.V.", "SAB de CV",
    "S.A.B.", "S.A.P.I.", "NV/SA", "SDI", "SpA", "S.L.", "S.p.A.", "SA", "SE", "Tbk PT", "U.A.", "Group", "Holdings", "Holding", "Partners", "Trust", "Fund", "Bank", "N.A.", "The",
)
# One shortened last word and what it stands for, in order.
EXPANSIONS = ((" ltd", " limited"), (" corp", " corporation"), (" inc", " incorporated"), (" co", " company"), (" intl", " international"), (" natl", " national"))
# Titles before and additions after the names of persons, without dots at the end.
PERSON_PREFIXES = "dr prof professor mr mrs ms miss sir dame lord lady rev reverend hon honorable gen general col colonel capt captain lt lieutenant sgt sergeant".split()
PERSON_SUFFIXES = "jr junior sr senior ii iii iv v 2nd 3rd 4th 5th phd ph.d md m.d esq mba m.b.a cpa c.p.a jd j.d".split()
DETERMINERS = "the a an this that these those".split()

_SPECIAL = r"""[•;:'"\[\](){}<>`~!@#$%^&*\-_=+\\|/?]+"""
_ROUNDS = 6


def _escape(text: str) -> str:
    return "".join("\\" + ch if ch in ".&/+*?()[]{}|^$\\" else ch for ch in text)


_SUFFIX = r"(?i)\s+(" + "|".join(_escape(s) for s in COMPANY_SUFFIXES) + r")\.?\z"
_TAIL = r"[ .,;&\n\t/)]\z"
_POSSESSIVE = r"'s\b"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def sql_sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_q(pattern)}, {_q(by)}, 'g')"


def clean_org_name(name: Column) -> Column:
    """Special characters become spaces, spaces are single."""
    return F.trim(sub(sub(name, _SPECIAL, " "), r"\s+", " "))


def sql_clean_org_name(name: str) -> str:
    return f"trim({sql_sub(sql_sub(name, _SPECIAL, ' '), chr(92) + 's+', ' ')})"


def remove_suffix(name: Column) -> Column:
    """Legal suffixes and one character of punctuation after each are removed, up to six times over."""
    out = F.trim(sub(sub(name, _POSSESSIVE), r"\s+", " "))
    for _ in range(_ROUNDS):
        out = F.trim(sub(sub(out, _SUFFIX), _TAIL))
    return out


def sql_remove_suffix(name: str) -> str:
    out = f"trim({sql_sub(sql_sub(name, _POSSESSIVE), chr(92) + 's+', ' ')})"
    for _ in range(_ROUNDS):
        out = f"trim({sql_sub(sql_sub(out, _SUFFIX), _TAIL)})"
    return out


def normalize_org_name(name: Column) -> Column:
    """Lower-case name without special characters and legal suffixes; the cleaned name if nothing else is left; '' for NULL."""
    cleaned = clean_org_name(sub(name, _POSSESSIVE))
    short = F.lower(remove_suffix(cleaned))
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(F.lower(cleaned), F.lit("")), F.lower(name), F.lit(""))


def sql_normalize_org_name(name: str) -> str:
    cleaned = sql_clean_org_name(sql_sub(name, _POSSESSIVE))
    return f"coalesce(nullif(lower({sql_remove_suffix(cleaned)}), ''), nullif(lower({cleaned}), ''), lower({name}), '')"


def canon_name(name: Column) -> Column:
    """Form in which names are equal for canonicalization: lower case, no dots at the end, single spaces."""
    return F.trim(sub(sub(F.lower(name), r"\.+\z"), r"\s+", " "))


def sql_canon_name(name: str) -> str:
    return f"trim({sql_sub(sql_sub(f'lower({name})', chr(92) + '.+' + chr(92) + 'z'), chr(92) + 's+', ' ')})"


def expand_suffix(name: Column) -> Column:
    """One shortened word at the end is written out."""
    text = sub(F.lower(name), r"\.+\z")
    out = F.when(F.endswith(text, F.lit(EXPANSIONS[0][0])), F.regexp_replace(text, rf"{EXPANSIONS[0][0]}\z", EXPANSIONS[0][1]))
    for short, full in EXPANSIONS[1:]:
        out = out.when(F.endswith(text, F.lit(short)), F.regexp_replace(text, rf"{short}\z", full))
    return out.otherwise(text)


def sql_expand_suffix(name: str) -> str:
    text = sql_sub(f"lower({name})", r"\.+\z")
    whens = " ".join(f"when suffix({text}, '{s}') then {sql_sub(text, s + chr(92) + 'z', f)}" for s, f in EXPANSIONS)
    return f"case {whens} else {text} end"


def names_match(a: Column, b: Column) -> Column:
    """Equal for canonicalization, as written or with a shortened word at the end written out."""
    x, y = canon_name(a), canon_name(b)
    return (x == y) | (expand_suffix(x) == expand_suffix(y))


def _either(words: list[str]) -> str:
    return "|".join(_escape(w) for w in words)


_TITLES_AHEAD = rf"^((?:{_either(PERSON_PREFIXES)})\.*\s+)+"
_ADDED_AFTER = rf"(\s+(?:{_either(PERSON_SUFFIXES)})\.*)+\z"
_ONLY_TITLES = rf"^(?:(?:{_either(PERSON_PREFIXES + PERSON_SUFFIXES)})\.*\s*)+\z"


def normalize_person_name(name: Column) -> Column:
    """Lower-case name without titles before and additions after it; as written if it consists of those; '' for NULL."""
    text = F.trim(sub(F.lower(name), r"\s+", " "))
    bare = sub(sub(text, _TITLES_AHEAD), _ADDED_AFTER)
    return F.coalesce(F.when(text.rlike(_ONLY_TITLES) | (bare == ""), text).otherwise(bare), F.lit(""))


def sql_normalize_person_name(name: str) -> str:
    text = f"trim({sql_sub(f'lower({name})', chr(92) + 's+', ' ')})"
    bare = sql_sub(sql_sub(text, _TITLES_AHEAD), _ADDED_AFTER)
    return f"coalesce(case when regexp_matches({text}, {_q(_ONLY_TITLES)}) or {bare} = '' then {text} else {bare} end, '')"


def search_terms(query: Column) -> Column:
    """The three longest words, in order of length and then of place; words under three letters only if there is no other word."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    kept = F.when(F.size(words) > 1, F.filter(words, lambda w: F.length(w) >= 3)).otherwise(words)
    tagged = F.transform(kept, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(tagged), 1, 3), lambda s: s["w"])


def title_case(name: Column) -> Column:
    """Spaces single, every letter after a non-letter a capital, the others small."""
    text = F.lower(F.trim(sub(name, r"\s+", " ")))
    letters = F.split(text, "")
    up = F.transform(letters, lambda ch, i: F.when((i == 0) | ~F.coalesce(F.get(letters, i - 1), F.lit(" ")).rlike(r"\p{L}"), F.upper(ch)).otherwise(ch))
    return F.array_join(up, "")


def compact_date(value: Column) -> Column:
    """CCYYMMDD and CCYYMM as ISO dates, anything else as NULL."""
    digits = F.trim(value)
    return F.when(digits.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))).when(
        digits.rlike(r"^\d{6}$"), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2))
    )


def parse_qid(value: Column) -> Column:
    """``Q2283`` as 2283; NULL for what is no QID."""
    return F.regexp_replace(F.trim(value), "^[Qq]", "").try_cast("bigint")


def format_qid(number: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(F.lit("Q"), number))


def entity_form(text: Column) -> Column:
    """Lower case, single spaces, without one determiner in front."""
    return F.trim(sub(F.trim(sub(F.lower(text), r"\s+", " ")), rf"^(?:{'|'.join(DETERMINERS)})(?:\s+|\z)"))


def sql_entity_form(text: str) -> str:
    inner = f"trim({sql_sub(f'lower({text})', chr(92) + 's+', ' ')})"
    return f"trim({sql_sub(inner, '^(?:' + '|'.join(DETERMINERS) + ')(?:' + chr(92) + 's+|' + chr(92) + 'z)')})"


def triple_key(subject: Column, predicate: Column, obj: Column) -> Column:
    """Sixteen hex digits that are equal for triples equal but for case and spacing."""
    norm = lambda c: F.trim(sub(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return F.substring(F.sha2(F.concat_ws("\x01", norm(subject), norm(predicate), norm(obj)), 256), 1, 16)


def xml_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def citation(title: Column, authors: Column, year: Column, page: Column) -> Column:
    """``Title - Author(s) - Year - p. N``, of the parts that are known; '' if none is."""
    n = F.size(authors)
    who = F.when(n == 1, F.get(authors, F.lit(0))).when(n == 2, F.concat_ws(" & ", F.get(authors, F.lit(0)), F.get(authors, F.lit(1)))).when(n > 2, F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))
    return F.concat_ws(" - ", F.nullif(title, F.lit("")), who, year.cast("string"), F.concat(F.lit("p. "), page.cast("string")))


def qualified_name(name: Column, *qualifiers: Column) -> Column:
    """``Name (a, b)`` with known qualifiers that differ from the name and from each other but for case."""
    known = F.filter(F.array(*[F.nullif(F.trim(q), F.lit("")) for q in qualifiers]), lambda q: q.isNotNull() & (F.lower(q) != F.lower(name)))
    once = F.filter(known, lambda q, i: F.array_position(F.transform(known, F.lower), F.lower(q)) == i + 1)
    return F.when(F.size(once) > 0, F.concat(name, F.lit(" ("), F.array_join(once, ", "), F.lit(")"))).otherwise(name)


# Prefixes of canonical ids by source.
ID_PREFIX = {"gleif": "LEI", "sec_edgar": "SEC-CIK", "companies_house": "UK-CH", "wikidata": "WIKIDATA", "wikipedia": "WIKIDATA"}


def canonical_id(source: Column, source_id: Column, name: Column) -> Column:
    """``PREFIX:id``; ``source:name`` where there is no id."""
    pairs = [F.lit(x) for kv in ID_PREFIX.items() for x in kv]
    prefix = F.coalesce(F.element_at(F.create_map(*pairs), source), source)
    return F.when(F.coalesce(source_id, F.lit("")) == "", F.concat_ws(":", source, name)).otherwise(F.concat_ws(":", prefix, source_id))


def sentence_count(text: Column) -> Column:
    """Sentences of more than ten characters, tags left out, at least one."""
    plain = sub(F.coalesce(text, F.lit("")), "<[^>]*>", " ")
    return F.greatest(F.lit(1), F.size(F.filter(F.split(plain, r"[.!?]+"), lambda s: F.length(F.trim(s)) > 10)))


def truncate_label(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
