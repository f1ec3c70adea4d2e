"""Names of organizations taken apart: invented words, line of business, fund number, legal form, country mark."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..tables import ship

# Lines of business by code, in the languages of the sources; shortened forms are recognised by rule.
BUSINESS = {
    "air": "airways airline airlines luftfahrt aerolineas aviation", "tex": "textiles textile textilien textil", "min": "mining bergbau mineria mines", "mfg": "manufacturing fertigung fabricacion fabrication manufacture mfg",
    "eng": "engineering ingenieurbau ingenieria ingenierie engineers engrg", "ins": "insurance versicherung versicherungen seguros assurances assurance", "int": "international internationale internacional internationales intl",
    "ene": "energy energie energia enrgy", "res": "research institute forschungsinstitut forschung institut recherche investigacion instituto inst rsch", "brw": "brewing brauerei brewery brasserie cerveceria brwg",
    "fou": "foundation stiftung fondation fundacion fdn fndn", "log": "logistics logistik logistique logistica", "pro": "properties immobilien immobilier inmobiliaria property props", "pha": "pharmaceuticals pharmazeutika pharma farmaceutica pharmaceutique pharmaceutica",
    "con": "construction bau construcciones constructions bauunternehmen constr", "foo": "foods lebensmittel alimentos aliments alimentation food fds", "med": "media medien medios medias", "cst": "consulting beratung conseil consultoria consultants consltg",
    "tec": "technologies technologie technologien tecnologias technology techs tech", "che": "chemicals chemie chimie quimica chemical chem", "tra": "transport transporte transportes transports transp trans", "ser": "services dienste servicios dienstleistungen service svcs svc servs",
    "rob": "robotics robotik robotica robotique", "shi": "shipping reederei naviera maritime armement shpg", "cap": "capital kapital capitaux", "wat": "water wasser agua eau eaux wtr",
}
# Legal forms by class.
LEGAL = {
    "ltd": "limited ltd lim ltda", "inc": "inc incorporated corp corporation", "plc": "plc", "llp": "llp", "llc": "llc", "gmbh": "gmbh", "ag": "ag aktiengesellschaft",
    "sa": "sa sociedadanonima", "sas": "sas", "nv": "nv", "bv": "bv", "srl": "srl", "spa": "spa", "sl": "sl", "ab": "ab aktiebolag", "as": "as", "pty": "pty",
}
_ROMAN = {r: i for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split(), 1)}
_DROP = frozenset("the and und et y e of de company co".split())
_WORD_OF = {w: code for code, ws in BUSINESS.items() for w in ws.split()}
_FORM_OF = {w: code for code, ws in LEGAL.items() for w in ws.split()}
_LONG = [w for w in _WORD_OF if len(w) >= 5]
_LONG_BY: dict[str, list[str]] = {}
for _w in _LONG:
    _LONG_BY.setdefault(_w[0], []).append(_w)
_NEAR: dict[str, str] = {}
for _w in _LONG:
    for _i in range(len(_w)):
        _NEAR.setdefault(_w[:_i] + _w[_i + 1 :], _WORD_OF[_w])
        if len(_w) >= 9:
            for _j in range(_i + 1, len(_w)):
                _NEAR.setdefault(_w[:_i] + _w[_i + 1 : _j] + _w[_j + 1 :], _WORD_OF[_w])
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
_MARK = re.compile(r"[(/\[]\s*([A-Za-z]{2})\s*[)/\]]\s*[.,]?\s*$")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])")
_INITIALS = re.compile(r"\b(?:[a-z]\.){2,}(?:[a-z]\b)?|\b[a-z](?:\.[a-z])+\b\.?|\b[a-z]/[a-z]\b")
_TOKEN, _TWICE = re.compile(r"[a-z0-9]+\.?"), re.compile(r"(.)\1+")
_VOWELS = frozenset("aeiouy")


def plain(text: str) -> str:
    text = text.lower()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text.translate(_PLAIN))
    return "".join(ch for ch in text if not unicodedata.combining(ch)) if not text.isascii() else text


@lru_cache(maxsize=30_000)
def sound(word: str) -> str:
    """A spelling shared by usual variants: digits for letters, ph/f, ck/k, ks/x, y/i, w/v, z/s, c/k, double letters."""
    if not word.isalpha():
        word = word.translate({48: "o", 49: "l", 51: "e", 53: "s"})
    word = word.replace("ph", "f").replace("ck", "k").replace("ks", "x").replace("y", "i").replace("w", "v").replace("z", "s").replace("c", "k").replace("kk", "k")
    return _TWICE.sub(r"\1", word)


@lru_cache(maxsize=30_000)
def business(word: str, dotted: bool) -> str | None:
    """Code of the line of business a word means: listed, shortened (a beginning or the consonants), or with one or two slips."""
    if word in _WORD_OF:
        return _WORD_OF[word]
    if 3 <= len(word):
        consonants = not (_VOWELS & set(word))
        if dotted or consonants or len(word) >= 6:
            for w in _LONG_BY.get(word[0], ()):
                if len(word) < len(w):
                    if w.startswith(word) and (dotted or consonants or len(word) >= len(w) - 3):
                        return _WORD_OF[w]
                    if consonants:
                        it = iter(w)
                        if all(ch in it for ch in word):
                            return _WORD_OF[w]
        if len(word) >= 4 and word in _NEAR:
            return _NEAR[word]
        if len(word) >= 5:
            for i in range(len(word)):
                short = word[:i] + word[i + 1 :]
                if short in _WORD_OF and len(short) >= 5:
                    return _WORD_OF[short]
                if short in _NEAR and len(short) >= 5:
                    return _NEAR[short]
    return None


def parse(name: str) -> tuple[list[str], str, int, str, str]:
    """``(words, business, fund, legal form, country mark)``; ``words`` in written order, folded but not yet sounded."""
    mark = ""
    found = _MARK.search(name)
    if found:
        mark, name = found.group(1).upper(), name[: found.start()]
    if not (name.isupper() or name.islower()):
        name = _CAMEL.sub(" ", name)
    text = plain(name).replace("'", "").replace("’", "")
    legal, code, fund = "", "", 0
    joined = _INITIALS.sub(lambda m: m.group().replace(".", "").replace("/", "") + " ", text) if "." in text or "/" in text else text
    joined = joined.replace("s.p.a", "spa").replace("g.m.b.h", "gmbh").replace("public limited company", "plc")
    tokens = _TOKEN.findall(joined)
    words: list[str] = []
    bare = [t.rstrip(".") for t in tokens]
    listed = {_WORD_OF[t] for t in bare if t in _WORD_OF}
    k = 0
    while k < len(tokens):
        dotted, t = tokens[k][-1] == ".", bare[k]
        nxt = bare[k + 1] if k + 1 < len(tokens) else ""
        if t == "fund" and (nxt in _ROMAN or nxt.isdigit()):
            fund, k = _ROMAN.get(nxt) or int(nxt[:6]), k + 2
            continue
        if t in _FORM_OF:
            legal = legal if legal == "pty" else _FORM_OF[t]
        elif t in _DROP or t == "fund":
            pass
        elif (b := business(t, dotted)) and (t in _WORD_OF or not listed or b in listed):  # beside a listed word, one like another line is a name
            code = b if not code or code == "int" else code
        elif k == len(tokens) - 1 and len(words) >= 2 and not code and len(t) >= 3 and (b := next((_WORD_OF[w] for w in _LONG if w.startswith(t)), None)):
            code = b  # a long name cut off
        elif len(t) >= 3 and not (k == len(tokens) - 1 and words and any(f.startswith(t) for f in ("limited", "incorporated", "corporation", "gmbh"))):
            words.append(t)
        k += 1
    if not words:
        words = [t for t in bare if t not in _FORM_OF and t not in _DROP and t != "fund"][:2]
    return words, code, fund, legal, mark


SCHEMA = "words array<string>, sounds array<string>, business string, fund int, legal string, mark string"
_WORDS = pa.list_(pa.string())


def parts(name: Column) -> Column:
    """A name's parts as a struct; ``sounds`` are the distinct words in shared spelling, sorted. NULL has no words."""

    ship(SparkSession.getActiveSession())
    @F.arrow_udf(SCHEMA)
    def take_apart(names: pa.Array) -> pa.Array:
        words, codes, funds, legals, marks = zip(*map(parse, ("", *[name or "" for name in names.to_pylist()])), strict=True)
        sounds = [sorted({sound(w) for w in ws}) for ws in words]
        fields = (words, sounds, codes, funds, legals, marks)
        kinds = (_WORDS, _WORDS, pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array(x[1:], kind) for x, kind in zip(fields, kinds, strict=True)], ["words", "sounds", "business", "fund", "legal", "mark"])

    return take_apart(name)
