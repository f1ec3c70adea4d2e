"""Names of persons taken apart."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..tables import ship
from .orgnames import plain, sound

# Titles and letters around a name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame lord lady rev hon mba phd obe cbe mbe kbe jr snr sr esq cpa md qc kc bsc msc ba ma dipl ing frau herr mme m8 the".split())
# Short and familiar forms by the full name they stand for.
FAMILIAR = {
    "lawrence": "larry", "francisco": "paco pancho", "nicholas": "nick nicky", "rebecca": "becky becca", "abigail": "abby gail", "michael": "mike mick mickey", "anthony": "tony", "robert": "rob bob bobby robbie bert",
    "friedrich": "fritz", "deborah": "debbie deb", "victoria": "vicky viki tori", "susan": "sue susie", "pamela": "pam", "jose": "pepe", "benjamin": "ben benny", "jonathan": "jon", "christopher": "chris kit",
    "timothy": "tim", "frederick": "fred freddie", "william": "bill will billy liam", "matthew": "matt", "johannes": "hans jannes", "jennifer": "jenny jen", "patricia": "trish pat patty tricia", "thomas": "tom tommy",
    "elizabeth": "beth liz lizzie betty eliza", "richard": "rick dick rich ricky", "charles": "charlie chuck", "kenneth": "ken kenny", "joseph": "joe joey", "andrew": "andy drew", "edward": "ed ted eddie ned",
    "stephen": "steve steven", "margaret": "maggie peggy meg", "katherine": "kathy kate katie kat", "samuel": "sam sammy", "daniel": "dan danny", "james": "jim jimmy jamie", "alexander": "alex sandy sasha", "gregory": "greg",
    "peter": "pete", "john": "jack johnny", "henry": "harry hal", "david": "dave", "philip": "phil", "raymond": "ray", "ronald": "ron", "donald": "don", "gerald": "gerry jerry", "theodore": "theo",
    "barbara": "barb babs", "catherine": "cathy", "dorothy": "dot dolly", "eleanor": "nell ellie", "jessica": "jess", "judith": "judy", "helen": "nellie", "sarah": "sally", "alfred": "alf", "leonard": "len lenny",
    "maximilian": "max", "josef": "sepp", "guillermo": "memo", "ignacio": "nacho", "dolores": "lola", "concepcion": "concha", "enrique": "quique", "rafael": "rafa", "jean": "jeannot", "wilhelm": "willi",
}
_WORD, _UMLAUT = re.compile(r"[^\W_]+"), re.compile(r"(?<=[aou])e")
_FULL = {s: full for full, shorts in FAMILIAR.items() for s in shorts.split()}


@lru_cache(maxsize=30_000)
def canonical(word: str) -> str:
    """The shared spelling of a name: a familiar form as its full one, ae, oe and ue as a, o and u."""
    return sound(_UMLAUT.sub("", _FULL.get(word, word)))


def parse(name: str) -> list[str]:
    """Words in given-names-first order, folded, without titles; ``Surname, Given`` is turned round, hyphens divide."""
    text = plain(name)
    if "0" in text or "1" in text:
        text = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", text))
    head, comma, tail = text.partition(",")
    listed = lambda part: [w for w in _WORD.findall(part.replace("'", "").replace("’", "")) if w not in TITLES]
    return listed(tail) + listed(head) if comma else listed(head)


def sounds(name: Column) -> Column:
    """Canonical words of a name, in given-names-first order. NULL has none."""

    ship(SparkSession.getActiveSession())
    @F.arrow_udf("array<string>")
    def take_apart(names: pa.Array) -> pa.Array:
        return pa.array([[canonical(w) for w in parse(name or "")] for name in names.to_pylist()], pa.list_(pa.string()))

    return take_apart(name)
