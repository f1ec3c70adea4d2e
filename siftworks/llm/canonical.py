"""Mapping free-entered values to a canonical list: character n-gram inverted index and weighted cosine."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.places import country_codes, country_names
from ..functions.text import words
from ..tables import cut, ship

# Words that names of countries may have or not.
_STATE_WORDS = "the|of|and|republic|republica|republique|repubblica|republik|federal|federative|commonwealth|confederation|grand|duchy|peoples|sar|de|la|del|province|region|county|canton"
# Words on time, standing or scope around a role.
_ROUND_ROLES = (
    "former|formerly|ex|acting|interim|group|global|regional|since|until|from|current|currently|emea|apac|amer|americas|europe|asia|uk|us|worldwide|international|retired|ret|emeritus|elect|"
    "designate|incoming|outgoing|past|previous|previously|prior|temporary|temp|honorary|hon|ad|the|of|a|and|new|late|then|now|part|full|time|permanent|local|national|division|subsidiary|holding|at|for"
)
# Short and other forms of single words in roles.
_ROLE_WORDS = {
    "exec": "executive", "dir": "director", "dirctr": "director", "direktor": "director", "direktorin": "director", "directeur": "director", "sec": "secretary", "secy": "secretary", "cosec": "company secretary", "corporate": "company",
    "comp": "company", "fin": "financial", "finance": "financial", "op": "operating", "ops": "operating", "operations": "operating", "operation": "operating", "tech": "technology",
    "technical": "technology", "info": "information", "mktg": "marketing", "mkt": "marketing", "hr": "human resources", "pres": "president", "vp": "vice president", "sr": "senior",
    "snr": "senior", "gen": "general", "genl": "general", "mgr": "manager", "man": "managing", "mng": "managing", "bd": "board", "off": "officer", "offr": "officer", "desig": "designated",
    "treas": "treasurer", "prof": "professor", "amb": "ambassador", "sen": "senator", "eng": "engineer", "engr": "engineer", "journo": "journalist", "govt": "", "government": "", "pct": "percent",
    "%": "percent", "holder": "owner", "shareholder": "owner", "10": "ten", "10%": "ten percent", "chairman": "chair", "chairwoman": "chair", "chairperson": "chair", "deputy": "vice", "ned": "non executive director",
    "nonexecutive": "non executive", "md": "managing director", "gm": "general manager", "gc": "general counsel", "mp": "member parliament", "svp": "senior vice president",
    "evp": "executive vice president", "ceo": "chief executive officer", "cfo": "chief financial officer", "coo": "chief operating officer", "cto": "chief technology officer",
    "cio": "chief information officer", "cmo": "chief marketing officer", "clo": "chief legal officer", "chro": "chief human resources officer", "cpo": "chief people officer",
}
# Whole titles that mean an entry.
ROLE_TITLES = {
    "DIR": "Company Director;Directeur;Director General;Administrador;Amministratore;Administrateur", "SEC": "Corporate Secretary;Secretary;Secretary of the Company;Company Sec",
    "CEO": "Chief Executive;Vorstandsvorsitzender;Vorstandsvorsitzende;President Directeur General;PDG;Amministratore Delegato;Consejero Delegado;Chief Exec",
    "MDR": "Geschaftsfuhrer;Geschaeftsfuehrer;Geschaftsfuhrerin;Gerant;Directeur general;Director Gerente", "CFO": "Finanzvorstand;Directeur financier;Director financiero;Finance Chief",
    "CTO": "Technischer Leiter;Directeur technique", "CHA": "Chair;Board Chair;Chairman of the Board;Chair of Board;Aufsichtsratsvorsitzender;Verwaltungsratsprasident",
    "VCH": "Vice Chairman;Deputy Chair;Deputy Chairman", "PRS": "Presidente;Prasident;Praesident;Presidenta;Le President", "VPR": "Vice Pres;Vizeprasident;Vicepresidente;Vice-president",
    "GCO": "Chief Counsel;Leiter Recht;Syndikus", "TRS": "Tresorier;Schatzmeister;Tesorero;Tesoriere;Kassenwart", "OWN": "10% Owner;10 percent holder;10 pct owner;Ten percent holder;Ten-percent shareholder",
    "LDM": "Designated Member;LLP Member;LLP Desig Member", "FDR": "Fondateur;Fundador;Grunder;Gruender;Fondatore;Fondatrice;Fundadora;Grunderin", "COF": "Mitgrunder;Mitgruender;Cofondateur;Cofundador;Co founder;Cofondatore",
    "GMR": "Gen Mgr;Gerente General", "HHR": "HR Head;Head Human Resources;Head of HR;Head of Personnel;HR Lead;Personalleiter;HR Director", "HSL": "Sales Head;Head Sales;Sales Lead;Vertriebsleiter;Head of Selling",
    "BRD": "Member of the Board;Board Mem;Vorstandsmitglied;Vorstand;Miembro del Consejo", "ENG": "Ingenieur;Ingeniero;Ingegnere;Ingenieurin;Ingeniera", "PRF": "Professeur;Profesor;Professore;Professorin;Profesora",
    "MIN": "Ministre;Ministro;Ministerin;Ministra;Government Minister", "SEN": "Senador;Senateur;Senatore;Senatorin;Senadora;Senatrice", "MPA": "Parliament Member;Abgeordneter;Depute;Diputado;Parliamentarian;Deputato",
    "MAY": "Maire;Alcalde;Burgermeister;Buergermeister;Sindaco;Burgermeisterin;Alcaldesa", "AMB": "Botschafter;Embajador;Ambassadeur;Ambasciatore;Botschafterin;Embajadora", "JDG": "Richter;Juge;Juez;Giudice;Richterin;Jueza",
    "JRN": "Journaliste;Periodista;Reporter;Giornalista;Journalistin",
}


def _without(text: Column, dropped: str) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])(?:{dropped})(?![\p{{L}}\p{{N}}])", " "), r"\s+", " "))
    return F.when(bare == "", text).otherwise(bare)


def country_words(value: Column) -> Column:
    """Words of a country's name in order, without those it may have or not; all of them if nothing else is left."""
    return _without(words(value), _STATE_WORDS)


def role_words(value: Column) -> Column:
    """Words of a role spelled out, without those on time, standing or scope; numbers but 10 are dropped with them."""
    text = F.regexp_replace(F.regexp_replace(words(value), r"(?<=\d)%", " %"), r"\bnon[ -]?exec(utive)?\b", "non executive")
    text = F.regexp_replace(F.regexp_replace(text, r"\bco (?=s)", "company "), r"\bco (?=\p{L})", "co")
    listed = F.split(_without(text, _ROUND_ROLES + r"|(?!10(?![\p{N}]))\p{N}+"), " ")
    table = F.create_map(*[F.lit(x) for kv in _ROLE_WORDS.items() for x in kv])
    full = F.transform(listed, lambda w: F.coalesce(F.element_at(table, w), w))
    return F.trim(F.regexp_replace(F.array_join(full, " "), r"\s+", " "))


def grams(text: str) -> list[str]:
    """Distinct character bigrams and trigrams of the words, each word with a mark at either end."""
    padded = [f"^{w}$" for w in text.split(" ")]
    return list(dict.fromkeys(w[i : i + n] for n in (2, 3) for w in padded for i in range(max(len(w) - n + 1, 1))))


class Index:
    """Inverted index of ``(code, alias)`` by gram, small enough for every Python worker: it grows with the list, not with the data."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.pairs = sorted(pairs)  # equal codes side by side
        self.lengths = np.array([len(alias.replace(" ", "")) for _, alias in self.pairs])
        codes = [code for code, _ in self.pairs]
        self.starts = np.array([i for i, code in enumerate(codes) if not i or code != codes[i - 1]])
        self.nth_code = np.cumsum([not i or code != codes[i - 1] for i, code in enumerate(codes)]) - 1
        held: dict[str, list[int]] = {}
        for i, (_, alias) in enumerate(self.pairs):
            for gram in grams(alias):
                held.setdefault(gram, []).append(i)
        self.unseen = math.log(len(pairs) + 1.0) / 2
        self.held = {gram: (math.log((len(pairs) + 1.0) / len(at)), np.array(at, "int32")) for gram, at in held.items()}
        squares = np.zeros(len(pairs))
        for w, at in self.held.values():
            squares[at] += w * w
        self.norms = np.sqrt(squares)

    def near(self, norm: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Aliases, by number, with a gram of ``norm`` that are close enough by cosine or by length; the largest cosine among those of their code."""
        found = [self.held.get(gram) for gram in grams(norm)]
        dot, square = np.zeros(len(self.pairs)), 0.0
        for hit in found:
            square += hit[0] ** 2 if hit else self.unseen**2
            if hit:
                dot[hit[1]] += hit[0] * hit[0]
        score = dot / (self.norms * math.sqrt(square))
        # neither close by cosine nor, by their lengths, within the edits allowed: such a pair decides nothing
        possible = (dot > 0) & ((score >= least) | (np.abs(self.lengths - len(norm.replace(" ", ""))) <= max(len(norm) // 4, 1)))
        at = np.flatnonzero(possible)
        return at, np.maximum.reduceat(np.where(possible, score, -1.0), self.starts)[self.nth_code[at]]


def cosines(values: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """``(value, norm, code, alias, score)``: values ``(value, norm)`` beside the aliases of ``entries`` that ``Index.near`` gives for them.

    The rows that the index multiplies are added up where they are made, in Arrow batches beside a copy of the index; as
    rows of their own they would be a hundred times the grams.
    """
    spark = values.sparkSession
    ship(spark)
    schema = "value string, norm string, code string, alias string, score double"
    listed = entries.select("code", "alias").toArrow()
    if not listed.num_rows:
        return values.select("value", "norm", F.lit("").alias("code"), F.lit("").alias("alias"), F.lit(0.0).alias("score")).where("false")
    index = spark.sparkContext.broadcast(Index(list(zip(listed["code"].to_pylist(), listed["alias"].to_pylist(), strict=True))))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        codes, aliases = (pa.array(side) for side in zip(*known.pairs, strict=True))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                met = [known.near(norm, least) for norm in part.column("norm").to_pylist()]
                nth = np.repeat(np.arange(len(met)), [len(at) for at, _ in met])
                at, score = np.concatenate([at for at, _ in met]), np.concatenate([score for _, score in met])
                yield pa.RecordBatch.from_arrays([part.column("value").take(pa.array(nth)), part.column("norm").take(pa.array(nth)), codes.take(pa.array(at)), aliases.take(pa.array(at)), pa.array(score)], ["value", "norm", "code", "alias", "score"])

    return values.select("value", "norm").mapInArrow(beside, schema)


def canonical_codes(
    values: DataFrame, entries: DataFrame, exact: DataFrame, normalise: Callable[[Column], Column], threshold: float = 0.5, margin: float = 0.03, least_length: int = 4
) -> DataFrame:
    """``(value, code, score)`` for each distinct value; ``code`` is NULL where no entry is close enough.

    ``entries`` has ``code, alias`` for names that may be misspelt, ``exact`` the same for codes and short forms, which
    count only when written exactly. Values are deduplicated and normalised. One that equals an alias, or whose parts
    between brackets, dashes and slashes do, takes its code (score 1; the longest part first). The others are broken
    into character bigrams and trigrams and meet the aliases in an inverted index; grams weigh by their rarity among
    the aliases, unseen ones half as much as the rarest. The best alias of each code is scored by cosine, and the best code is
    accepted if its cosine reaches ``threshold`` and exceeds the next code's by ``margin``, or, as an exact check of
    misspellings, if it alone has the least edit distance, at most a quarter of the letters and at least one.

    Everything is keyed by distinct value, so a value that a third of all rows share is scored once. The index grows with
    the list and not with the data, and is broadcast to the Python workers.

    NULL and blank values have no row. A value of fewer than ``least_length`` letters can only match exactly. Aliases that several codes
    share take the smallest code in the exact step. Values keep their spelling; extra columns are not read.
    """
    distinct = values.select("value").where("value is not null and trim(value) <> ''").distinct().withColumn("norm", normalise(F.col("value")))
    distinct = cut(distinct.withColumn("parts", F.array_distinct(F.filter(F.transform(F.split("value", r"[()\[\]/,;|]|\s-\s"), normalise), lambda p: p != ""))))
    known = cut(entries.unionByName(exact).withColumn("alias", normalise(F.col("alias"))).where("alias <> ''").groupBy("alias").agg(F.min("code").alias("code")))
    asked = distinct.select("value", F.col("norm").alias("alias"), F.lit(9999).alias("size")).unionByName(
        distinct.select("value", F.explode("parts").alias("alias")).withColumn("size", F.length("alias"))
    )
    hit = asked.join(known, "alias").groupBy("value").agg(F.max_by("code", F.struct("size", "alias")).alias("code"))
    sure = cut(hit.select("value", "code", F.lit(1.0).alias("score")))
    open_ = cut(distinct.join(sure, "value", "left_anti").where(F.length("norm") >= least_length).select("value", "norm"))
    fuzzy = cut(entries.withColumn("alias", normalise(F.col("alias"))).where(F.length("alias") >= least_length).select("code", "alias").distinct())
    # spread by value before the index multiplies the rows, in as many tasks as the session asks for
    tasks = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = cosines(open_.repartition(tasks, "value"), fuzzy, threshold - margin)
    near = F.floor(F.greatest(F.length("norm") / 4.0, F.lit(1.0)))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    letters = lambda c: F.array_sort(F.split(c, ""))
    edits = F.levenshtein(bare("norm"), bare("alias"))
    scored = scored.withColumn("away", F.when((edits == 2) & (letters("norm") == letters("alias")), 1).otherwise(edits))  # two swapped letters are one edit
    # a code that is neither close by cosine nor, by its edits, within what is accepted below decides nothing
    scored = scored.where((F.col("score") >= threshold - margin) | (F.col("away") <= F.greatest(F.length("norm") * 0.5, F.lit(2.0))))
    per_code = cut(scored.groupBy("value", "norm", "code").agg(F.max("score").alias("score"), F.min("away").alias("away")))
    by_score = Window.partitionBy("value").orderBy(F.desc("score"), "code")
    by_edits = Window.partitionBy("value").orderBy("away", F.desc("score"), "code")
    marked = per_code.withColumn("k", F.row_number().over(by_score)).withColumn("next", F.lead("score", 1, 0.0).over(by_score))
    marked = marked.withColumn("e", F.row_number().over(by_edits)).withColumn("next_away", F.lead("away", 1, 99).over(by_edits))
    typed = (F.col("e") == 1) & (F.col("away") <= near) & (F.col("away") < F.col("next_away"))
    close = (F.col("k") == 1) & (F.col("score") >= threshold) & (F.col("score") - F.col("next") >= margin) & (F.col("away") <= F.greatest(F.length("norm") * 0.5, F.lit(2.0)))
    taken = marked.where(typed | close).groupBy("value").agg(F.max_by("code", F.struct(typed, "score")).alias("code"), F.max("score").alias("score"))
    found = sure.unionByName(taken)
    return distinct.select("value").join(found, "value", "left")


def country_entries(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Aliases for ``canonical_codes`` over all ISO countries, and their codes."""
    pairs = lambda rows: spark.createDataFrame(rows, "code string, alias string")
    return pairs(country_names(spark)), pairs(country_codes(spark))


def role_entries(spark: SparkSession, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases for ``canonical_codes`` over a table ``code, title``: the titles and, for codes that are known, other titles."""
    own = titles.select("code", F.col("title").alias("alias"))
    more = spark.createDataFrame([(k, t) for k, names in ROLE_TITLES.items() for t in names.split(";")], "code string, alias string").join(titles.select("code").distinct(), "code", "left_semi")
    return own.unionByName(more), own.where("false")


def canonical_countries(spark: SparkSession, values: DataFrame) -> DataFrame:
    return canonical_codes(values, *country_entries(spark), country_words)


def canonical_roles(spark: SparkSession, values: DataFrame, titles: DataFrame) -> DataFrame:
    return canonical_codes(values, *role_entries(spark, titles), role_words)
