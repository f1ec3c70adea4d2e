"""The extraction pipeline: a registry of exchangeable parts and the stages that run them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.labels import sentiment
from .functions.normalize import entity_form, triple_key
from .tables import ship

KINDS = ("splitter", "extractor", "qualifier", "labeler", "taxonomy")


@dataclass(order=True)
class Part:
    """A named part; the smaller ``priority`` comes first. ``entity_types`` restricts qualifiers."""

    priority: int
    name: str
    make: Callable = field(compare=False)
    entity_types: frozenset[str] = field(default=frozenset(), compare=False)


class Registry:
    """Parts by kind. A splitter maps a text Column to an array of sentences; the others map DataFrames to DataFrames."""

    def __init__(self) -> None:
        self.parts: dict[str, list[Part]] = {k: [] for k in KINDS}

    def register(self, kind: str, name: str, priority: int = 100, entity_types: Iterable[str] = ()) -> Callable:
        def keep(make: Callable) -> Callable:
            if any(p.name == name for p in self.parts[kind]):
                raise ValueError(f"{kind} {name} is registered already")
            self.parts[kind].append(Part(priority, name, make, frozenset(entity_types)))
            self.parts[kind].sort()
            return make

        return keep

    def all(self, kind: str, disabled: Iterable[str] = (), entity_type: str | None = None) -> list[Part]:
        return [p for p in self.parts[kind] if p.name not in set(disabled) and (not p.entity_types or entity_type is None or entity_type in p.entity_types)]

    def first(self, kind: str, disabled: Iterable[str] = ()) -> Part | None:
        return next(iter(self.all(kind, disabled)), None)


registry = Registry()


def parse_stages(text: str, last: int = 5) -> list[int]:
    """``1-3,5`` as [1, 2, 3, 5]; numbers outside 1 to ``last`` are refused."""
    out: set[int] = set()
    for part in text.split(","):
        low, _, high = part.strip().partition("-")
        out |= set(range(int(low), int(high or low) + 1))
    if not out <= set(range(1, last + 1)):
        raise ValueError(f"stages are 1 to {last}")
    return sorted(out)


@registry.register("splitter", "rules", 100)
def split_sentences(text: Column) -> Column:
    """Stand-in for a model: sentences end at . ! ? before a space, and at line ends; those without a letter are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: s.rlike(r"\p{L}"))


# Verbs that relate two names, and the kind of relation.
RELATIONS = {"acquired": "ownership", "owns": "ownership", "announced": "communication", "appointed": "employment", "joined": "employment", "founded": "ownership", "launched": "product", "is": "attribute", "leads": "employment"}


@registry.register("extractor", "patterns", 100)
def extract_triples(sentences: DataFrame) -> DataFrame:
    """Stand-in for a model: capitalised words, a known verb, and what follows up to the next mark."""
    hit = rf"^(.*?\b(?:\p{{Lu}}[\p{{L}}&.-]*\s+)+)({'|'.join(RELATIONS)})\s+([^,;.!?]+)"
    part = lambda i: F.trim(F.regexp_extract("sentence", hit, i))
    kinds = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    found = sentences.where(F.col("sentence").rlike(hit)).withColumns({"subject": part(1), "predicate": part(2), "object": part(3)})
    return found.withColumns({"predicate_category": F.element_at(kinds, F.col("predicate")), "confidence": F.lit(0.8), "source_text": F.col("sentence")})


@registry.register("labeler", "sentiment", 100)
def label_sentiment(statements: DataFrame) -> DataFrame:
    s = sentiment(F.concat_ws(" ", "predicate", "source_text"))
    return statements.withColumn("labels", F.array_append(F.col("labels"), F.struct(F.lit("sentiment").alias("label_type"), s["label"].alias("label_value"), s["confidence"].alias("confidence"))))


@registry.register("labeler", "relation_type", 200)
def label_relation(statements: DataFrame) -> DataFrame:
    one = F.struct(F.lit("relation_type").alias("label_type"), F.col("predicate_category").alias("label_value"), F.col("confidence").cast("double").alias("confidence"))
    return statements.withColumn("labels", F.when(F.col("predicate_category").isNull(), F.col("labels")).otherwise(F.array_append("labels", one)))


def hash_embedding(text: Column, width: int = 64) -> Column:
    """Stand-in for a model: words hashed into ``width`` signed buckets, length one; no meaning beyond shared words."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(width)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h & 1 << 20 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed(text)


def run(documents: DataFrame, stages: str = "1-5", disabled: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statements of documents: split, extract, qualify, label, classify; duplicates within a document are dropped after extraction.

    Sentences are classified once per distinct text and joined back. ``entity_ref`` is a hash of where an entity occurs, the
    same for every run. Stages that are left out pass their input on with empty results.
    """
    wanted = parse_stages(stages)
    splitter = registry.first("splitter", disabled)
    text = F.col(text_col)
    split = splitter.make(text) if 1 in wanted and splitter else F.array(text)
    sentences = documents.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(split).alias("sentence_no", "sentence"))
    if 2 not in wanted:
        return sentences
    once = sentences.select("sentence").distinct()
    found = None
    for part in registry.all("extractor", disabled):
        rows = part.make(once)
        found = rows if found is None else found.unionByName(rows)
    joined = sentences.join(found, "sentence").withColumn("triple_hash", triple_key(F.col("subject"), F.col("predicate"), F.col("object")))
    first = joined.groupBy("doc_id", "triple_hash").agg(F.min_by(F.struct(*joined.columns), F.struct("sentence_no", "subject")).alias("r")).select("r.*")
    ref = lambda role: F.sha2(F.concat_ws("|", "doc_id", "sentence_no", F.lit(role), role), 256)
    out = first.withColumns({"subject_ref": ref("subject"), "object_ref": ref("object"), "labels": F.array().cast("array<struct<label_type: string, label_value: string, confidence: double>>")})
    if 3 in wanted:
        out = out.withColumns({"subject_name": entity_form(F.col("subject")), "object_name": entity_form(F.col("object"))})
        for part in registry.all("qualifier", disabled):
            out = part.make(out)
    if 4 in wanted:
        for part in registry.all("labeler", disabled):
            out = part.make(out)
    if 5 in wanted:
        for part in registry.all("taxonomy", disabled):
            out = part.make(out)
    return out


def greedy_dedup(statements: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Statements without those whose ends equal an earlier one's, either way round, and whose predicates' embeddings are close.

    ``statements`` has ``seq, subject, predicate, object, embedding``. Within a pair of ends, in order of ``seq``, each one
    is compared with those kept so far and the first close one takes it in. Statements of one pair and the same predicate
    text are reduced to the first before the groups meet, so a group is as large as its pair has predicates.
    """
    ends = lambda f: f(entity_form(F.col("subject")), entity_form(F.col("object")))
    keyed = statements.withColumns({"_a": ends(F.least), "_b": ends(F.greatest), "_p": F.lower(F.trim("predicate"))})
    first = keyed.groupBy("_a", "_b", "_p").agg(F.min_by(F.struct("seq", "embedding"), "seq").alias("r")).select("_a", "_b", "r.*")

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, np.ndarray]] = []
        for seq, v in rows.sort_values("seq")[["seq", "embedding"]].itertuples(index=False):
            v = np.asarray(v, float)
            if not any(v @ k >= threshold * (np.linalg.norm(v) * np.linalg.norm(k)) and v @ k > 0 for _, k in kept):
                kept.append((seq, v))
        return pd.DataFrame({"seq": [s for s, _ in kept]})

    seqs = first.groupBy("_a", "_b").applyInPandas(keep, "seq bigint")
    return statements.join(seqs, "seq", "left_semi")
