"""Which entities many texts name: all texts against all names at once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..shared import written

AUTOMATON_BYTES = 2 << 20  # of names that an automaton in every task may hold


def _names(entities: DataFrame, former: DataFrame) -> DataFrame:
    """word and entity: present and former names of two characters or more, ids of four or more; only of known entities."""
    named = entities.select("entity", X.squeeze(F.col("name")).alias("word")).unionByName(former.join(entities.select("entity"), "entity", "left_semi").select("entity", X.squeeze(F.col("name")).alias("word")))
    own = entities.select("entity", F.col("entity").alias("word")).where(F.length("word") >= 4)
    return named.where(F.length("word") >= 2).unionByName(own).distinct()


def _by_automaton(texts: DataFrame, words: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ahocorasick.Automaton()
        for w in words:
            found.add_word(w, w)
        found.make_automaton()
        for g in batches:
            rows = [(i, w) for i, text in zip(g["id"], g["text"]) for w in {w for _, w in found.iter(text)}] if words else []
            yield pd.DataFrame(rows, columns=["id", "word"])

    return texts.mapInPandas(run, f"id {dict(texts.dtypes)['id']}, word string")


def _grams(c: Column) -> Column:
    return F.array_distinct(X._pairs(c))


def _by_rarest(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Each word goes to the texts that hold its rarest pair of letters; those that hold it whole stay."""
    of_words = words.select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    of_texts = written(texts.select("id", F.explode(_grams(F.col("text"))).alias("gram")).join(of_words.select("gram").distinct(), "gram", "left_semi"), "grams")
    often = of_texts.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_words.join(often, "gram").groupBy("word").agg(F.count("*").alias("known"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    whole = words.select("word", F.size(_grams(F.col("word"))).alias("all"))
    keys = rarest.join(whole, "word").where(F.col("known") == F.col("all")).select("word", "gram")
    near = of_texts.join(keys, "gram").select("id", "word")
    return near.join(texts, "id").where(F.contains("text", F.col("word"))).select("id", "word")


def mentions(texts: DataFrame, entities: DataFrame, former: DataFrame, visible: DataFrame | None = None, most: int = 20, longest: int | None = 500, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """For each text the entities that it names, at most ``most``, the latest updated first: id, entity, place (from 1).

    texts: id (unique), text; entities: entity, name, updated; former: entity, name. Blanks that squeeze() takes out count on
    neither side. A text is asked only if it has 2 to ``longest`` characters; null texts and names name nothing. With
    ``visible`` (id, entity) a text names only entities that it may. Names go to every task as an automaton while they take
    no more than ``automaton_bytes``; beyond, words meet texts by their rarest pair of letters. Both give the same rows.
    """
    asked = texts.select("id", X.squeeze(F.col("text")).alias("text")).where(F.length("text") >= 2)
    asked = asked.where(F.length("text") <= longest) if longest else asked
    names = written(_names(entities, former), "names")
    words = names.select("word").distinct()
    size = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    met = _by_automaton(asked, [r["word"] for r in words.collect()]) if size <= automaton_bytes else _by_rarest(asked, words)
    found = met.join(names, "word").select("id", "entity").distinct()
    found = found.join(visible.select("id", "entity"), ["id", "entity"], "left_semi") if visible is not None else found
    latest = entities.groupBy("entity").agg(F.max("updated").alias("updated"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated"), "entity"))
    return found.join(latest, "entity").withColumn("place", place).where(F.col("place") <= most).select("id", "entity", "place")
