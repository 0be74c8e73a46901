"""Identities put in place of others, wherever they stand: columns, arrays, and fields of structs in arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..shared import hot_join, written
from .facts import dedupe_rewritten
from .lifecycle import resolve_identities


def _ids(df: DataFrame, column: str) -> Column:
    """All ids in a column, as an array; for ``a.x`` those in the field x of the structs of the array a."""
    name, _, field = column.partition(".")
    if field:
        return F.transform(name, lambda s: s[field])
    return F.col(name) if dict(df.dtypes)[name].startswith("array") else F.array(name)


def _put(df: DataFrame, column: str, to: Column) -> Column:
    """The column with ids as the map ``to`` has them."""
    name, _, field = column.partition(".")
    new = lambda i: F.coalesce(F.try_element_at(to, i), i)
    if field:
        return F.transform(name, lambda s: s.withField(field, new(s[field])))
    return F.transform(name, new) if dict(df.dtypes)[name].startswith("array") else new(F.col(name))


def rewritten(df: DataFrame, mapping: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``df`` (``key`` unique) with each id in ``columns`` that ``mapping`` (id, target) knows replaced, and changed.

    A column is one of ids, of arrays of them, or a field of structs in an array, written ``relations.subject``. Only the
    distinct pairs of row and id meet the mapping, by a join that leaves a hot id's rows where they are; only rows with a
    mapped id get a map of their own. Equal ids in an array of ids become one. Null ids and columns stay.
    """
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(_ids(df, c), F.array().cast("array<string>")) for c in columns])))
    pairs = written(df.select(key, F.explode(every).alias("id_")).where("id_ IS NOT NULL"), "pairs")
    known = mapping.where("id IS NOT NULL AND target IS NOT NULL AND id <> target").groupBy(F.col("id").alias("id_")).agg(F.min("target").alias("target"))
    often = written(pairs.groupBy("id_").agg(F.count("*").alias("rows")).join(known, "id_"), "often")
    met = hot_join(pairs, often, ["id_"], "rows", pairs.count())
    own = met.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id_", "target"))).alias("_to"))
    both = df.join(own, key, "left")
    for c in dict.fromkeys(columns):
        name = c.partition(".")[0]
        new = _put(both, c, F.col("_to"))
        both = both.withColumn(name, F.when(F.col("_to").isNull(), F.col(name)).otherwise(F.array_distinct(new) if dict(df.dtypes)[name] == "array<string>" else new))
    return both.withColumn("changed", F.col("_to").isNotNull()).select(*df.columns, "changed")


def bind_identities(records: DataFrame, facts: DataFrame, names: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending ids (legacy:user:<number>) of records, facts and names become the one known id with their number.

    Ambiguous and unknown ones stay. Facts that changed get a new fingerprint of session, subject, category, text and
    relations, and those that then agree become one (dedupe_rewritten()). Gives records and names with changed, and the
    facts: id, sid, subject, fingerprint, sources, tags, importance, n.
    """
    pending = lambda df, *cs: [df.select(F.explode(F.coalesce(_ids(df, c), F.array().cast("array<string>"))).alias("id")) for c in cs]
    used = [*pending(records, "sid", "users"), *pending(facts, "sid", "subject", "src_user", "relations.subject", "relations.object"), *pending(names, "entity")]
    ids = used[0]
    for u in used[1:]:
        ids = ids.unionByName(u)
    mapping = written(resolve_identities(ids.where(F.col("id").startswith("legacy:user:")).distinct(), known).select("id", F.col("resolved").alias("target")).where("id <> target"), "mapping")
    new_records = rewritten(records, mapping, ["sid", "users"])
    new_facts = rewritten(facts, mapping, ["sid", "subject", "src_user", "relations.subject", "relations.object"])
    told = F.array_join(F.array_sort(F.transform("relations", lambda r: F.concat_ws("\x1e", r.subject, r.predicate, r.object))), "\x1d")
    print_ = X.fingerprint(F.col("sid"), F.col("subject"), F.col("category"), F.col("content"), told)
    new_facts = new_facts.withColumn("fingerprint", F.when(F.col("changed"), print_).otherwise(F.col("fingerprint")))
    new_names = rewritten(names.withColumn("_n", F.monotonically_increasing_id()), mapping, ["entity"], "_n").drop("_n")
    return new_records, dedupe_rewritten(new_facts), new_names
