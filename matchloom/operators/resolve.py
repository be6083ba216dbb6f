"""Entity resolution against a pool of canonical names: a join on the rarest tokens, ranked by share, token distance and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import normalise, tokens
from matchloom.sources.files import kept


def _keys(t: Column, own: str, other: str) -> Column:
    """Keys of a token: two tokens share one exactly if one starts the other or if they may be at most one edit apart.

    `own` marks a token's beginnings, `other` the token itself; for the other side the two are exchanged. Tokens one
    edit apart share a form with a letter taken out (or one is such a form of the other).
    """
    at = F.sequence(F.lit(1), F.length(t))
    starts = F.transform(at, lambda i: F.concat(F.lit(own), F.substr(t, F.lit(1), i)))
    without = F.transform(at, lambda i: F.concat(F.lit("-"), F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
    return F.array_distinct(F.concat(starts, F.array(F.concat(F.lit(other), t), F.concat(F.lit("-"), t)), without))


def _ranked(pairs: DataFrame, similarity) -> DataFrame:
    """The best candidate of each name with its ratio, and whether the next is as good in all three numbers."""
    ratio, distance, edit = similarity(F.col("a"), F.col("b"))
    scored = pairs.select("source_name", "name", ratio.alias("ratio"), distance.alias("distance"), edit.alias("edit"))
    w = Window.partitionBy("source_name").orderBy(F.desc("ratio"), "distance", "edit", "name")
    key = F.struct("ratio", "distance", "edit")
    return scored.select("source_name", "name", "ratio", F.coalesce(F.lead(key).over(w) == key, F.lit(False)).alias("tied"), F.row_number().over(w).alias("k")).where("k = 1").drop("k")


def resolve(names: DataFrame, pool: DataFrame, similarity, least: float = 0.5, short: int = 0) -> DataFrame:
    """(source_name, canonical, method, ratio): exact after normalising, else the best by similarity (share, token distance, edits).

    A share of `least` of n tokens leaves out fewer than n - least * n + 1 of them, so a candidate has one of any so many.
    A name therefore looks for candidates by as many tokens as that, those with the fewest hits in the pool, and never by a
    common one unless it has no other. Names without a candidate of `least` go by all tokens once more, for
    their ratio only. Both are equi-joins, so nothing is lost at any size of the pool. Normal forms of at most `short` letters
    match exactly or not at all. A null name matches nothing, one without tokens only its equal.
    """
    every = names.select("source_name").distinct()
    s = kept(every.where("source_name IS NOT NULL").select("source_name", normalise(F.col("source_name")).alias("a")))
    p = kept(pool.select("name", normalise(F.col("name")).alias("b")).where("name IS NOT NULL"))
    exact = s.join(p.withColumnRenamed("b", "a"), "a").groupBy("source_name").agg(F.min("name").alias("name"))
    exact = kept(exact.select("source_name", "name", F.lit("exact").alias("method"), F.lit(1.0).alias("ratio")))
    rest = s.where(F.length("a") > short).join(exact.select("source_name"), "source_name", "left_anti")
    known = kept(p.select("name", "b", F.explode(F.array_distinct(F.flatten(F.transform(tokens(F.col("b")), lambda t: _keys(t, ">", "<"))))).alias("key")))
    words = kept(rest.select("source_name", "a", F.posexplode(tokens(F.col("a"))).alias("at", "t")))
    keyed = words.select("t").distinct().select("t", F.explode(_keys(F.col("t"), "<", ">")).alias("key"))
    hits = keyed.join(known.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("t").agg(F.sum("n").alias("hits"))
    rarest = F.array_sort(F.collect_list(F.struct(F.coalesce("hits", F.lit(0)).alias("hits"), "at", "t")))
    chosen = words.join(hits, "t", "left").groupBy("source_name", "a").agg(rarest.alias("w"), F.count(F.lit(1)).alias("n"))
    enough = (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int")
    chosen = chosen.select("source_name", "a", F.explode(F.slice("w", F.lit(1), enough)).alias("w")).select("source_name", "a", F.col("w.t").alias("t"))

    def candidates(of: DataFrame) -> DataFrame:
        looked = of.select("source_name", "a", F.explode(_keys(F.col("t"), "<", ">")).alias("key")).distinct()
        return looked.join(known, "key").select("source_name", "a", "name", "b").distinct()

    found = kept(_ranked(candidates(chosen), similarity).where(F.col("ratio") >= least))
    fuzzy = found.select("source_name", F.when(~F.col("tied"), F.col("name")).alias("name"), F.when(F.col("tied"), "ambiguous").otherwise("fuzzy").alias("method"), "ratio")
    low = _ranked(candidates(words.join(found.select("source_name"), "source_name", "left_anti")), similarity)
    low = low.select("source_name", F.lit(None).cast("string").alias("name"), F.lit("below_threshold").alias("method"), "ratio")
    said = exact.unionByName(fuzzy).unionByName(low)
    out = every.join(said, every["source_name"].eqNullSafe(said["source_name"]), "left").select(every["source_name"], "name", "method", "ratio")
    return out.select("source_name", F.col("name").alias("canonical"), F.coalesce("method", F.lit("below_threshold")).alias("method"), F.round(F.coalesce("ratio", F.lit(0.0)), 6).alias("ratio"))
