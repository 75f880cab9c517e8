"""Linking mentions in documents to entities: candidates by similar names, and ranks that flow between documents and entities.

1. A mention meets the aliases that share enough letter groups with it. Names are compared over their rarest letter groups only, as many as a
   similar name must share one of, so a frequent letter group makes no long lists; the pairs found are compared whole.
2. Documents and their candidate entities form a graph of two sides. Rank flows from entities to documents and back, damped by a prior; it never
   goes through pairs of entities, so a document with many mentions costs no more than its mentions. An entity mentioned all over is dealt
   over salted copies in the one join it takes part in, and sums are made in the map tasks first.
3. Each mention takes the candidate with the highest product of name similarity and rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.operators.skew import salted_join
from weakloom.session import durable

#: Letters per group, and the share of all groups of both names that they must have in common.
LETTERS, SIMILAR = 3, 0.6
#: Share of rank that flows on; the rest comes from the prior.
DAMPING = 0.85
ROUNDS = 20


def letter_groups(name: Column, n: int = LETTERS) -> Column:
    """Distinct runs of ``n`` letters of the lower-cased name, whose ends are marked."""
    padded = F.concat(F.lit("^"), F.lower(F.trim(name)), F.lit("$"))
    count = F.greatest(F.length(padded) - (n - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(padded, i, n)))


def similar_names(left: DataFrame, right: DataFrame, similar: float = SIMILAR, n: int = LETTERS) -> DataFrame:
    """``(left, right, score)``: pairs of distinct names of two tables ``(name)`` whose letter groups overlap by at least ``similar`` (shared
    over all). Null and blank names have no partner."""
    def grouped(df: DataFrame) -> DataFrame:
        names = df.select("name").where(F.trim("name") != "").distinct()
        return durable(names.select("name", letter_groups(F.col("name"), n).alias("groups")))

    a, b = grouped(left), grouped(right)
    # The number of groups of letters that occur is bounded by the alphabet, not by the number of names.
    counts = a.unionByName(b).select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n"))

    def rarest(df: DataFrame) -> DataFrame:
        listed = salted_join(df.select("name", F.size("groups").alias("size"), F.explode("groups").alias("group")), counts, "group", ["name"])
        placed = listed.withColumn("at", F.row_number().over(W.partitionBy("name").orderBy("n", "group")))
        # Of two names this similar, each has a shared group among its first ones in order of rarity.
        return placed.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similar - 1e-9) + 1).select("name", "group")

    met = rarest(a).withColumnRenamed("name", "left").join(rarest(b).withColumnRenamed("name", "right"), "group").select("left", "right").distinct()
    whole = met.join(a.select(F.col("name").alias("left"), F.col("groups").alias("x")), "left").join(
        b.select(F.col("name").alias("right"), F.col("groups").alias("y")), "right")
    shared = F.size(F.array_intersect("x", "y"))
    score = shared / (F.size("x") + F.size("y") - shared)
    return whole.select("left", "right", score.alias("score")).where(F.col("score") >= similar)


def candidates(mentions: DataFrame, aliases: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(mention, entity, score)``: for each distinct mention the entities with a similar alias, with the score of their best one.

    ``mentions (mention)`` may repeat; ``aliases (entity, alias)`` may give several aliases to an entity and one alias to several.
    """
    pairs = similar_names(mentions.select(F.col("mention").alias("name")), aliases.select(F.col("alias").alias("name")), similar)
    named = aliases.select("entity", F.col("alias").alias("right")).distinct()
    return pairs.join(named, "right").groupBy(F.col("left").alias("mention"), "entity").agg(F.max("score").alias("score"))


def mention_graph(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc, entity, to_doc, to_entity)``, written once: the share of an entity's weight that goes to a document, and of the document's that
    goes to the entity.

    The weight is the score summed over the mentions of the document. ``mentions (doc, mention)`` holds a row per place.
    """
    places = mentions.groupBy("doc", "mention").agg(F.count(F.lit(1)).alias("n"))
    edges = durable(salted_join(places, found, "mention", ["doc"]).groupBy("doc", "entity").agg(F.sum(F.col("n") * F.col("score")).alias("weight")))
    by_doc = edges.groupBy("doc").agg(F.sum("weight").alias("of_doc"))
    by_entity = edges.groupBy("entity").agg(F.sum("weight").alias("of_entity"))
    joined = salted_join(edges, by_entity, "entity", ["doc"]).join(by_doc, "doc")
    return durable(joined.select("doc", "entity", (F.col("weight") / F.col("of_entity")).alias("to_doc"),
                                 (F.col("weight") / F.col("of_doc")).alias("to_entity")))


def entity_ranks(graph: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(entity, rank)`` after so many rounds; ranks add up to 1 over the entities of the graph. Each round is written, so a lost executor
    costs a part of one round."""
    entities = durable(graph.select("entity").distinct())
    n = entities.count()
    ranks = entities.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds if n else 0):
        docs = salted_join(graph.select("doc", "entity", "to_doc"), ranks, "entity", ["doc"]).groupBy("doc").agg(
            F.sum(F.col("rank") * F.col("to_doc")).alias("doc_rank"))
        back = graph.select("doc", "entity", "to_entity").join(docs, "doc").groupBy("entity").agg(
            F.sum(F.col("doc_rank") * F.col("to_entity")).alias("flow"))
        ranks = durable(back.select("entity", (F.lit((1 - damping) / n) + damping * F.col("flow")).alias("rank")))
    return ranks


def link_mentions(mentions: DataFrame, found: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(doc, mention, n, entity, score)``: each distinct mention of each document with the entity it is taken for, or null.

    The highest product of score and rank wins, then the smallest entity. The choice is made once per distinct mention.
    """
    value = F.round(F.col("score") * F.col("rank"), 15)
    best = found.join(ranks, "entity").groupBy("mention").agg(F.min(F.struct((-value).alias("less"), "entity", "score")).alias("best"))
    places = mentions.groupBy("doc", "mention").agg(F.count(F.lit(1)).alias("n"))
    chosen = best.select("mention", "best.entity", "best.score")
    return salted_join(places, chosen, "mention", ["doc"], "left").select("doc", "mention", "n", "entity", "score")
