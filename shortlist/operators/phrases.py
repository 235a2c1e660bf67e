"""Phrases of a word list found in texts by a join.

Texts become the n-grams of their words, for the lengths that the list has, and meet the list by a hash join on
the phrase. The cost per text depends on its words alone, so a list of a hundred spellings and one of a million cost
the same. The list is a table like any other: Spark broadcasts it while it is small and shuffles it when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shortlist.operators import jd


def phrase_table(spark: SparkSession, skills: dict[str, list[str]] | None = None) -> DataFrame:
    """``(phrase, name, rank)``: every spelling of every skill; the rank decides between equal mentions.

    Spark does not know how small rows from the driver are and would shuffle all runs of all texts to meet them; they have passed
    through the driver already, so they are sent to the tasks.
    """
    rows = [(r["spelling"], r["name"], r["rank"]) for r in jd.spelling_rows(skills)]
    return F.broadcast(spark.createDataFrame(rows, "phrase string, name string, rank int"))


def lengths_of(phrases: DataFrame) -> list[int]:
    """The numbers of words that phrases have: a handful, whatever the table's size."""
    found = phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect()
    return sorted(r["n"] for r in found)


def grams(words: Column, lengths: list[int]) -> Column:
    """The distinct runs of so many neighbouring words, joined by single spaces."""
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        if n == 1:
            return F.coalesce(words, none)
        run = lambda word, at: F.concat_ws(" ", word, *[F.get(words, at + k) for k in range(1, n)])
        return F.when(F.size(words) >= n, F.slice(F.transform(words, run), 1, F.size(words) - (n - 1))).otherwise(none)

    return F.array_distinct(F.concat(none, *map(runs, lengths)))



def occurrences(texts: DataFrame, words: str, phrases: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """The rows of ``texts`` once per phrase of the list that stands among their ``words``, with the phrase's columns."""
    lengths = lengths_of(phrases) if lengths is None else lengths
    rows = texts.withColumn("phrase", F.explode(grams(F.col(words), lengths))).drop(words)
    return rows.join(phrases, "phrase")


#: Stands for a capital R standing alone, in the list and among the runs of a text; no sentence holds it.
LONE = "\0R"


def _part(section: str, default: str, text: str, cues: str) -> Column:
    """A part of a description: its name, default context and text as words, and its sentences with cues."""
    low = jd._wordlike(F.lower(text))
    words = F.concat(F.split(low, " "), F.when(F.col(text).rlike(r"(?U)\bR\b"), F.array(F.lit(LONE))).otherwise(F.array().cast("array<string>")))
    sentences = F.transform(cues, lambda s, i: s.withField("low", jd._wordlike(s["low"])).withField("pos", i))
    return F.struct(F.lit(section).alias("section"), F.lit(default).alias("default"), words.alias("words"), sentences.alias("cues"))


def word_mentions(parsed: DataFrame, skills: dict[str, list[str]] | None = None, caps: jd.Caps = jd.CAPS, id_col: str = "jd_id",
                  phrases: DataFrame | None = None) -> DataFrame:
    """What ``jd.with_skills(match="word")`` finds, one row per mention: id, ``name``, ``context``, ``confidence``, ``section``, ``nth``.

    ``parsed`` comes from ``jd.with_clean_text``; ids name one description each. ``phrases`` replaces the list of
    spellings by a table ``(phrase, name, rank)`` of any size.
    """
    spark = parsed.sparkSession
    # A capital R standing alone counts as the language, with no context of its own.
    lone = spark.createDataFrame([(LONE, "R", jd.lone_r_rank(skills))], "phrase string, name string, rank int")
    table = (phrase_table(spark, skills) if phrases is None else phrases.select("phrase", "name", "rank")).unionByName(lone)
    table = F.broadcast(table) if phrases is None else table
    cued = jd.with_cues(parsed)
    parts = F.array(_part("requirements", jd.MUST, "_must_text", "_must_cues"), _part("preferred", jd.NICE, "_nice_text", "_nice_cues"))
    texts = cued.select(id_col, F.explode(parts).alias("s")).select(id_col, "s.section", "s.default", "s.words", "s.cues")
    # A spelling must stand in the part as a whole. Where it does, the first of the most confident of its sentences wins.
    if phrases is None:
        found = occurrences(texts, "words", table)
    else:  # a list of any size may be shuffled to, so runs travel alone and meet their sentences afterwards
        listed = occurrences(texts.select(id_col, "section", "words"), "words", table).distinct()
        found = listed.join(texts.drop("words"), [id_col, "section"])
    within = F.filter("cues", lambda s: F.contains(s["low"], F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    places = F.concat(
        F.array(F.struct((-F.lit(0.60)).alias("minus"), F.lit(-1).alias("pos"), F.col("default").alias("context"), F.lit(False).alias("negated"))),
        F.transform(within, lambda s: F.struct((-s["confidence"]).alias("minus"), s["pos"].alias("pos"), s["context"].alias("context"), s["negated"].alias("negated"))),
    )
    found = found.select(id_col, "section", "phrase", "name", "rank", F.array_min(places).alias("best"), F.exists(places, lambda s: s["negated"]).alias("negated"))
    hits = found.groupBy(id_col, "section", "phrase", "name", "rank").agg(F.bool_or("negated").alias("negated"), F.min("best").alias("best"))
    hits = hits.select(
        id_col, "section", "name", "rank", F.when(F.col("negated"), jd.NICE).otherwise(F.col("best.context")).alias("context"),
        F.when(F.col("negated"), -0.55).otherwise(F.col("best.minus")).alias("minus"),
    )
    top = hits.groupBy(id_col, "section", "name").agg(F.min(F.struct("minus", "rank", "context")).alias("top"), F.min("rank").alias("rank"))
    order = Window.partitionBy(id_col, "section").orderBy(F.col("top.context") != jd.MUST, "top.minus", "rank", "name")
    listed = top.withColumn("nth", F.row_number().over(order))
    if caps.mentions is not None:
        listed = listed.where(F.col("nth") <= caps.mentions)
    # A skill is never in both lists.
    both = Window.partitionBy(id_col, "name")
    listed = listed.withColumn("_must", F.max(F.col("section") == "requirements").over(both))
    listed = listed.where((F.col("section") == "requirements") | ~F.col("_must"))
    return listed.select(id_col, "name", F.col("top.context").alias("context"), (-F.col("top.minus")).alias("confidence"), "section", "nth")
