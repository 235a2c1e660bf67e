"""Exact deduplication by deterministic block naming.

The lower-cased text (A-Z only) of a document is cut into blocks of a fixed number of bytes. Equal
blocks get one integer name: blocks are ordered by hash and content, and a name is the position in
that order. Then adjacent pairs of names are named in the same way, again and again, until each
document has one name. Names come from comparing contents, or pairs of integers, so two
documents of one length have the same last name exactly if their texts are equal.

Contents are moved once, to find the distinct blocks; their occurrences are then named by their
hash. Should different blocks share a hash, the occurrences of these blocks alone are named by content.

Every step is a DataFrame operation. Distinct blocks and distinct pairs are combined before their
shuffle, and hot names are split by Spark when they are joined. Each level is written to the
shared folder; levels grow with the logarithm of the longest text.

Defined cases: a null text is the empty text, and equal to it; of rows that repeat an id and a text, one
stays; a null id is smaller than any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import Stage, ascii_lower, text_of


def numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """``name``: integers that grow in the order of ``by``, one for each row."""
    return distinct.sort(*by).withColumn("name", F.monotonically_increasing_id())


def named_blocks(blocks: DataFrame, stage: Stage, hashed: str = "hash", content: str = "block") -> DataFrame:
    """The rows of ``blocks`` without content, with a ``name`` that equal contents share and no others."""
    plain = [c for c in blocks.columns if c != content]
    distinct = blocks.select(hashed, content).distinct()
    counts = stage.write(distinct.groupBy(hashed).agg(F.count(F.lit(1)).alias("contents")), "hashes")
    # Almost always empty, and then read as such: Spark sees the size of the written table.
    clashes = stage.write(counts.filter(F.col("contents") > 1).select(hashed), "clashes")
    clashing = blocks.join(clashes, hashed, "left_semi")
    names = counts.filter(F.col("contents") == 1).select(hashed, F.lit(None).cast("binary").alias(content))
    names = stage.write(numbered(names.unionByName(clashing.select(hashed, content).distinct()), hashed, content), "block_names")
    by_hash = blocks.select(plain).join(names.filter(F.col(content).isNull()).select(hashed, "name"), hashed)
    by_content = clashing.join(names.filter(F.col(content).isNotNull()), [hashed, content])
    return by_hash.select(*plain, "name").unionByName(by_content.select(*plain, "name"))


def identities(docs: DataFrame, stage: Stage, *, id_column: str, text: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Documents (``row``, ``id``, ``bytes``, ``text_sha256``) and the one ``name`` of each ``row``."""
    size = F.lit(block_bytes)
    raw = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.encode(ascii_lower(text_of(text)), "UTF-8").alias("body")
    ).withColumn("bytes", F.octet_length("body"))
    last = F.greatest(F.ceil(F.col("bytes") / size) - 1, F.lit(0)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.substring(F.col("body"), i * size + 1, size).alias("block"))
    )
    parts = raw.select("row", "id", "bytes", F.sha2("body", 256).alias("text_sha256"), F.explode(cut).alias("part"))
    first = F.col("part.at") == 0
    # Rows are numbered while they are written, so a number is never computed twice.
    blocks = stage.write(
        parts.select(
            "row", "bytes", F.col("part.at").alias("at"), F.when(first, F.col("id")).alias("id"),
            F.when(first, F.col("text_sha256")).alias("text_sha256"), F.xxhash64("part.block").alias("hash"), F.col("part.block").alias("block"),
        ), "blocks",
    )
    documents = blocks.filter(F.col("at") == 0).select("row", "id", "bytes", "text_sha256")
    level = stage.write(named_blocks(blocks.select("row", "bytes", "at", "hash", "block"), stage).drop("hash"), "level0")

    longest, depth = documents.agg(F.max("bytes")).first()[0] or 0, 0
    roots = level.filter(F.col("bytes") <= block_bytes).select("row", "name")
    while longest > block_bytes << depth:
        pairs = level.filter(F.col("bytes") > block_bytes << depth).groupBy("row", "bytes", F.expr("at div 2").cast("int").alias("at"))
        pairs = pairs.agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left_name"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right_name"),
        )
        depth += 1
        pairs = stage.write(pairs, f"pairs{depth}")
        names = stage.write(numbered(pairs.select("left_name", "right_name").distinct(), "left_name", "right_name"), f"names{depth}")
        level = stage.write(pairs.join(names, ["left_name", "right_name"]).select("row", "bytes", "at", "name"), f"level{depth}")
        stage.drop(f"pairs{depth}", f"names{depth}")
        done = (F.col("bytes") <= block_bytes << depth) & (F.col("bytes") > block_bytes << (depth - 1))
        roots = roots.unionByName(level.filter(done).select("row", "name"))
    return documents, roots


def deduplicate(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per document: its id, keep_id (largest id of its group), group_size, kept, text_sha256."""
    documents, roots = identities(docs, Stage(docs.sparkSession, "exact"), id_column=id_column, text=text, block_bytes=block_bytes)
    rows = documents.join(roots, "row")
    # A name is unique among texts of one length, and one level holds all texts of that length.
    groups = rows.groupBy("bytes", "name").agg(F.max(F.struct("id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["bytes", "name"]).select(
        F.col("id").alias(id_column), F.col("stays.id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256"
    )
