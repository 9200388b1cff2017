"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Distinct blocks are sorted and numbered; then each pair of
adjacent names is named in the same way, until one name stands for the whole text. Two texts have the
same number of rounds and the same last name exactly when they are equal.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage
from .columns import once, unused

BLOCK_BYTES = 4096
#: No second half: the last name of an odd row.
ALONE = -1


def normalised(text: Column) -> Column:
    """Runs of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def block_key(block: Column, seed: int) -> Column:
    """Where a block's name is looked up. Only a place to look: equality is decided on the bytes."""
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(F.lit(~seed), block, F.octet_length(block)).alias("b"))


def _blocks(text: Column, size: int) -> Column:
    def cut(body: Column) -> Column:
        last = F.floor((F.greatest(F.octet_length(body), F.lit(1)) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(body, i * size + 1, F.lit(size)))

    return once(text.cast("binary"), cut)


def _numbered(names: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted within hash partitions, so a name is the place in that order and no task sees all."""
    return names.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, block_bytes: int, key: Callable[[Column, int], Column]) -> tuple[DataFrame, DataFrame]:
    """``(rows, identities)`` of (row, doc_id, text): the rows with their digest, and ``(row, round, name)``.

    The text itself is shuffled once, to be compared block by block: the smallest and the largest block
    under a key must be the same bytes. If not, all blocks are keyed anew with the next seed. Everything
    after that works on integers.
    """
    body = normalised(F.col("text"))
    for seed in range(64):
        keyed = docs.select("row", "doc_id", body.alias("body")).select(
            "row",
            "doc_id",
            F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("body"), block_bytes), lambda b: key(b, seed)).alias("keys"),
        )
        rows = stage(keyed, "dedup-rows")
        blocks = docs.select(F.explode(_blocks(body, block_bytes)).alias("block")).select(key(F.col("block"), seed).alias("k"), "block")
        first = blocks.select("k.a", "k.b", "block").groupBy("a", "b").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
        names = stage(_numbered(first.select("a", "b", (F.col("lo") != F.col("hi")).alias("clash")), ["a", "b"]), "dedup-names")
        if names.filter("clash").isEmpty():
            break
    else:
        raise RuntimeError("no seed keeps the blocks apart")

    spread = rows.select("row", F.size("keys").cast("long").alias("n"), F.posexplode("keys").alias("pos", "k"))
    level = spread.select("row", "n", F.col("pos").cast("long").alias("pos"), "k.a", "k.b")
    level = stage(level.join(names.drop("clash"), ["a", "b"]).select("row", "n", "pos", "name"), "dedup-level")
    done = [level.filter("n = 1").select("row", F.lit(0).alias("round"), "name")]
    longest = level.agg(F.max("n")).first()[0] or 1
    turn = 0
    while longest > 1:
        turn, longest = turn + 1, (longest + 1) // 2
        half = F.col("pos") % 2
        pairs = (
            level.filter("n > 1")
            .groupBy("row", F.floor((F.col("n") + 1) / 2).alias("n"), F.floor(F.col("pos") / 2).alias("pos"))
            .agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(ALONE).cast("long")).alias("right"))
        )
        pairs = stage(pairs, "dedup-pairs")
        names = stage(_numbered(pairs.select("left", "right").distinct(), ["left", "right"]), "dedup-names")
        level = stage(pairs.join(names, ["left", "right"]).select("row", "n", "pos", "name"), "dedup-level")
        done.append(level.filter("n = 1").select("row", F.lit(turn).alias("round"), "name"))
    identities = done[0]
    for more in done[1:]:
        identities = identities.unionByName(more)
    return rows.drop("keys"), identities


def exact_duplicates(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", block_bytes: int = BLOCK_BYTES, key: Callable[[Column, int], Column] = block_key
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of blanks became one space; null is the empty text, and
    empty texts are equal. Of equal texts the smallest id stays; a null id stays only where the group has
    no other. Rows that repeat an id and a text are members of one group and one of them stays. No rows
    give no rows. Other columns are not read.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return _grouped(source, block_bytes, key).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )


def _grouped(source: DataFrame, block_bytes: int, key: Callable[[Column, int], Column]) -> DataFrame:
    """(row, doc_id, text_sha256, first, group_size) of (row, doc_id, text)."""
    rows, identities = name_documents(source, block_bytes, key)
    members = stage(rows.join(identities, "row"), "dedup-members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = stage(members.groupBy("round", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "dedup-groups")
    return members.join(groups, ["round", "name"])


def drop_exact_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; what stays is what ``exact_duplicates`` says.

    ``docs`` is read several times and has to give the same rows in the same order each time, as a
    stored table does.
    """
    number = unused(docs, "_row")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    source = numbered.select(F.col(number).alias("row"), F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    copies = _grouped(source, block_bytes, block_key).filter(F.col("row") != F.col("first.row"))
    # The copies, not what stays: they are fewer, and few enough need no shuffle of the texts.
    copies = stage(copies.select(F.col("row").alias(number)), "dedup-copies")
    return numbered.join(copies, number, "left_anti").drop(number)
