"""Source divergence audit: how far each source's choice of words lies from its language's other sources.

Identical texts of a language are collapsed first: one row per distinct text with the number of its copies
in every source. Each distinct text is then tokenized once and its counts are weighted by the copies. Two
sources are compared on the terms they have; what a term costs that one of them lacks depends only on the
other's count, and what a term costs that both lack is one constant, so neither is ever written out.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage
from .batches import slices

#: ASCII letters in lower case, other ASCII as blanks, all other bytes as they are.
_LETTERS = bytes(b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in range(256))
#: Documents of a language that a term has to occur in.
LEAST_DOCS = 3
#: Terms reported per group.
TOP_TERMS = 200
#: Probabilities are counted in parts of this.
SCALE = 1_000_000_000
#: Counts a task holds before it hands them on.
HELD = 200_000


def distinct_texts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, text, sources): every distinct text of a language once, with its copies per source.

    ``sources`` is an array of (source, copies), so it is as long as a text has different sources. Copies
    are counted by digest before texts move, and of a text's copies one per task moves.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
    listed = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    return rows.groupBy("lang", "digest").agg(F.first("text").alias("text")).join(listed, ["lang", "digest"]).drop("digest")


def words(text: str) -> list[bytes]:
    """Terms in UTF-8: every byte that is no ASCII letter and no part of a longer character is a blank."""
    return text.encode().translate(_LETTERS).split()


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group, added up per
    task; a group's term has as many rows as tasks met it, all in one partition by language and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                group = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
                counts = [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*group, terms, *counts], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                for row in part.to_pylist():
                    found = words(row["text"])
                    for at in row["sources"] if found else ():
                        n, docs = held[row["lang"], at["source"]]
                        size -= len(n)
                        if at["copies"] == 1:
                            n.update(found)
                            docs.update(set(found))
                        else:
                            for term, k in Counter(found).items():
                                n[term] += k * at["copies"]
                                docs[term] += at["copies"]
                        size += len(n)
                        if size > HELD:
                            yield from emptied()
                            size = 0
        yield from emptied()

    counted = texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.repartition("lang", "term")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any count; null where there are no terms."""
    parts = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", parts, F.when(terms > 0, total + terms).cast("decimal(20,0)")) + 1


def _cost(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are below 2^30 + 2, so this stays within a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _total(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every group of a language and a source.

    ``pair`` rows hold the divergence of the group from each other source of its language, over all terms
    that at least ``least_docs`` documents of the language contain. ``term`` rows hold the group's most
    overused terms against the whole language, at most ``top_terms``. Ranks go down by value, then up by
    item in byte order.

    A null text, language or source counts as ''. An empty text has no terms; a language without kept terms
    has value 0 in all pairs and no term rows. Repeated rows each count as a document. A source that is
    alone in its language has no pairs, and an empty table gives no rows. Other columns are not read.
    """
    counts = term_counts(distinct_texts(docs, text, lang, source)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # as the rows lie already
    kept = counts.withColumns({"in_lang": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)}).where(F.col("in_lang") >= least_docs)
    kept = stage(kept.select("lang", "source", "term", "n", "lang_n"), "divergence-kept")

    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = stage(groups.withColumn("none", _share(F.lit(0), F.col("total"), F.col("terms"))), "divergence-groups")

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    shares = stage(shares.select("lang", "source", "term", "p", "none", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "divergence-shares")
    over = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _cost(F.col("p"), F.col("q")).alias("value"))
    return _ranked(_pairs(groups, shares), "pair").unionByName(_ranked(over, "term").where(F.col("rank") <= top_terms))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language.

    Over all terms: the constant for terms both lack, corrected for the terms of either side as if the
    other lacked them, corrected again for the terms both have.
    """
    one, other = shares.alias("a"), shares.alias("b")
    p, q, p0, q0 = F.col("a.p"), F.col("b.p"), F.col("a.none"), F.col("b.none")
    both = one.join(other, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    both = both.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("low"), F.col("b.source").alias("high")).agg(
        _total(_cost(p, q) - _cost(p, q0) - _cost(p0, q) + _cost(p0, q0)).alias("up"),
        _total(_cost(q, p) - _cost(q, p0) - _cost(q0, p) + _cost(q0, p0)).alias("down"),
    )
    way = lambda of, to, value: F.struct(F.col(of).alias("source"), F.col(to).alias("item"), F.col(value).alias("shared"))
    both = both.select("lang", F.inline(F.array(way("low", "high", "up"), way("high", "low", "down"))))

    group, mate = groups.alias("g"), groups.alias("m")
    pairs = group.join(mate, (F.col("g.lang") == F.col("m.lang")) & (F.col("g.source") != F.col("m.source")))
    pairs = pairs.select(
        "g.lang", "g.source", F.col("m.source").alias("item"), F.col("g.terms").alias("terms"), F.col("g.none").alias("p0"), F.col("m.none").alias("q0")
    )
    # Terms of one group with equal share cost the same, so they are taken together.
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    p0, q0, p = F.col("p0"), F.col("q0"), F.col("p")
    own = pairs.join(alike, ["lang", "source"]).groupBy("lang", "source", "item").agg(
        _total(F.col("k").cast("decimal(19,0)") * (_cost(p, q0) - _cost(p0, q0)).cast("decimal(19,0)")).alias("own")
    )
    theirs = pairs.join(alike.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy("lang", "source", "item").agg(
        _total(F.col("k").cast("decimal(19,0)") * (_cost(p0, p) - _cost(p0, q0)).cast("decimal(19,0)")).alias("theirs")
    )
    key = ["lang", "source", "item"]
    joined = pairs.join(own, key, "left").join(theirs, key, "left").join(both, key, "left")
    all_lack = F.col("terms").cast("decimal(19,0)") * _cost(p0, q0).cast("decimal(19,0)")
    value = sum((F.coalesce(x.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) for x in (F.col("own"), F.col("theirs"), F.col("shared"))), all_lack)
    return joined.select(*key, F.when(F.col("terms") > 0, value).otherwise(0).cast("bigint").alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
