"""How far the sources of a language differ in their words.

A term is a maximal run of ASCII letters and code points beyond ASCII, of which only A-Z are lower-cased. A language keeps the terms that
stand in at least ``min_docs`` of its documents; tasks count them before anything is shuffled. With n occurrences of a term in a group, N of all kept terms there and V kept terms, the smoothed share in
billionths is 1 + floor(10^9 (n + 5) / (N + 5 V)).

Each kept term of a language is one row with an array indexed by the language's sources. Higher-order functions turn that array into
contributions to pairs of sources, which are summed on the map side first. Two sources that both lack a term differ there by the same amount each time, so only the excess over that amount is emitted,
and only for pairs of which one has the term: a term of k of S sources makes at most k S rows, not S^2 / 2.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.llm.common import Scratch, slices

#: Bytes that part terms: all of ASCII but letters.
_PARTS = bytes(i for i in range(128) if not chr(i).isalpha())
_SPACED = bytes.maketrans(_PARTS, b" " * len(_PARTS))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SPACED).split() if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term in the groups of a slice of a task."""
    for batch in slices(batches, "text", 8 << 20):
        listed = [terms(t) for t in batch.column("text").to_pylist()]
        found = pa.array(itertools.chain.from_iterable(listed), pa.binary()).dictionary_encode()
        width = max(1, len(found.dictionary))
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        of = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        each, n = np.unique(np.repeat(np.arange(len(listed)), [len(x) for x in listed]) * width + found.indices.to_numpy(), return_counts=True)
        key, at = np.unique(of[each // width] * width + each % width, return_inverse=True)
        group, term = key // width, key % width
        columns = [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), found.dictionary.take(pa.array(term)).cast(pa.string())]
        totals = [np.bincount(at, weights=n, minlength=len(key)).astype(np.int64), np.bincount(at, minlength=len(key)).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, totals)], names=["lang", "source", "term", "n", "docs"])


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), digit groups one by one, so that no product overflows."""
    divisor = F.greatest(total + 5 * kept, F.lit(1))
    rest, found = count + 5, F.lit(1).cast("long")
    for weight in (1_000_000, 1_000, 1):
        digits = (rest * 1000).cast("long")
        found = found + F.call_function("div", digits, divisor) * weight
        rest = digits % divisor
    return found


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, total, counts) of the terms that each language keeps; counts holds (source, n) of the sources that have the term."""
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # All rows of a term lie together, so that the groupings and the join below shuffle nothing more; both sides of it read the same columns, hence one shuffle.
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where("docs > 0")
    often = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs)
    held = counts.select("lang", "term", "source", "n").join(often.select("lang", "term", "total"), ["lang", "term"])
    return held.groupBy("lang", "term", "total").agg(F.collect_list(F.struct("source", "n")).alias("counts"))


def languages(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, n_terms, kept_total, sources) of every language; sources holds (source, total, base) in order, base being the share of a term that the source lacks."""
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("kept_total"))
    each = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "n_terms", "kept_total"])
    entry = F.struct("source", "total", share(F.lit(0).cast("long"), F.col("total"), F.col("n_terms")).alias("base"))
    return each.groupBy("lang", "n_terms", "kept_total").agg(F.sort_array(F.collect_list(entry)).alias("sources"))


def wide_vectors(kept: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, term, sources, n, p, q): each kept term with its numbers and shares in the order of the language's sources, and its share in the language.

    A language's row meets its terms in as many parts as a shuffle has, so that a language of most terms is no single task.
    """
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).join(dealt, ["lang", "part"]).withColumn("number", F.map_from_entries("counts"))
    both = both.withColumn("n", F.transform("sources", lambda s: F.coalesce(F.element_at("number", s["source"]), F.lit(0).cast("long"))))
    own = F.transform("sources", lambda s, i: share(F.get("n", i), s["total"], F.col("n_terms")))
    return both.select("lang", "term", "sources", "n", own.alias("p"), share(F.col("total"), F.col("kept_total"), F.col("n_terms")).alias("q"))


def pair_values(wide: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of each ordered pair of sources of a language: their summed differences over all kept terms."""
    last = F.size("n") - 1
    excess = lambda i, j: F.abs(F.get("p", i) - F.get("p", j)) - F.abs(F.get("sources", i)["base"] - F.get("sources", j)["base"])
    partners = lambda i: F.filter(F.sequence(i + 1, last), lambda j: (F.get("n", i) > 0) | (F.get("n", j) > 0))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(partners(i), lambda j: F.struct(i.alias("i"), j.alias("j"), excess(i, j).alias("more")))))
    summed = wide.where(last > 0).select("lang", F.explode(pairs).alias("c")).groupBy("lang", "c.i", "c.j").agg(F.sum("c.more").alias("more"))
    ends = known.select("lang", "n_terms", "sources", F.posexplode("sources").alias("at", "own"))
    ends = ends.select("lang", "n_terms", "at", "own", F.posexplode("sources").alias("to", "other")).where("at <> to")
    ends = ends.withColumn("i", F.least("at", "to")).withColumn("j", F.greatest("at", "to")).join(summed, ["lang", "i", "j"], "left")
    value = F.coalesce("more", F.lit(0)) + F.col("n_terms") * F.abs(F.col("own.base") - F.col("other.base"))
    return ends.select("lang", "own.source", F.lit("pair").alias("part"), F.col("other.source").alias("item"), value.alias("value"))


def term_values(wide: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of the terms of which a source that has them has a larger share than its language."""
    more = F.transform("sources", lambda s, i: F.struct(s["source"].alias("source"), F.when(F.get("n", i) > 0, F.get("p", i) - F.col("q")).alias("value")))
    found = wide.select("lang", "term", F.explode(F.filter(more, lambda m: m["value"] > 0)).alias("m"))
    return found.select("lang", "m.source", F.lit("term").alias("part"), F.col("term").alias("item"), "m.value")


def audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """One row per ranked difference: lang, source, part, item, value, rank.

    Part ``pair`` ranks every other source of the language by the difference of all kept terms' shares, part ``term`` the kept terms that the source has
    more often than its language, down to rank ``top_terms``; value falls and items rise in UTF-8 order. Null text, lang and source count as
    empty strings, so null sources are one group. A group without kept terms takes part with counts of zero; where a language keeps none, its pairs have the value 0.
    Repeated rows count each time. An empty table gives no rows, a language of one source no pairs; other columns are not read. A text is held whole by its task.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    scratch = Scratch(docs.sparkSession)
    kept = scratch.keep(kept_terms(rows, min_docs), "terms")
    groups = scratch.keep(rows.select("lang", "source").distinct(), "groups")
    known = scratch.keep(languages(groups, kept), "languages")
    wide = wide_vectors(kept, known)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked(pair_values(wide, known)).unionByName(ranked(term_values(wide)).where(F.col("rank") <= top_terms))
