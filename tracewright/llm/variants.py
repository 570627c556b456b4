"""Spelling variants: words at one edit from each other, and the common form of each.

Two words at one inserted, deleted or replaced code point, the shorter of L code points, agree on their first or on their last L // 2 code points. So words that share a prefix are
a range of the sorted dictionary, those that share a suffix a range of the dictionary of reversed words, and every pair lies in such a block. What lies between the prefix and the suffix that a block shares
differs by one edit again, so a block of more than ``BLOCK`` words is divided into those that also agree on the first half of the rest and those that also agree on its last half, round after round,
until at most one code point of the shorter words is open; then a block has no more words than the alphabet has letters, a few times over. Pairs inside blocks are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a block that are compared with each other; larger blocks are divided.
BLOCK = 128


def runs_of(text: str | None) -> Counter:
    """The maximal runs of letters of a text, of which only A-Z are lower-cased, with their numbers."""
    return Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))) if text else Counter()


def _counted(every: int | None, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])
            totals.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs_of(text).items():
                    h = zlib.crc32(word.encode(), begun) if every else 1
                    if every and h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        totals[word] += n
                if len(totals) > 250_000:
                    yield flush()
        yield flush()

    return run


def dictionary(docs: DataFrame, slips: int | None = None, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of at least ``least_length`` code points that occur ``least_count`` times over all texts.

    With ``slips`` one of so many (document, run) loses a code point first, which plants misspellings: those whose crc32 of ``id:run`` it divides, at that number modulo the run's length. Numbers are added up in the tasks before they are shuffled.
    Null texts have no words; a null id counts as
    an empty one. Repeated rows count each time, an empty table has no words, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counted(slips, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _agree(front: Column, back: Column) -> list[Column]:
    """A block's key: the length of its shorter words, how much they share in front and behind, and what that is."""
    word = F.col("word")
    return [front.alias("front"), back.alias("back"), F.substring(word, F.lit(1), front).alias("prefix"), F.when(back > 0, F.substring(word, -back, back)).otherwise("").alias("suffix")]


def _one_edit(words: np.ndarray, lengths: np.ndarray, shorter: int, front: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs at one edit, of words in code points padded with 0, all of ``shorter`` or one more code points, that share ``front`` first ones."""
    short, long = np.flatnonzero(lengths == shorter), np.flatnonzero(lengths == shorter + 1)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 24) // (len(words) * (shorter + 1)))  # comparisons of very long words are made in parts
    for at in range(0, len(short), step):
        some = short[at : at + step]
        i, j = np.nonzero((words[some][:, None, front:shorter] != words[short][None, :, front:shorter]).sum(axis=2) == 1)
        once = some[i] < short[j]
        left.append(some[i][once])
        right.append(short[j][once])
        if len(long):
            # One code point is inserted where what is equal in front and what is equal behind cover the shorter word.
            ahead = np.logical_and.accumulate(words[some][:, None, :shorter] == words[long][None, :, :shorter], axis=2).sum(axis=2)
            shifted = words[some][:, None, :shorter] == words[long][None, :, 1 : shorter + 1]
            i, j = np.nonzero(ahead + np.logical_and.accumulate(shifted[:, :, ::-1], axis=2).sum(axis=2) >= shorter)
            left.append(some[i])
            right.append(long[j])
    return np.concatenate(left), np.concatenate(right)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs at one edit in both directions, of blocks that arrive as ranges of rows in order."""
    key = ["shorter", "front", "back", "prefix", "suffix"]

    def settle(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(c).to_numpy(zero_copy_only=False) for c in key]
        word, n = rows.column("word").to_numpy(zero_copy_only=False), rows.column("n").to_numpy()
        change = np.ones(len(word), bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        cut = np.append(np.flatnonzero(change), len(word))
        a, b = [], []
        for begin, end in zip(cut, cut[1:], strict=False):
            if end - begin > 1:
                members = word[begin:end].astype(str)
                codes = members.view(np.uint32).reshape(len(members), -1)
                shorter = int(columns[0][begin])
                codes = np.pad(codes, ((0, 0), (0, max(0, shorter + 1 - codes.shape[1]))))
                i, j = _one_edit(codes, np.char.str_len(members), shorter, int(columns[1][begin]))
                a += [begin + i, begin + j]
                b += [begin + j, begin + i]
        i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(word[i], pa.string()), pa.array(word[j], pa.string()), pa.array(n[j], pa.int64())], names=["word", "near", "near_n"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        last = held.slice(held.num_rows - 1).select(key).to_pylist()[0] if held.num_rows else None
        open_at = held.num_rows
        ends = [held.column(c).to_numpy(zero_copy_only=False) for c in key]
        while open_at and all(e[open_at - 1] == last[c] for e, c in zip(ends, key, strict=True)):
            open_at -= 1
        if open_at:
            yield settle(held.slice(0, open_at).combine_chunks())
            held = held.slice(open_at)
    if held is not None and held.num_rows:
        yield settle(held.combine_chunks())


def near_words(words: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) for each ordered pair of distinct words at one edit, once."""
    length = F.char_length("word").cast("int")
    roles = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("shorter"))
    sides = roles.withColumn("half", F.expr("shorter div 2").cast("int")).withColumn("front", F.explode(F.array(F.lit(0), F.lit(1))))
    sides = sides.select("word", "n", "shorter", F.expr("if(front = 1, half, 0)").alias("front"), F.expr("if(front = 1, 0, half)").alias("back"))
    key = ["shorter", "front", "back", "prefix", "suffix"]
    found: DataFrame | None = None
    rows = sides.select("word", "n", "shorter", *_agree(F.col("front"), F.col("back")))
    while True:
        rows = scratch.cut(rows, "blocks")
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held"), F.min(F.char_length("word")).alias("least")).where("held > 1 and least = shorter")
        sizes = scratch.cut(sizes, "sizes")
        is_open = F.col("shorter") - F.col("front") - F.col("back") > 1
        small = rows.join(sizes.where(~is_open | (F.col("held") <= block)).select(*key), key)
        pairs = scratch.cut(small.repartition(*key).sortWithinPartitions(*key, "word").mapInArrow(_verified, "word string, near string, near_n long"), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        large = sizes.where(is_open & (F.col("held") > block)).select(*key)
        if large.isEmpty():
            return found.distinct()
        rest = rows.join(large, key).withColumn("half", F.expr("(shorter - front - back) div 2").cast("int")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        rows = rest.select("word", "n", "shorter", *_agree(F.col("front") + F.expr("if(side = 0, half, 0)"), F.col("back") + F.expr("if(side = 1, half, 0)")))


def group_variants(words: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    form is the near word of largest n (of equal ones the first in code-point order) if its n is at least ``ratio`` times the word's, else null, and form_n its n; root is where following forms ends.
    Words have to be distinct; null words and words of fewer than two code points are left out. An empty table gives no rows.
    """
    scratch = Scratch(words.sparkSession)
    with scratch:
        words = scratch.cut(words.where("char_length(word) > 1").select("word", F.col("n").cast("long").alias("n")), "words")
        near = near_words(words, scratch, block)
        best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
        taken = F.col("top.less") * -1 >= ratio * F.col("n")
        forms = words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("top.near")).alias("form"), F.when(taken, F.col("top.less") * -1).alias("form_n")
        )
        forms = scratch.keep(forms, "forms")
        # Numbers grow along forms, so that there is no cycle; each round doubles the way that a link spans.
        links = forms.where("form is not null").select("word", F.col("form").alias("root"))
        while True:
            links = scratch.cut(links, "links")
            on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
            if links.join(on, "root", "left_semi").isEmpty():
                break
            links = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        links = scratch.keep(links, "roots")
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
