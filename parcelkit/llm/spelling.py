"""Spelling variants: words that differ by one code point, found by permuterm rotations, and the frequent form each one leads to.

A word with the terminator behind it has a rotation for each place between its letters. Two words that differ by a replaced letter have
rotations that agree in all but their last letter; where one has a letter more, its rotation without that last letter is a whole
rotation of the other. So every rotation stands in the sorted table twice, whole and as the prefix that skips its last letter, and near words
stand side by side under one prefix. A prefix names all letters but one and where that one stood, so its words differ in nothing
else: no group has more rows than the alphabet has letters, and one for the word without it. The table is range-partitioned and sorted by prefix, then
by falling count; a scan of neighbouring rows tells each word how many near ones the group has and which is the first of them, no pair is written down.

In a run of equal letters several places tell of the same added letter; only the last of them counts, so each near word counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lower_ascii, written

#: Letters of a word, and the terminator, which is none of them.
LETTERS, END = r"[A-Za-zÀ-ÿ]+", "$"
#: Kinds of a row: a whole rotation, a prefix that skips a letter, one that skips the last of a run of equal letters.
WHOLE, SKIPS, LAST = 0, 1, 2
_NONE = np.iinfo(np.int64).max


def damaged(word: Column, id_text: Column, every: int = 97) -> Column:
    """``word``, of whose occurrences one in ``every`` by the crc32 of ``id:word`` has lost the code point at crc32 % length."""
    h = F.crc32(F.concat(id_text, F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """Rows (word, n): words of ``shortest`` code points or more that occur ``least`` times or more in all texts.

    Words are maximal runs of LETTERS with A-Z in lower case, damaged as :func:`damaged` says. Null and empty texts have none; a null id counts as an empty one; each
    repeated row counts. Counted before they are shuffled.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("run")).where(F.length("run") >= shortest)
    words = runs.select(damaged(F.col("run"), F.col("id"), every).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix: list[str] = []
        kind: list[int] = []
        words = batch.column("word").to_pylist()
        for w in words:
            marked = w + END
            for i in range(len(marked)):
                turned = marked[i:] + w[:i]
                prefix.append(turned)
                kind.append(WHOLE)
                if i:
                    prefix.append(turned[:-1])
                    kind.append(SKIPS if w[i - 1 : i] == w[i : i + 1] else LAST)
        of = pa.array(np.repeat(np.arange(len(words)), [2 * len(w) + 1 for w in words]))
        yield pa.RecordBatch.from_arrays([pa.array(prefix, pa.string()), pa.array(kind, pa.int8()), batch.column("word").take(of), batch.column("n").take(of)], ["prefix", "kind", "word", "n"])


def _neighbours(t: pa.Table) -> pa.RecordBatch:
    """Whole groups in order of their prefixes, then of falling count and word: (word, near, best_n, best) of every row that has near words there."""
    rows, kind = np.arange(len(t)), np.asarray(t.column("kind"))
    prefix = t.column("prefix").combine_chunks()
    new = np.ones(len(t), bool)
    new[1:] = pc.not_equal(prefix.slice(1), prefix.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    skips, last, whole = kind != WHOLE, kind == LAST, kind == WHOLE
    first = lambda which: np.minimum.reduceat(np.where(which, rows, _NONE), start)[group]
    number = lambda which: np.add.reduceat(which.astype(np.int64), start)[group]
    one, alone = first(skips), first(whole)
    other = np.where(rows == one, first(skips & (rows != one)), one)  # the first word with another letter there
    near = np.where(whole, number(last), number(skips) - 1 + last * number(whole))
    best = np.where(whole, first(last), np.where(last, np.minimum(other, alone), other))
    some = np.flatnonzero(near > 0)
    word, n = t.column("word").combine_chunks(), t.column("n").combine_chunks()
    at = pa.array(best[some])
    return pa.RecordBatch.from_arrays([word.take(pa.array(some)), pa.array(near[some]), n.take(at), word.take(at)], ["word", "near", "best_n", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        prefix = t.column("prefix").combine_chunks()
        begins = np.flatnonzero(pc.not_equal(prefix.slice(1), prefix.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False))
        cut = int(begins[-1]) + 1 if len(begins) else 0  # the last group may go on in the next batch
        if cut:
            yield _neighbours(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and len(held):
        yield _neighbours(held)


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, n_near, best_n, best) for each of ``words`` (word, n) that has near ones; best is the most frequent, ties by code points."""
    table = words.mapInArrow(_rotations, "prefix string, kind byte, word string, n long")
    ordered = table.repartitionByRange("prefix").sortWithinPartitions("prefix", F.col("n").desc(), "word")
    found = ordered.mapInArrow(_scan, "word string, near long, best_n long, best string")
    told = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
    return told.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from ``forms`` (word, form), by following forms to the last; each round doubles how far a word sees.

    A form's count is a multiple of its word's, so chains are as long as the logarithm of the largest count at most.
    """
    sees = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = sees.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(sees.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        forget(sees)
        sees = step
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        sees = step.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for every one of ``words`` (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n, ties by code points, if that n is at least
    ``ratio`` times its own (``ratio`` over 1), else null; root is where forms lead, the word itself without one. Words must be distinct and hold no terminator. An empty table gives
    an empty result.
    """
    near = written(near_words(words), "near")
    told = words.select("word", "n").join(near.hint("merge"), "word", "left").withColumn("fits", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), F.col("best")).alias("form"), F.when(F.col("fits"), F.col("best_n")).alias("form_n")), "told")
    forget(near)
    root = roots(told.where("form is not null").select("word", "form"))
    return told.join(root.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """:func:`variants` of the :func:`word_counts` of whole texts; other columns of ``docs`` are ignored."""
    return variants(written(word_counts(docs, id_col, text_col, shortest, least, every), "words"))
