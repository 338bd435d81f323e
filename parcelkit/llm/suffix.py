"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A repeat of ``length`` bytes is found from sampled suffixes: every window of ``length`` bytes names one anchor, the
place where its smallest hash of ANCHOR bytes begins (the leftmost one). Equal windows name the same anchor at the same
distance, so only suffixes that start at anchors are kept, about two in ``length - ANCHOR``, but one in each period of a text that says one thing over and over.
So a text gives two suffixes of a kind at most, which tell that the kind repeats; where it stands more often, its windows become runs at once. A suffix array here is sparse: a written table of
such suffixes, range-partitioned and sorted by their first eight bytes, then by the hash of their first ANCHOR bytes, then by the
hash of all bytes that the anchor's own windows span. Place comes last in the order, so however common a suffix is, it is cut between partitions.

New documents come in batches (:class:`SuffixIndex`). A batch gets its array, which is merge-scanned against the arrays of all levels;
then it becomes a level itself, and levels of equal size merge into one sorted table of twice the size, so there are logarithmically
many. In a scan, suffixes whose spans are equal repeat throughout. Where only the anchor is equal, one suffix of each kind goes to
a second look, which compares all windows of the span. Nothing in a scan gathers a suffix's occurrences in one task: counts are
aggregated before they are shuffled, and what they say is joined back, where Spark splits what is too large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .common import forget, written

#: Bytes of a suffix that order it; kinds of one anchor from which on windows are compared by a shuffle of their own.
ANCHOR, MANY = 24, 4096
#: Columns: what orders suffixes, what tells kinds of them apart.
KEY = ["head", "anchor"]
KIND = [*KEY, "span", "lo", "hi"]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first eight bytes as a number that sorts like them, anchor hash, span hash, place, first and last window start against the place) of every anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    n, w = len(data), length - ANCHOR + 1
    if n < length:
        return none
    hashed = th.Hashed(data)
    start = np.arange(n - ANCHOR + 1)
    grams = hashed(start, start + ANCHOR)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    windows = np.arange(n - length + 1)
    of = np.minimum(ahead[windows], behind[windows + w - 1])
    doc = np.searchsorted(offsets, windows, "right") - 1
    windows = windows[windows + length <= offsets[doc + 1]]
    if not len(windows):
        return none
    place = (of[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    lo, hi = windows[np.concatenate([[0], cut])], windows[np.concatenate([cut - 1, [len(windows) - 1]])]
    place = place[np.concatenate([[0], cut])]
    doc = np.searchsorted(offsets, lo, "right") - 1
    head = (np.ascontiguousarray(data[place[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return doc, head, grams[place].view(np.int64), hashed(lo, hi + length).view(np.int64), place - offsets[doc], lo - place, hi - place


def alike(kinds: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of these columns: how many rows before it are alike, and how many rows are alike in all."""
    order = np.lexsort(kinds)
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(x[order]) != 0 for x in kinds], axis=0)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    before, times = np.empty_like(order), np.empty_like(order)
    before[order], times[order] = np.arange(len(order)) - np.repeat(start, size), np.repeat(size, size)
    return before, times


def _suffixes(length: int, own: bool = False):
    """At most two suffixes of each kind from a text. With ``own`` also rows (k, size, first, last) without the other columns: runs of the windows of all kinds that stand there more often."""
    names = ["head", "anchor", "span", "k", "size", "at", "lo", "hi"] + ["first", "last"] * own

    def rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(columns["k"])
        return pa.RecordBatch.from_arrays([pa.array(columns[x]) if x in columns else pa.nulls(n, pa.int16() if x in ("lo", "hi") else pa.int64()) for x in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("k"))
            for at, data, offsets in th.buffers(batch.column("text")):
                doc, head, anchor, span, place, lo, hi = anchors(data, offsets, length)
                before, times = alike((hi, lo, span, anchor, head, doc))
                columns = {"head": head, "anchor": anchor, "span": span, "k": keys[at][doc], "size": np.diff(offsets)[doc], "at": place, "lo": lo.astype(np.int16), "hi": hi.astype(np.int16)}
                yield rows({name: x[before < 2] for name, x in columns.items()})
                if own and (many := times > 2).any():
                    doc, first, last = doc[many], (place + lo)[many], (place + hi)[many]
                    cut = np.flatnonzero((np.diff(doc) != 0) | (first[1:] != last[:-1] + 1)) + 1
                    a, z = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(doc) - 1]])
                    yield rows({"k": columns["k"][many][a], "size": columns["size"][many][a], "first": first[a], "last": last[z]})

    return run


def _contexts(length: int):
    """Texts with the list of their anchors to look at again: the bytes that each one's windows span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("anchor", "k", "size", "at", "lo", "hi", "many", "bytes")}
            for k, text, looks in zip(batch.column("k").to_pylist(), batch.column("text"), batch.column("looks").to_pylist(), strict=True):
                data = text.as_py().encode() if text.is_valid else b""
                for x in looks:
                    for name in ("anchor", "at", "lo", "hi", "many"):
                        rows[name].append(x[name])
                    rows["k"].append(k)
                    rows["size"].append(len(data))
                    rows["bytes"].append(data[x["at"] + x["lo"] : x["at"] + x["hi"] + length])
            types = {"anchor": pa.int64(), "k": pa.int64(), "size": pa.int64(), "at": pa.int64(), "lo": pa.int16(), "hi": pa.int16(), "many": pa.bool_(), "bytes": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in types.items()], list(types))

    return run


def _windows(batch: pa.RecordBatch | pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """For all windows of the contexts: row, anchor, distance from the anchor, hash."""
    lo, hi, anchor = (np.asarray(batch.column(n)).astype(np.int64) for n in ("lo", "hi", "anchor"))
    parts = []
    for at, data, offsets in th.buffers(batch.column("bytes")):
        n = hi[at] - lo[at] + 1
        row = np.repeat(np.arange(at.start, at.stop), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = offsets[row - at.start] + step
        parts.append((row, anchor[row], lo[row] + step, th.Hashed(data)(start, start + length)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _compare(length: int):
    """Contexts in order of their anchors: the runs of windows that occur in more than one place."""

    def found(t: pa.Table) -> pa.RecordBatch:
        row, anchor, step, h = _windows(t, length)
        key = th.mix(th.mix(anchor.view(np.uint64) + step.astype(np.uint64)) ^ h)
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        some = times[which] > 1
        k, size, at = (np.asarray(t.column(n)) for n in ("k", "size", "at"))
        row, place = row[some], (at[row] + step)[some]
        cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(place) != 1)) + 1
        a, b = (np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(row) - 1]])) if len(row) else (row, row)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[row[a]], size[row[a]], place[a], place[b])], ["k", "size", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            anchor = np.asarray(batch.column("anchor"))
            if not len(anchor):
                continue
            cut = int(np.searchsorted(anchor, anchor[-1], "left")) if (np.diff(anchor) >= 0).all() else 0
            if cut or (held and held[-1].column("anchor")[len(held[-1]) - 1].as_py() != anchor[0]):
                ready = [*held, batch.slice(0, cut)]
                yield found(pa.Table.from_batches(ready).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    return run


def _exploded(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                row, anchor, step, h = _windows(batch, length)
                k, size, at = (np.asarray(batch.column(n))[row] for n in ("k", "size", "at"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, step, h.view(np.int64), k, size, at + step)], ["anchor", "step", "h", "k", "size", "first"])

    return run


def array(suffixes: DataFrame) -> DataFrame:
    """The suffixes as a written suffix array: range-partitioned and sorted, equal ones by place."""
    order = [*KEY, "span", "k", "at"]
    return written(suffixes.repartitionByRange(*order).sortWithinPartitions(*order), "array")


class SuffixIndex:
    """Suffix arrays of all batches so far: ``levels``, each (batches, array), sizes falling and no two alike."""

    def __init__(self, length: int = 200) -> None:
        self.length, self.levels = length, []

    def add(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Take in a batch of (k, text), k telling texts apart together with their size in bytes; what it repeats of itself and of the levels.

        Rows (k, size, first, last): runs of windows that repeat, in the batch or the levels; and the kinds (KIND, k, size, at of one suffix) that need the second look.
        """
        found = written(texts.mapInArrow(_suffixes(self.length, own=True), "head long, anchor long, span long, k long, size long, at long, lo short, hi short, first long, last long"), "suffixes")
        new = array(found.where("last is null").drop("first", "last"))
        own = written(found.where("last is not null").select("k", "size", "first", "last"), "own")
        forget(found)
        runs, looks = scan(new, [x for _, x in self.levels])
        self.levels.append((1, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, x), (_, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, array(x.union(y))))
            forget(x)
            forget(y)
        return runs.union(own), looks

    def forget(self) -> None:
        """Delete the levels."""
        for _, x in self.levels:
            forget(x)
        self.levels = []


def scan(new: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Merge-scan of the array ``new`` against those of ``levels``; see :meth:`SuffixIndex.add`."""
    rows = new.withColumn("new", F.lit(True))
    for level in levels:
        rows = rows.union(level.withColumn("new", F.lit(False)))
    shared = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("new").alias("fresh")).where("n > 1 and fresh")
    shared = written(shared.select(*KEY), "shared")  # read again, so that both sides of the join are plain exchanges, which Spark splits
    near = written(rows.join(shared.hint("merge"), KEY, "left_semi"), "scan")  # alike in ANCHOR bytes, one of them new
    kinds = written(near.groupBy(*KIND).agg(F.count("*").alias("n"), F.max("new").alias("fresh"), F.min(F.struct("k", "size", "at")).alias("one")), "kinds")
    whole = near.join(kinds.where("n > 1 and fresh").select(*KIND).hint("merge"), KIND, "left_semi")
    runs = written(whole.select("k", "size", (F.col("at") + F.col("lo")).alias("first"), (F.col("at") + F.col("hi")).alias("last")), "hits")
    several = kinds.groupBy(*KEY).agg(F.count("*").alias("kinds"), F.max("fresh").alias("fresh"), F.min("n").alias("least")).where("kinds > 1 and fresh and least = 1")
    several = written(several.select(*KEY), "several")
    looks = written(kinds.join(several.hint("merge"), KEY, "left_semi").select(*KIND, "one.*"), "looks")
    for x in (near, kinds, shared, several):
        forget(x)
    return runs, looks


def second_look(texts: DataFrame, looks: DataFrame, length: int) -> DataFrame:
    """(k, size, first, last): runs of windows that kinds of one anchor have in common."""
    looks = looks.select("anchor", "k", "size", "at", "lo", "hi").distinct()
    looks = written(looks, "looks")
    crowded = looks.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("anchor", F.lit(True).alias("many"))
    crowded = written(crowded, "crowded")
    looks = looks.join(crowded.hint("merge"), "anchor", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    looks = looks.groupBy("k", "size").agg(F.collect_list(F.struct("anchor", "at", "lo", "hi", "many")).alias("looks"))
    there = texts.withColumn("size", F.octet_length("text").cast("long")).join(looks.hint("shuffle_hash"), ["k", "size"]).dropDuplicates(["k", "size"])
    seen = written(there.select("k", "text", "looks").mapInArrow(_contexts(length), "anchor long, k long, size long, at long, lo short, hi short, many boolean, bytes binary"), "contexts")
    few = seen.where("not many").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length), "k long, size long, first long, last long")
    wide = written(seen.where("many").mapInArrow(_exploded(length), "anchor long, step long, h long, k long, size long, first long"), "windows")
    by = ["anchor", "step", "h"]
    often = written(wide.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by), "often")
    out = written(few.union(wide.join(often.hint("merge"), by, "left_semi").select("k", "size", "first", F.col("first").alias("last"))), "seconds")
    forget(seen)
    forget(wide)
    return out


def repeated_windows(docs: DataFrame, key: str, text: str, length: int = 200, batches: int = 2) -> DataFrame:
    """(key, size, runs): for each document with repeats (and its bytes) the array of (first, last) starts of windows that occur elsewhere."""
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    index, runs, looks = SuffixIndex(length), [], []
    for b in range(batches):
        hit, look = index.add(texts.where(F.pmod(F.xxhash64("k"), F.lit(batches)) == b))
        runs.append(hit)
        looks.append(look)
    index.forget()
    every = looks[0]
    for more in looks[1:]:
        every = every.union(more)
    runs.append(second_look(texts, every, length))
    found = runs[0]
    for more in runs[1:]:
        found = found.union(more)
    found = written(found.groupBy("k", "size").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    for x in (*runs, *looks):
        forget(x)
    return found.withColumnRenamed("k", key)


def _cut(length: int, text_col: str, whole_characters: bool):
    """Texts and their runs of repeated windows: what is left, and the spans that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, runs in zip(batch.column("row").field(text_col), batch.column("runs").to_pylist(), strict=True):
                data = text.as_py().encode() if text.is_valid else b""
                merged: list[list[int]] = []
                for r in sorted(runs or [], key=lambda x: (x["first"], x["last"])):
                    a, z = r["first"], r["last"] + length
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(z, merged[-1][1])
                    else:
                        merged.append([a, z])
                if whole_characters:  # a character of which only a part repeats stays
                    for m in merged:
                        while m[0] < m[1] and m[0] < len(data) and data[m[0]] & 0xC0 == 0x80:
                            m[0] += 1
                        while m[1] < len(data) and m[1] > m[0] and data[m[1]] & 0xC0 == 0x80:
                            m[1] -= 1
                at, left = 0, []
                for a, z in merged:
                    left.append(data[at:a])
                    at = z
                kept.append(b"".join([*left, data[at:]]))
                spans.append([{"first": a, "last": z} for a, z in merged])
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), pa.array(spans, kind), sha], ["row", "kept", "spans", "sha256"])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = 200, batches: int = 2, whole_characters: bool = False) -> DataFrame:
    """``docs`` with kept (binary), spans (array of [first, last) byte ranges), n_bytes, n_removed and kept_sha256.

    Every byte goes that is covered by a ``length``-byte string (UTF-8) that also starts anywhere else, same document
    included; overlaps count and strings are judged on the input. Null and empty texts have no bytes; a null text keeps
    an empty ``kept``. Matches never cross documents. Repeated rows are copies of each other, so all their strings
    of ``length`` bytes go. With ``whole_characters`` a character that repeats only in part stays, so that kept is UTF-8. Strings
    are compared by 64-bit hashes, among those only whose anchors are alike by eight bytes and a hash of their own. Other columns stay, but those with the new names are replaced. Empty
    tables give empty results. Rows are told apart by a 64-bit hash of id and text, and by their size.
    """
    docs = docs.drop(*({"kept", "spans", "kept_sha256", "n_bytes", "n_removed"} - {id_col, text_col}))
    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k"), F.struct(*docs.columns).alias("row"))
    found = repeated_windows(keyed.select("_k", F.col("row")[text_col].alias("_text")), "_k", "_text", length, batches)
    packed = keyed.withColumn("size", F.coalesce(F.octet_length(F.col("row")[text_col]), F.lit(0)).cast("long")).join(found, ["_k", "size"], "left").select("row", "runs")
    row = docs.schema.simpleString()
    out = packed.mapInArrow(_cut(length, text_col, whole_characters), f"row {row}, kept binary, spans array<struct<first:long,last:long>>, sha256 string")
    n = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return out.select("row.*", "kept", "spans", F.col("sha256").alias("kept_sha256")).withColumn("n_bytes", n).withColumn("n_removed", n - F.octet_length("kept"))
