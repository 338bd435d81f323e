"""Tokenizing whole texts with a public vocabulary: a broadcast table of frequent pre-tokens, and worker caches.

A text is cut into pre-tokens as the vocabulary itself does it, in any script: no token crosses white space, and in Latin words none crosses
the vocabulary's own cuts, so a text's ids are those of its pre-tokens, one after the other. Two tiers know a pre-token: a compact table of frequent ones, broadcast
once, and a bounded cache in each worker, filled by the library; beside it the worker keeps what the words between white space came to. No pre-token is ever shuffled. The first tier comes from a bounded
sample of documents; it only saves work, whatever it holds the results are the library's.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed bounds: documents of the sample that names frequent pre-tokens, the longest one in it, pre-tokens of the broadcast table, of a worker's cache (which holds twice as many words), and the longest cached one.
SAMPLE_ROWS, SAMPLE_CHARS, TABLE_ROWS, CACHE_ROWS, LONGEST = 2000, 20_000, 32_768, 400_000, 64

#: The vocabulary's own cut of lower-cased text, for Latin letters: fixed by the vocabulary's file.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")
#: Characters whose case, form or class other libraries may see otherwise, and the start of special strings.
ODD = re.compile("[^\x00-\u024f]|[\x1c-\x1f\x85\xa0\u0130]|<\\|")
#: White space of the libraries; Python counts four separators more.
SPACE = re.compile(r"[^\S\x1c-\x1f]+")
#: A control character of one id; it stands between pre-tokens that are encoded in one run.
BETWEEN = "\x7f"


def plain_words(text: str) -> list[str]:
    """The text's words (between white space), in lower case; those with a character of ODD as they are, in any script."""
    if not ODD.search(text):
        return text.lower().split()
    return [w if ODD.search(w) else w.lower() for w in SPACE.split(text) if w]


def pretokens(text: str) -> list[str]:
    """The text's pre-tokens as the vocabulary cuts them; words with a character of ODD stay whole."""
    return [x for w in plain_words(text) for x in ([w] if ODD.search(w) else PRETOKEN.findall(w))]


class WordEncoder:
    """Of texts, by pre-token: the ids as little-endian unsigned 32-bit bytes, or with ``lengths`` their number. ``first``: the broadcast tier."""

    def __init__(self, path: str, first: dict | None = None, lengths: bool = False) -> None:
        from tokenizers import Tokenizer

        self.library, self.lengths = Tokenizer.from_file(path), lengths
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        mark = self.library.encode(BETWEEN, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.first, self.known, self.words = first or {}, dict(first or {}), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids that the library gives for each text, special strings handled as its default."""
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> dict:
        """The ids, or lengths, of pre-tokens. Those of letters only are encoded in one run and cut where a word's last token ends, others with BETWEEN between each two."""
        words, rest, apart = [], [], []
        for w in new:
            (words if w.isalpha() else apart if self.mark is None or BETWEEN in w or len(w) > LONGEST else rest).append(w)
        out: dict = {}

        def cut(of: list[str], ids: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> None:
            if len(stop) != len(of):
                apart.extend(of)
            elif self.lengths:
                out.update(zip(of, (stop - begin).tolist(), strict=True))
            else:
                run = ids.tobytes()
                out.update((w, run[a:z]) for w, a, z in zip(of, (4 * begin).tolist(), (4 * stop).tolist(), strict=True))

        if words:
            ids = self._run(" ".join(words))
            stop = np.flatnonzero(self.ends[ids]) + 1
            cut(words, ids, np.concatenate([[0], stop[:-1]]), stop)
        if rest:
            ids = self._run(f" {BETWEEN} ".join(rest))
            stop = np.append(np.flatnonzero(ids == self.mark), len(ids))
            cut(rest, ids, np.concatenate([[0], stop[:-1] + 1]), stop)
        found = zip(apart, self.encode(apart), strict=True)
        return out | ({w: len(x) // 4 for w, x in found} if self.lengths else dict(found))

    def _run(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def __call__(self, text: str):
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list:
        """The ids, or numbers of ids, of texts."""
        cut = [plain_words(x) for x in texts]
        some = set().union(*cut)
        new = list(some.difference(self.words))
        if len(self.words) + len(new) > 2 * CACHE_ROWS:  # the words of this run stay
            self.words = {w: self.words[w] for w in some.intersection(self.words)}
        if len(self.known) > CACHE_ROWS:
            self.known = dict(self.first)
        odd = ODD.search(" ".join(new)) is not None
        parts = [[w] if odd and ODD.search(w) else PRETOKEN.findall(w) for w in new]
        self.known.update(self.learn(list({x for p in parts for x in p}.difference(self.known))))
        get, add = self.known.__getitem__, sum if self.lengths else b"".join
        self.words.update((w, get(p[0]) if len(p) == 1 else add(map(get, p))) for w, p in zip(new, parts, strict=True))
        word = self.words.__getitem__
        out = [add(map(word, x)) for x in cut]
        for w, p in zip(new, parts, strict=True):
            if len(w) > LONGEST:  # only such words have parts as long
                del self.words[w]
                for x in p:
                    if len(x) > LONGEST:
                        self.known.pop(x, None)
        return out

    def batch(self, texts: list[str], most: int = 1_000_000) -> Iterator:
        """What :meth:`many` gives for each text, in runs of about ``most`` characters."""
        run: list[str] = []
        size = 0
        for x in texts:
            run.append(x)
            size += len(x)
            if size >= most:
                yield from self.many(run)
                run, size = [], 0
        yield from self.many(run)


def frequent_pretokens(df: DataFrame, text: str, path: str) -> dict[str, int]:
    """The first tier: lengths of the TABLE_ROWS most frequent pre-tokens of at most SAMPLE_ROWS documents, none over SAMPLE_CHARS characters.

    The sample comes to the driver (40 MB of text at most, some 4 MB as a rule), from as few partitions as hold it; counting there takes a second.
    """
    seen: Counter = Counter()
    for r in df.select(F.col(text).alias("text")).where(F.length("text") <= SAMPLE_CHARS).limit(SAMPLE_ROWS).collect():
        seen.update(pretokens(r["text"]))
    words = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n > 1 and len(w) <= LONGEST][:TABLE_ROWS]
    return WordEncoder(path, lengths=True).learn(words)


def encoder(first, path: str, lengths: bool = False) -> WordEncoder:
    """The worker's encoder for a broadcast first tier; kept for the life of the worker so that its cache serves all its tasks."""
    kept = encoder.__dict__.setdefault("kept", {})
    key = (path, lengths, first.id if hasattr(first, "id") else id(first))
    if key not in kept:
        kept.clear()
        kept[key] = WordEncoder(path, getattr(first, "value", first), lengths)
    return kept[key]


def release() -> None:
    """Give up the worker's encoder, whose cache may take hundreds of MB: a worker that is used again goes on with other work."""
    encoder.__dict__.pop("kept", None)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, over_limit), one per row of ``df``; null texts are empty, null ids are kept.

    Counts are those of the library at ``path`` without added special tokens, for whole texts however long. Repeated
    rows are counted each; other columns are ignored; an empty table gives an empty result. Works row by row: no shuffle.
    """
    first = df.sparkSession.sparkContext.broadcast(frequent_pretokens(df, text_col, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(first, path, lengths=True)
        for batch in batches:
            n = pa.array(list(encode.batch(batch.column("text").to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows (id_col, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut every ``room`` ids if longer.

    ids_crc32 is over the piece's ids as little-endian unsigned 32-bit numbers. Null texts are empty: one piece of
    length 1. Other columns are ignored; with ``with_ids`` the ids come too, as array<int>.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(None, path)
        for batch in batches:
            rows: list[tuple] = []
            for at, own in enumerate(encode.batch(batch.column("text").to_pylist())):
                own += end
                for k, begin in enumerate(range(0, len(own), 4 * room)):
                    part = own[begin : begin + 4 * room]
                    rows.append((at, k, begin // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] * with_ids)))
            of, *columns = zip(*rows, strict=True) if rows else [[]] * (5 + with_ids)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
            arrays = [batch.column("id").take(pa.array(of, pa.int64())), *[pa.array(list(x), t) for x, t in zip(columns, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
