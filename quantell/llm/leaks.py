"""Problem 8: evaluation texts in training texts, by winnowing.

Words of a text are hashed in runs of ``K``; of each window of ``W`` such hashes the least is kept (the last of equals),
as in the public paper of Schleimer, Wilkerson and Aiken (2003). Two texts that share ``K + W - 1`` words in a row keep
a hash in common, so no shared span of that length is missed. Hits are extended word by word, which also settles
clashes of hashes.

Fingerprints of the items are shared with the tasks as long as the items have at most ``SHARED_WORDS`` words, which is
counted first; the corpus is then read once and not shuffled. Larger sets are joined: fingerprints of both sides by
their hash. There a hit must also agree in one of the ``W`` runs of ``K + W - 1`` words around it, so a frequent hash
yields no more than what is really shared, and texts are compared only for the documents and items that remain.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantell.plans.shared import written

#: Words of a hashed run, and hashes of a window.
K, W = 4, 5
#: Words of evaluation items that are shared with the tasks at most; larger sets are joined by shuffle.
SHARED_WORDS = 2_000_000
#: Distinct words whose hashes a task remembers.
KNOWN_WORDS = 1_000_000

#: Tags that end a line or a cell part words; other tags are taken out.
_PARTING = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|pre|hr)\b[^<>]*>|\[/?(?:quote|list|table|tr|td|img|code)\b[^\[\]]*\]", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>|\[[^\[\]]*\]")
_WORD = re.compile(r"[^\W_]+")


#: ASCII without case, all but letters and digits blank.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


class _Marks(dict):
    """For ``str.translate``: what to do with a character, found out once: marks and invisible characters go."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if c > 127 and unicodedata.category(chr(c)) in ("Mn", "Me", "Cf") else c
        return self[c]


_MARKS = _Marks()


def words(text: str) -> list[str]:
    """Runs of letters and digits without case, accents, markup, quote marks at line starts and invisible characters."""
    if "<" in text or "[" in text:
        text = _TAG.sub("", _PARTING.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():  # quote marks at line starts part words as all punctuation does
        return text.translate(_ASCII).split()
    text = unicodedata.normalize("NFKD", text.casefold()).translate(_MARKS)
    return _WORD.findall(text.casefold())


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


def run_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hashes of all runs of k words: a polynomial of the words' hashes, without their order lost."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions kept: the least hash of each window, of equals the last; a shorter text keeps its least hash."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= W:
        return np.array([len(h) - 1 - int(h[::-1].argmin())])
    windows = np.lib.stride_tricks.sliding_window_view(h, W)[:, ::-1]
    return np.unique(np.arange(len(windows)) + W - 1 - windows.argmin(1))


@dataclass
class Items:
    """Evaluation items: their words, and where each kept hash stands."""

    ids: list = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    at: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @classmethod
    def of(cls, rows: list[tuple[int, list[str]]]) -> Items:
        self = cls()
        for i, (item, ws) in enumerate(rows):
            self.ids.append(item)
            self.words.append(ws)
            h = run_hashes(word_hashes(ws))
            for p in winnow(h):
                self.at.setdefault(int(h[p]), []).append((i, int(p)))
        self.kept = np.array(sorted(self.at), np.uint64)
        return self

    def known(self, h: np.ndarray) -> np.ndarray:
        if not len(self.kept):
            return np.zeros(len(h), bool)
        return self.kept[np.minimum(np.searchsorted(self.kept, h), len(self.kept) - 1)] == h

    def hits(self, ws: list[str], h: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
        """``(item, first word here, first word there, words)`` of all maximal shared spans of at least ``least`` words; h are
        the hashes of the runs of ``ws``."""
        kept = winnow(h)
        kept = kept[self.known(h[kept])]
        seen: set[tuple[int, int, int]] = set()
        for p, v in zip(kept.tolist(), h[kept].tolist(), strict=True):
            for i, q in self.at[v]:
                other = self.words[i]
                a, b = p, q
                if ws[a] != other[b]:
                    continue
                while a and b and ws[a - 1] == other[b - 1]:
                    a, b = a - 1, b - 1
                if (i, a, b) in seen:
                    continue
                seen.add((i, a, b))
                n = 0
                while a + n < len(ws) and b + n < len(other) and ws[a + n] == other[b + n]:
                    n += 1
                if n >= least:
                    yield i, a, b, n

    def search(self, texts: list[list[str]], least: int) -> Iterator[tuple[int, int, int, int, int]]:
        """The hits of many texts, the text's number first. All runs of all texts are looked up at once; only texts that
        hold a kept hash of an item, among their own kept ones or not, are looked at further."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        h = run_hashes(word_hashes(list(chain.from_iterable(texts))))
        for t in np.unique(np.searchsorted(ends, np.flatnonzero(self.known(h)), "right")):
            own = h[ends[t] - size[t] : max(ends[t] - K + 1, ends[t] - size[t])]  # without runs that reach into the next text
            for hit in self.hits(texts[t], own, least):
                yield int(t), *hit


def _spans(name: tuple[str, str]) -> tuple[str, list[str]]:
    cols = [*name, "doc_word", "item_word", "n_words", "n_item_words"]
    return f"`{name[0]}` long, `{name[1]}` long, doc_word int, item_word int, n_words int, n_item_words int", cols


def _batch(rows: list[tuple], cols: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
    values = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], cols)


def _search_shared(corpus: DataFrame, items: list[tuple[int, list[str]]], least: int, names: tuple[str, str]) -> DataFrame:
    """Items of a checked size, shared with the tasks."""
    shared = corpus.sparkSession.sparkContext.broadcast(Items.of(items))  # at most SHARED_WORDS words
    schema, cols = _spans(names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            found = it.search([words(t) for t in b.column(1).to_pylist()], least)
            yield _batch([(ids[t], it.ids[i], a, c, n, len(it.words[i])) for t, i, a, c, n in found], cols)

    return corpus.mapInArrow(look, schema)


def _fingerprints(texts: DataFrame) -> DataFrame:
    """``(id, hash, r0…)``: the hashes that winnowing keeps of each text, with those of the runs of K + W - 1 words around each."""
    around = [f"r{o}" for o in range(W)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = word_hashes(words(text))
                h, long = run_hashes(ws), run_hashes(ws, K + W - 1)
                kept = winnow(h)
                at = kept[:, None] - np.arange(W)[None]
                inside = (at >= 0) & (at < len(long))
                runs = np.where(inside, long[np.clip(at, 0, max(len(long) - 1, 0))], 0) if len(long) else np.zeros(at.shape, np.uint64)
                out.append((np.full(len(kept), i), h[kept].view(np.int64), runs.astype(np.uint64).view(np.int64), inside))
            ids, hs, runs, inside = (np.concatenate([o[k] for o in out]) for k in range(4)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros((0, W), np.int64),) * 2
            cols = [pa.array(ids, pa.int64()), pa.array(hs), *[pa.array(runs[:, o], mask=~inside[:, o].astype(bool)) for o in range(W)]]
            yield pa.RecordBatch.from_arrays(cols, ["id", "hash", *around])

    return texts.mapInArrow(prints, "id long, hash long, " + ", ".join(f"{c} long" for c in around))


def _search_joined(corpus: DataFrame, tests: DataFrame, least: int, names: tuple[str, str]) -> DataFrame:
    """Items of any size, joined by their fingerprints. A frequent hash is split by adaptive skew handling."""
    d = _fingerprints(corpus).withColumnRenamed("id", "d")
    i = _fingerprints(tests).select(F.col("id").alias("i"), "hash", *[F.col(f"r{o}").alias(f"s{o}") for o in range(W)])
    same = F.lit(False)
    for o in range(W):
        same = same | F.coalesce(F.col(f"r{o}") == F.col(f"s{o}"), F.lit(False))
    pairs = written(d.join(i, "hash").where(same).select("d", "i").distinct())
    both = pairs.join(corpus, "d").join(tests.select("i", F.col("t").alias("u")), "i").select("d", "i", "t", "u")
    schema, cols = _spans(names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, item, t, u in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ws, other = words(t), words(u)
                if len(other) >= least:
                    found = Items.of([(item, other)]).hits(ws, run_hashes(word_hashes(ws)), least)
                    rows += [(doc, item, a, c, n, len(other)) for _, a, c, n in found]
            yield _batch(rows, cols)

    return both.mapInArrow(compare, schema)


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = K + W - 1) -> DataFrame:
    """``(doc_id, item_id, doc_word, item_word, n_words, n_item_words)``: every maximal run of at least ``least`` shared words.

    ``least`` may not be below ``K + W - 1``, the length that winnowing guarantees. Texts that are null or have fewer
    words give nothing; rows with a null id are left out; repeated rows give repeated results. Documents are read in
    whole: once where the items have at most ``SHARED_WORDS`` words, else once for their fingerprints and once for those
    that share one.
    """
    if least < K + W - 1:
        raise ValueError(f"spans below {K + W - 1} words aren't guaranteed")
    corpus = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    tests = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(words(t)) for t in b.column(0).to_pylist())], pa.int64())})

    n = tests.select("t").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    if n > SHARED_WORDS:
        return _search_joined(corpus, tests, least, (doc_id, item_id))
    rows = [(r.i, words(r.t)) for r in tests.collect()]  # texts of at most SHARED_WORDS words
    return _search_shared(corpus, [(i, ws) for i, ws in rows if len(ws) >= least], least, (doc_id, item_id))


def leaked_pairs(spans: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``(doc_id, item_id, n_spans, longest, share)``: per pair the spans, the longest, and the share of the item that all
    spans together cover, words of overlapping spans counted once."""
    runs = F.sort_array(F.collect_set(F.struct(F.col("item_word").alias("a"), (F.col("item_word") + F.col("n_words")).alias("b"))))
    pairs = spans.groupBy(doc_id, item_id).agg(F.count("*").cast("long").alias("n_spans"), F.max("n_words").alias("longest"), F.max("n_item_words").alias("n"), runs.alias("runs"))
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    more = F.aggregate("runs", start, lambda s, r: F.struct((s["covered"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("covered"), F.greatest(s["end"], r["b"]).alias("end")))
    return pairs.select(doc_id, item_id, "n_spans", "longest", F.round(more["covered"] / F.col("n"), 6).alias("share"))
