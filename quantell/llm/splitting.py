"""Problem 10: cutting long texts into pieces under a limit, at natural boundaries, with an overlap.

Boundaries form a hierarchy: section, paragraph, line, sentence, word, character. A piece is packed greedily: it takes
all tokens up to the last boundary of the coarsest level that lies within the limit and fills the piece to
``least_fill``. Where no section, paragraph, line or sentence ends there, it takes the last of those ends that lies beyond
the overlap, and only where there is none it is cut between words. The next piece starts ``overlap`` tokens before the end.
Where a single word of more than the limit has to be cut (possible only for sizes other than tokens), it is cut between
characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantell.llm.tokens import PYTHON_TOKEN, token_count

#: Levels of boundaries from coarse to fine; a match's end is where a piece may end.
SEPARATORS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("section", re.compile(r"\n[ \t]*(?:~~~+|___+|---+|===+|\*\*\*+|#{1,6} [^\n]*)[ \t]*\n|\n[ \t\r]*\n[ \t\r]*\n\s*")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+")),
)


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all tokens."""
    spans = [m.span() for m in PYTHON_TOKEN.finditer(text)]
    both = np.array(spans, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def character_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Every character as a unit of its own, for limits in characters."""
    return np.arange(len(text)), np.arange(1, len(text) + 1)


def pieces(
    text: str, limit: int = 512, overlap: int = 64, least_fill: float = 0.5, spans: Callable[[str], tuple[np.ndarray, np.ndarray]] = token_spans,
) -> list[tuple[int, int, int, int, str]]:
    """``(start, end, units, shared characters, level)`` of each piece; one piece if the text is within the limit.

    Every character of the text lies in a piece: the first begins at 0, the last ends at the end, and each begins
    within or at the end of the one before it. ``level`` says at what boundary the piece ends.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    starts, ends = spans(text)
    n = len(starts)
    if n <= limit:
        return [(0, len(text), n, 0, "end")]
    levels = []
    for name, pattern in SEPARATORS:
        at = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        # The units before each boundary; a boundary inside a unit isn't one.
        k = np.searchsorted(starts, at, "left")
        whole = (k > 0) & (k < n) & (ends[np.maximum(k - 1, 0)] <= at)
        levels.append((name, np.unique(k[whole])))
    words = np.flatnonzero(ends[:-1] < starts[1:]) + 1  # white space between two units
    out: list[tuple[int, int, int, int, str]] = []
    first, begin, shared = 0, 0, 0
    while n - first > limit:
        least, most = first + max(overlap + 1, int(limit * least_fill)), first + limit
        end, level = most, "character"
        for name, at in levels:
            i = np.searchsorted(at, most, "right") - 1
            if i >= 0 and at[i] >= least:
                end, level = int(at[i]), name
                break
        else:
            early = [(int(at[i]), -k) for k, (_, at) in enumerate(levels) if (i := np.searchsorted(at, most, "right") - 1) >= 0 and at[i] > first + overlap]
            i = np.searchsorted(words, most, "right") - 1
            if early:
                end, level = max(early)[0], levels[-max(early)[1]][0]
            elif i >= 0 and words[i] >= least:
                end, level = int(words[i]), "word"
        stop = int(starts[end])
        out.append((begin, stop, end - first, shared, level))
        first = end - overlap
        begin = int(starts[first]) if overlap else stop
        shared = stop - begin
    out.append((begin, len(text), n - first, shared, "end"))
    return out


def split_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 512, overlap: int = 64, least_fill: float = 0.5, all_texts: bool = False) -> DataFrame:
    """``(doc_id, piece, n_pieces, start, n_tokens, overlap_chars, level, text)`` of the texts of more than ``limit`` tokens.

    Pieces are numbered from 1. A piece has at most ``limit`` tokens and starts with the last ``overlap`` tokens of the
    piece before; the text is rebuilt by joining the pieces without their first ``overlap_chars`` characters.
    ``all_texts`` gives shorter texts too, as one piece. Rows with a null id or text are left out, a repeated row is
    split as often as it occurs, texts are taken whole. Counting runs in the JVM, so only long texts reach Python.
    """
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    if not all_texts:
        rows = rows.where(token_count(F.col("t")) > limit)
    kind = dict(docs.dtypes)[doc_id]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            at: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = pieces(t, limit, overlap, least_fill)
                for k, (s, e, n, shared, level) in enumerate(found, 1):
                    at.append(i)
                    rows.append((k, len(found), s, n, shared, level, t[s:e]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [doc_id, "piece", "n_pieces", "start", "n_tokens", "overlap_chars", "level", "text"])

    return rows.mapInArrow(cut, f"`{doc_id}` {kind}, piece int, n_pieces int, start long, n_tokens int, overlap_chars int, level string, text string")


def rebuilt(parts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, text)`` from the pieces of texts that occur once."""
    tail = F.struct("piece", F.expr("substring(text, overlap_chars + 1)").alias("t"))
    return parts.groupBy(doc_id).agg(F.concat_ws("", F.sort_array(F.collect_list(tail)).getField("t")).alias("text"))
