"""Statistics of whole texts, computed over Arrow batches; used as inputs of classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.words import batches, lists, segments

STATS = ["log_words", "word_length", "upper_share", "digit_share", "bang_share", "pipe_share", "symbol_share",
         "stop_share", "repeat_share", "distinct_share", "symbol_end_share", "capital_share", "long_word_share",
         "line_length", "non_ascii_share", "repeated_line_share"]

#: What the classes of bytes are; everything that is not listed is in none of them.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
            "bang": b"!", "pipe": b"|", "symbol": b"#$%&*@^~_=+<>{}[]\\", "stop": b".,;:?", "space": b" \t\n\r\x0b\x0c"}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASSES.items()}
_TABLES["non_ascii"] = np.arange(256) >= 128
#: Characters that words of a lexicon end at, besides white space.
PUNCTUATION = ".,;:!?()\"'|#$%&*"
_TO_SPACES = bytes.maketrans(PUNCTUATION.encode(), b" " * len(PUNCTUATION))


def _stats(texts: list, lexicons: list) -> np.ndarray:
    """One row for each text: STATS, then for each lexicon the number of words in it."""
    texts = [t or b"" for t in texts]
    out = np.zeros((len(texts), len(STATS) + len(lexicons)))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = segments(size)[:-1][full]
    count = {k: np.add.reduceat(t[data], at, dtype=np.int64) for k, t in _TABLES.items()}
    space = _TABLES["space"][data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, space[:-1]
    first[at] = True
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, space[1:]
    last[at[1:] - 1] = True
    ends = np.add.reduceat(last & (_TABLES["symbol"] | _TABLES["bang"])[data], at, dtype=np.int64)
    capitals = np.add.reduceat(first & _TABLES["upper"][data], at, dtype=np.int64)
    for k, i in enumerate(full):
        t = texts[i]
        words = t.split()
        n = max(1, len(words))
        ink = max(1, size[i] - count["space"][k])
        lines = t.splitlines()
        out[i, :len(STATS)] = (
            np.log1p(len(words)), ink / n, count["upper"][k] / max(1, count["upper"][k] + count["lower"][k]),
            count["digit"][k] / ink, count["bang"][k] / ink, count["pipe"][k] / ink, count["symbol"][k] / ink,
            count["stop"][k] / ink, sum(map(eq, words, words[1:])) / n, len(set(words)) / n, ends[k] / n,
            capitals[k] / n, sum(x > 20 for x in map(len, words)) / n, np.log1p(size[i] / max(1, len(lines))),
            count["non_ascii"][k] / ink, 1 - len(set(lines)) / max(1, len(lines)))
        if lexicons:
            plain = t.lower().translate(_TO_SPACES).split()
            out[i, len(STATS):] = [sum(map(x.__contains__, plain)) for x in lexicons]
    return out


def _add(it: Iterator[pa.RecordBatch], text: str, lexicons: list, then: Callable | None) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, text):
        s = _stats(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist(), lexicons)
        s = then(s) if then else s
        col = lists(s.ravel(), np.arange(len(s) + 1) * s.shape[1], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, col], names=[*batch.schema.names, "__stats"])


def with_stats(df: DataFrame, text: str, lexicons: list | None = None, then: Callable | None = None) -> DataFrame:
    """``df`` with ``__stats`` array<double>: STATS and the hits of each lexicon (a set of lower-case bytes words).

    All numbers are 0 for a null or empty text. ``then`` may turn the rows of numbers into others.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__stats", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(partial(_add, text=text, lexicons=lexicons or [], then=then), schema)


def stat_columns(stats: Column | None = None) -> list:
    """A column expression for each of STATS, taken from the array ``stats``."""
    return [F.element_at("__stats" if stats is None else stats, i + 1) for i in range(len(STATS))]
