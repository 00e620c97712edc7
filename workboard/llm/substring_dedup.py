"""Repeated passages by recompression (operator 5).

A window is ``WINDOW`` consecutive words. Every word covered by a window whose word sequence starts anywhere else too is
removed. Recompression makes equal passages recognisable without comparing all windows: rounds name runs of equal
symbols, then pairs of a left and a right symbol (the side is a bit of the symbol's name, another one each round), then
blocks of pair symbols. A name is a 64-bit hash of the names it stands for, so names are global: every task gives the
same run, pair or block the same name without a dictionary to exchange. Only symbols of bounded length take part in a
round, so whether a symbol starts at a word depends on at most ``CONTEXT`` words on either side, and no symbol of the
pair rounds is longer than 4 words (long runs stay uncompressed). A block is as many symbols as cover ``BLOCK`` words,
hence at most ``BLOCK`` + 3. Equal windows therefore have the same blocks in their interiors, wherever they lie.

Two Spark rounds follow. The first counts block names over the corpus: each window is represented by the smallest of
its interior blocks, and the blocks that occur twice are the join keys that reveal repeats; a window whose block is
unique cannot repeat. The second goes down to the lowest level: windows around shared blocks are named by their words,
each word by 128 bits in two unrelated halves, and counted by both sums of 64 bits; windows counted twice and more are
removed, and as neighbouring windows overlap, what goes are the maximal repeats. No window is lost by the blocks: that
follows from the bounds above.

Documents with equal word sequences are one class, counted first: all words of a class of two and more go (if it has a
window), and one document of it stands for all in the search. Counts combine before their shuffles and names are
joined back by plain joins, so a passage or a copy in a third of all rows spreads. A document's own blocks and
starts are gathered per document, which is bounded by the document.

Edge cases: null, empty and blank texts have no words and the digest of the empty string. Texts shorter than a window
lose nothing. Rows that repeat an id, or id and text, are documents of their own, so a repeated row of a window or more
loses all its words. A null id stays null. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.llm.store import cut, small
from workboard.llm.words import batches, mix, segments, window_hashes

WINDOW = 35
#: Longest run that gets a name, and longest symbols that take part in each pair round.
RUN = 2
PAIR_ROUNDS = (1, 1, 2)
#: Longest symbol of the pair rounds, and words that the symbols of a block cover at least.
SYMBOL = 4
BLOCK = 8
#: Words on either side that decide whether a symbol starts at a word.
CONTEXT = RUN + sum(PAIR_ROUNDS)
#: A window's blocks start within these words of it; they end where the window still decides the symbols.
FIRST, LAST = CONTEXT, WINDOW - CONTEXT - (BLOCK + SYMBOL - 1)
assert LAST - FIRST + 1 >= SYMBOL and SYMBOL >= max(RUN, 2 * max(PAIR_ROUNDS))

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SIDES = mix(np.arange(1, len(PAIR_ROUNDS) + 1, dtype=np.uint64) * _PAIR)
#: Odd base of the block names and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def symbols(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, first word) of the symbols after all run and pair rounds; ``starts`` are the first words of documents."""
    at = np.arange(len(words))
    head = np.zeros(len(words), bool)
    head[starts[starts < len(words)]] = True
    name, length = words.copy(), np.ones(len(words), np.int64)
    if not len(words):
        return name, at
    # runs of equal symbols
    begins = np.flatnonzero(np.append(True, name[1:] != name[:-1]) | head)
    run = np.diff(np.append(begins, len(name)))
    short = (run >= 2) & (run <= RUN)
    keep = np.ones(len(name), bool)
    for k in range(1, RUN):
        keep[(begins[short & (run > k)] + k)] = False
    name[begins[short]] = mix(name[begins[short]] * _PAIR + run[short].astype(np.uint64))
    length[begins[short]] = run[short]
    name, length, head, at = name[keep], length[keep], head[keep], at[keep]
    for r, most in enumerate(PAIR_ROUNDS):
        right = (mix(name ^ _SIDES[r]) & np.uint64(1)).astype(bool)
        active = length <= most
        joins = np.flatnonzero(active[:-1] & active[1:] & ~right[:-1] & right[1:] & ~head[1:])
        name[joins] = mix(name[joins] * _PAIR + mix(name[joins + 1]))
        length[joins] += length[joins + 1]
        keep = np.ones(len(name), bool)
        keep[joins + 1] = False
        name, length, head, at = name[keep], length[keep], head[keep], at[keep]
    return name, at


def blocks(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The name of the block that starts at each word, ``_NONE`` where none does.

    A block's name is made of the names of its symbols alone, the same wherever it stands.
    """
    out = np.full(len(words), _NONE)
    name, at = symbols(words, starts)
    if not len(name):
        return out
    n = len(words)
    ends = np.append(np.sort(starts[starts < n]), n)  # of documents
    last = ends[np.searchsorted(ends, at, side="right")]
    first = np.flatnonzero(at + BLOCK <= last)
    stop = np.searchsorted(np.append(at, n), at[first] + BLOCK)

    def series(base: int) -> np.ndarray:
        factors = np.full(len(name) + 1, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    sums = np.append(np.uint64(0), np.cumsum(mix(name) * series(_BASE)[:-1], dtype=np.uint64))
    out[at[first]] = mix((sums[stop] - sums[first]) * series(_INVERSE)[first])
    return out


def window_marks(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, position) of the smallest interior block of the window at each word that a whole window follows."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    v, p = blocks(words, starts), np.arange(len(words))
    width = 1
    while width <= LAST - FIRST:  # the smallest of twice as many words, of equal ones the first
        by = min(width, LAST - FIRST + 1 - width)
        later = v[by:] < v[:-by]
        v, p = np.where(later, v[by:], v[:-by]), np.where(later, p[by:], p[:-by])
        width += by
    return v[FIRST:FIRST + n], p[FIRST:FIRST + n]


def _texts(batch: pa.RecordBatch, name: str) -> list:
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _hashed(texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the two halves of their 128-bit hashes and the words' offsets by text."""
    split = [t.split() for t in texts]
    flat = b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(split)))
    both = np.frombuffer(flat, "<u8").reshape(-1, 2)
    return split, both[:, 0].copy(), both[:, 1].copy(), segments(np.array([len(w) for w in split]))


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, "text"):
        split, words, _, off = _hashed(_texts(batch, "text"))
        value, pos = window_marks(words, off[:-1])
        marks = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            n = b - a - WINDOW + 1
            if n <= 0:
                marks.append(np.empty(0, np.uint64))
                continue
            p = pos[a:a + n]
            marks.append(value[a:a + n][np.append(True, p[1:] != p[:-1])])
        at = segments(np.array([len(m) for m in marks]))
        flat = np.concatenate(marks) if marks else np.empty(0, np.uint64)
        digest = [hashlib.sha256(b" ".join(w)).digest() for w in split]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(off), pa.int64()), pa.array(digest, pa.binary()),
             pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))],
            names=["doc_id", "key", "n_words", "digest", "marks"])


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, h1, h2) of the windows whose block is among the document's shared ``marks``."""
    for batch in batches(it, "text"):
        key = batch.column(0).to_numpy()
        marks = batch.column(batch.schema.get_field_index("marks"))
        _, words, check, off = _hashed(_texts(batch, "text"))
        value, _ = window_marks(words, off[:-1])
        which, start = [], []
        for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
            n = b - a - WINDOW + 1
            if n > 0:
                known = marks[i].values.to_numpy().view(np.uint64)
                s = np.flatnonzero(np.isin(value[a:a + n], known))
                which.append(np.full(len(s), i))
                start.append(s)
        if not which:
            continue
        which, start = np.concatenate(which), np.concatenate(start)
        at = off[which] + start
        h1 = mix(window_hashes(words, WINDOW))[at]
        h2 = window_hashes(mix(check), WINDOW)[at]
        for k in range(0, len(at), 200_000):
            part = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[which[part]]), pa.array(start[part].astype(np.int32)), pa.array(h1[part].view(np.int64)),
                 pa.array(h2[part].view(np.int64))], names=["key", "start", "h1", "h2"])


def _remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(it, "text"):
        starts = batch.column(batch.schema.get_field_index("starts"))
        removed, kept = [], []
        for i, t in enumerate(_texts(batch, "text")):
            w = t.split()
            step = np.zeros(len(w) + 1, np.int64)
            s = starts[i].values.to_numpy()
            np.add.at(step, s, 1)
            np.add.at(step, s + WINDOW, -1)
            gone = np.cumsum(step)[:-1] > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["key", "n_removed", "sha", "kept_text"])


def _repeated(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """The values of ``names`` that ``rows`` hold more than once."""
    return cut(rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names), label)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept_sha256) for every row of ``docs``; ``key`` is a hash of id and text.

    ``with_text`` adds ``kept_text``, the words left, joined by one space; it is null where nothing was removed.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    parsed = cut(texts.select("doc_id", "key", "text").mapInArrow(
        _parse, "doc_id long, key long, n_words long, digest binary, marks array<long>"), "parsed")
    classes = cut(parsed.where(F.col("n_words") >= WINDOW).groupBy("digest")
                  .agg(F.count("*").alias("copies"), F.min("key").alias("rep")).where("copies > 1"), "classes")
    # of a class one document stands in the search (a repeated row has the key of its first: its marks count twice,
    # which only lets more windows through to the second count, where each key stands once)
    others = cut(parsed.select("key", "digest").join(classes, "digest").where("key <> rep").select(
        F.col("key").alias("other")).distinct(), "others")
    marks = (parsed.where(F.size("marks") > 0).join(small(others), F.col("key") == F.col("other"), "left_anti")
             .select("key", F.explode("marks").alias("mark")))
    known = _repeated(marks, ["mark"], "marks")
    per_doc = cut(marks.join(known, "mark", "left_semi").groupBy("key").agg(F.collect_set("mark").alias("marks")),
                  "per_doc")
    keys = cut(per_doc.select(F.col("key").alias("k")), "keys")
    found = texts.join(small(keys), F.col("key") == F.col("k"), "left_semi").dropDuplicates(["key"]).join(per_doc, "key")
    windows = cut(found.select("key", "text", "marks").mapInArrow(_windows, "key long, start int, h1 long, h2 long"),
                  "windows")
    twice = _repeated(windows, ["h1", "h2"], "twice")
    # the documents of classes lose everything anyway: their windows only count
    alone = windows.join(small(cut(classes.select(F.col("rep").alias("of_class")), "reps")),
                         F.col("key") == F.col("of_class"), "left_anti")
    starts = cut(alone.join(twice, ["h1", "h2"], "left_semi").groupBy("key").agg(F.collect_list("start").alias("starts")),
                 "starts")
    keys = cut(starts.select(F.col("key").alias("k")), "keys")
    fixed = (texts.join(small(keys), F.col("key") == F.col("k"), "left_semi").dropDuplicates(["key"]).join(starts, "key")
             .select("key", "text", "starts")
             .mapInArrow(_remove, "key long, n_removed long, sha string, kept_text string"))
    if not with_text:
        fixed = cut(fixed.drop("kept_text"), "fixed")
    gone = F.col("copies").isNotNull()
    columns = [F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
               F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(
                   F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return (parsed.drop("marks").join(classes.select("digest", "copies"), "digest", "left").join(fixed, "key", "left")
            .select("doc_id", "key", "n_words", *columns))
