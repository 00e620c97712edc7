"""Variable-capacity best-fit packing of documents into training sequences (operator 2).

Several sequence lengths are permitted at once. Pieces (documents, and the parts of documents longer than the largest
length) are dealt by a hash into shards of about ``SHARD_PIECES`` pieces; within a shard they are placed in order of
falling length into the open sequence with the least room that still takes them. If none does, a new sequence of the
permitted length with the least expected cost is opened: what the sequence costs (its length, a fixed overhead, and
attention, which grows with the square of the length), divided by the tokens it can be expected to hold, which is the
piece and whatever smaller pieces are still to come. At the end every sequence is
shrunk to the smallest permitted length that holds its contents. Shards are statistically alike and large against the
number of pieces in a sequence, so sharding costs at most one badly filled sequence per length and shard.

Every token of every document is placed exactly once: nothing is cut off or dropped. A hash deals the pieces, so one
source or one length with a third of all rows spreads evenly, and no task gets more than a shard.

Edge cases: null, empty and blank texts have no tokens, need no place and give one row with null placement. A null id
is packed like any other. Repeated rows are separate documents, each placed once. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.store import cut

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence besides its length, in tokens.
OVERHEAD = 16
#: Length at which attention costs as much as everything else.
ATTENTION = 32_768
SHARD_PIECES = 4_000

_PLACED = "doc_id long, piece long, start long, n_tokens long, shard int, bin int, capacity int, offset int"


def word_count(text: Column) -> Column:
    """Tokens of a text: words separated by ASCII white space, and one end mark for a text that has any."""
    n = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return F.coalesce(F.when(n > 0, n + 1), F.lit(0).cast("long"))


def pack(sizes: np.ndarray, lengths: tuple, overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of ``sizes``, which fall: (bin of each piece, offset of each piece, final length of each bin).

    All sizes are between 1 and the largest length.
    """
    lengths = sorted(lengths)
    later = np.concatenate([np.cumsum(sizes[::-1])[::-1][1:], [0]]) if len(sizes) else sizes  # tokens after each
    falling = -np.asarray(sizes)
    total_later = np.concatenate([np.cumsum(sizes), [0]]) if len(sizes) else sizes
    rooms: list[int] = []               # distinct rooms of open bins, rising
    open_at: dict[int, list[int]] = {}  # room -> bins
    used: list[int] = []
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)

    def expected_cost(length: int, i: int, size: int) -> float:
        room = length - size
        # pieces after i no larger than the room; sizes fall, so they are a tail
        j = max(i + 1, int(np.searchsorted(falling, -room, side="left")))
        rest = int(later[i] - (total_later[j - 1] - total_later[i])) if j < len(sizes) else 0
        return (overhead + length + length * length / ATTENTION) / (size + min(room, rest))

    for i, size in enumerate(int(s) for s in sizes):
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            bins = open_at[room]
            b = bins.pop()
            if not bins:
                del open_at[room], rooms[k]
        else:
            fitting = [n for n in lengths if n >= size]
            length = min(fitting, key=lambda n: (expected_cost(n, i, size), n))  # noqa: B023
            b, room = len(used), length
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += size
        if room > size:
            if room - size not in open_at:
                open_at[room - size] = []
                bisect.insort(rooms, room - size)
            open_at[room - size].append(b)
    final = np.array([lengths[bisect.bisect_left(lengths, u)] for u in used], dtype=np.int64)
    return where, offset, final


def _pack_shard(t: pa.Table, lengths: tuple, overhead: int) -> pa.Table:
    t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    where, offset, final = pack(t["n_tokens"].to_numpy(), lengths, overhead)
    return pa.table({"doc_id": t["doc_id"], "piece": t["piece"], "start": t["start"], "n_tokens": t["n_tokens"],
                     "shard": t["shard"], "bin": pa.array(where, pa.int32()),
                     "capacity": pa.array(final[where] if len(where) else where, pa.int32()),
                     "offset": pa.array(offset, pa.int32())})


def best_fit(docs: DataFrame, lengths: tuple = LENGTHS, overhead: int = OVERHEAD, id_col: str = "doc_id",
             tokens: Column | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece of each document: (doc_id, piece, start, n_tokens, shard, bin, capacity, offset).

    ``tokens`` counts a document's tokens (default: words of ``text`` and an end mark). ``start`` is the piece's first
    token in its document, ``offset`` its first token in sequence (``shard``, ``bin``) of length ``capacity``.
    """
    if not lengths or min(lengths) < 1:
        raise ValueError("lengths must be positive")
    most = max(lengths)
    n = word_count(F.col("text")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n")), "sized")
    last = F.greatest(F.ceil(F.col("n") / most).cast("long") - 1, F.lit(0).cast("long"))
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * most).alias("start"),
        F.least(F.col("n") - F.col("piece") * most, F.lit(most).cast("long")).alias("n_tokens"))
    count = sized.agg(F.sum(last + 1)).first()[0] or 0
    shards = max(1, -(-count // shard_pieces))
    # rows that repeat an id and a piece would share a hash: the position in the scan spreads them
    deal = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    dealt = cut(pieces.withColumn("shard", deal), "dealt")

    def pack_shard(t: pa.Table) -> pa.Table:
        return _pack_shard(t, tuple(lengths), overhead)

    placed = dealt.where("n_tokens > 0").groupBy("shard").applyInArrow(pack_shard, _PLACED)
    unplaced = dealt.where("n_tokens <= 0").select(
        "doc_id", "piece", "start", "n_tokens", *[F.lit(None).cast("int").alias(c)
                                                  for c in ("shard", "bin", "capacity", "offset")])
    return placed.unionByName(unplaced)
