"""Conversation structure repair by Four-Russians block tables (operator 12).

A conversation is repaired by the cheapest edits after which its role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole (to
user or assistant) 2, Delete 3, Insert (an empty user or assistant row) 2, and a truncated row that stays 1 more. Blank and
duplicate rows must go. Of equally cheap edits the ASCII-least string of initials (D, I, K, R) is taken.

A row is one of nine symbols (must go; or initial s, u, a, other, truncated or not). What the rest of a conversation costs
from each state of the pattern is a vector of four numbers; less its least entry it is one of a few dozen vectors, found by
search. A table holds, for every such vector after a block of BLOCK symbols, the vector before the block.

1. Rows are dealt in ranges of (conversation, turn) and cut into chunks. A chunk is walked backward a block at a
   lookup, from every vector at once: it becomes a map from vectors to vectors.
2. Chunks of conversations that lie wholly inside a range and one chunk are ready. For the others the maps are chained from
   the end, which gives each chunk the vector behind it; the states through which a chunk leads are chained from the start.
3. Each chunk is traced by itself: blocks are looked up backward, each block is then expanded backward symbol by symbol
   and walked forward, taking the least initial among the cheapest edits.

No task gathers a conversation: chunks are bounded, chains walk one small row for each chunk. Only the digest of a repaired
conversation reads its pieces one after the other, as a digest must, in bounded memory.

Edge cases: a null conv_id is a conversation of its own; null turns come first; null roles and texts read as one space. Rows
with equal turn are ordered by role, a hash of the text, then the text. An initial other than s, u, a (an empty role too) is
never kept. A conversation without rows left has zeros, an empty audit and the digest of the empty string. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.runs import batched, in_order, rows_of, streamed
from workboard.llm.store import cut

BLOCK = 4
#: Bounds of a chunk: rows, and characters of text (one longer text makes a chunk of its own).
CHUNK_ROWS = 2048
CHUNK_CHARS = 1 << 20

# Costs of the edits, the states of the pattern (start, behind s, u, a), the role inserted in a state.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
STATES = 4
ADDED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
INITIALS = "sua"
SYMBOLS = 9  # 0: must go; 1 + 2 * (s, u, a, other) + truncated

_BLANKS = " \t\n\x0b\f\r"


def _close(x: tuple) -> tuple:
    """Costs to go when rows may first be inserted."""
    u, a = min(x[2], x[3] + INSERT), min(x[3], x[2] + INSERT)
    return min(x[0], u + INSERT), min(x[1], u + INSERT), u, a


def _kept(initial: int, state: int) -> int | None:
    """The state after a kept row, or None."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial in (1, 2):
        return AFTER[state] if AFTER[state] == initial + 1 else None
    return None


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of each edit that uses the row up, in ASCII order."""
    yield "D", DELETE, state
    if symbol:
        initial, more = (symbol - 1) // 2, (symbol - 1) % 2 * CUT_OFF
        to = _kept(initial, state)
        if to is not None:
            yield "K", more, to
        yield "R", REROLE + more, AFTER[state]


class Tables:
    """Vectors of costs to go and their transitions over single symbols and blocks."""

    def __init__(self, block: int = BLOCK):
        never = 1 << 20
        end = _close((0, never, never, 0))
        self.block, self.vectors, steps = block, [end], []
        index = {end: 0}
        for v in self.vectors:  # grows while it is searched
            row = []
            for s in range(SYMBOLS):
                raw = _close(tuple(min(c + v[to] for _, c, to in _edits(s, q)) for q in range(STATES)))
                least = min(raw)
                new = tuple(x - least for x in raw)
                if new not in index:
                    index[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append((index[new], least))
            steps.append(row)
        self.step = np.array([[t for t, _ in r] for r in steps], np.uint8)
        self.least = [[c for _, c in r] for r in steps]
        # a block's first symbol is its highest digit and is applied last
        n = len(self.vectors)
        table = np.broadcast_to(np.arange(n, dtype=np.uint8)[:, None], (n, 1))
        for _ in range(block):
            table = self.step[table].transpose(0, 2, 1).reshape(n, -1)
        self.blocks = table
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.choice = [[[self._choose(v, s, q) for q in range(STATES)] for s in range(SYMBOLS)] for v in range(n)]

    def _choose(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """The least edits up to and with the one that uses the symbol up, and the state behind them."""
        v, w, least = self.vectors[after], self.vectors[self.step[after][symbol]], self.least[after][symbol]
        done = ""
        while True:
            ways = {op: (c + v[to] - least, to) for op, c, to in _edits(symbol, state)}
            if ways["D"][0] == w[state]:
                return done + "D", state
            if INSERT + w[AFTER[state]] == w[state]:
                done, state = done + "I", AFTER[state]
                continue
            for op in "KR":
                if op in ways and ways[op][0] == w[state]:
                    return done + op, ways[op][1]
            raise AssertionError("no edit has the cost of the table")

    def codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the whole blocks, symbols behind them)."""
        whole = len(symbols) // self.block * self.block
        return symbols[:whole].reshape(-1, self.block).astype(np.int64) @ self.weights, symbols[whole:]

    def map(self, symbols: np.ndarray) -> np.ndarray:
        """For every vector behind the symbols the vector before them."""
        at = np.arange(len(self.vectors), dtype=np.uint8)
        blocks, rest = self.codes(symbols)
        for s in rest[::-1]:
            at = self.step[at, s]
        for b in blocks[::-1]:
            at = self.blocks[at, b]
        return at

    def trace(self, symbols: np.ndarray, after: int, state: int, last: bool) -> tuple[list[str], int]:
        """The edits up to and with the one that uses each symbol up, as a last entry the rows that a conversation's end
        still needs, and the state behind."""
        blocks, rest = self.codes(symbols)
        at = after
        for s in rest[::-1]:
            at = self.step[at, s]
        behind = []  # the vector behind each block, from the last block to the first
        for b in blocks[::-1]:
            behind.append(int(at))
            at = self.blocks[at, b]
        out = []
        for k, v in enumerate(reversed(behind)):
            state = self._expand(symbols[k * self.block:(k + 1) * self.block], v, state, out)
        state = self._expand(rest, after, state, out)
        tail = ""
        while last and self.vectors[0][state]:
            tail, state = tail + "I", AFTER[state]
        return [*out, tail], state

    def _expand(self, symbols: np.ndarray, after: int, state: int, out: list[str]) -> int:
        """Vectors behind each symbol, backward from ``after``; then the least edits, forward from ``state``."""
        chain = []
        for s in symbols[::-1]:
            chain.append(int(after))
            after = self.step[after, s]
        for s, v in zip(symbols, reversed(chain), strict=True):
            done, state = self.choice[v][s][state]
            out.append(done)
        return state


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with ``blank``, ``cut_off`` and ``again``: whether an equal role and text
    stands at an earlier turn. Equal rows of one turn are told apart later, as neighbours."""
    said = F.rtrim("text", F.lit(_BLANKS))
    rows = rows.withColumns({"blank": said == "", "cut_off": ~F.right(said, F.lit(1)).isin(".", "!", "?"),
                             "h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(1), "text", "role")})
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = (rows.where("not blank and not gone").groupBy("conv_id", "h", "g")
            .agg(F.min(at).alias("first"), F.max(at).alias("final")).where("first < final")
            .select(F.col("conv_id").alias("__c"), F.col("h").alias("__h"), F.col("g").alias("__g"), "first"))
    found = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g")),
                      "left")
    return found.withColumn("again", F.coalesce(F.col("first") < at, F.lit(False))).drop("__c", "__h", "__g", "first", "g")


_CHUNK = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("alone", pa.bool_()),
                    ("symbols", pa.binary()), ("maps", pa.binary()), ("roles", pa.list_(pa.string())),
                    ("texts", pa.list_(pa.string())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                    ("illegal", pa.int64()), ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
                    ("head", pa.string()), ("tail", pa.string())])
CHUNK_DDL = ("conv_id long, part int, no long, alone boolean, symbols binary, maps binary, roles array<string>, texts array<string>, "
             "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, head string, "
             "tail string")
_LEGAL = {"su", "ua", "au"}


class _Chunk:
    """What is known of the rows of a conversation since the last cut."""

    def __init__(self):
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.head = self.tail = None

    def add(self, turn, role, text, blank, cut_off, again):
        initial = role[:1]
        if self.symbols:
            self.illegal += self.tail + initial not in _LEGAL
        else:
            self.head = initial
        self.tail = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut_off and not blank and not again
        if blank or again:
            self.symbols.append(0)
        else:
            of = INITIALS.find(initial) if initial else -1
            self.symbols.append(1 + 2 * (of if of >= 0 else 3) + cut_off)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def row(self, t: Tables, conv, part, no, alone) -> tuple:
        symbols = bytes(self.symbols)
        maps = b"" if alone else t.map(np.frombuffer(symbols, np.uint8)).tobytes()
        return (conv, part, no, alone, symbols, maps, self.roles, self.texts,
                self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_turn, self.last_turn,
                self.head, self.tail)


def _chunk_rows(it: Iterator[pa.RecordBatch], t: Tables) -> Iterator[tuple]:
    chunk, key, before, no, whole, first, part = None, None, None, 0, True, True, None
    names = ["conv_id", "turn", "role", "text", "gone", "blank", "cut_off", "again", "part"]
    for conv, turn, role, text, gone, blank, cut_off, again, part in rows_of(it, names):  # noqa: B007  part is one number
        if chunk is None or conv != key:
            if chunk is not None:
                yield chunk.row(t, key, part, no, whole and not first)
                no, first = no + 1, False
            chunk, key, before, whole = _Chunk(), conv, None, True
        elif len(chunk.symbols) >= CHUNK_ROWS or chunk.chars >= CHUNK_CHARS:
            whole = False
            yield chunk.row(t, key, part, no, False)
            no, chunk = no + 1, _Chunk()
        if not gone:
            me = (turn, role, text)
            chunk.add(turn, role, text, blank, cut_off, again or me == before)
            before = me
    if chunk is not None:
        yield chunk.row(t, key, part, no, False)  # the conversation may go on in the next range


def _chunks(it: Iterator[pa.RecordBatch], t: Tables) -> Iterator[pa.RecordBatch]:
    return batched(_chunk_rows(it, t), _CHUNK, lambda r: 200 + sum(map(len, r[7])))


_EXIT = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("after", pa.int32()), ("last", pa.bool_())])


def _exits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the maps of a conversation's chunks from its end."""
    def walk():
        key, at = object(), 0
        for conv, part, no, maps in rows_of(it, ["conv_id", "part", "no", "maps"]):
            last = conv != key
            if last:
                key, at = conv, 0
            yield part, no, at, last
            at = maps[at]
    return batched(walk(), _EXIT, lambda r: 24)


_LEADS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("after", pa.int32()), ("last", pa.bool_()),
                    ("leads", pa.list_(pa.int32()))])


def _leads(it: Iterator[pa.RecordBatch], t: Tables) -> Iterator[pa.RecordBatch]:
    """For each state before a chunk the state behind it."""
    def walk():
        for conv, part, no, symbols, after, last in rows_of(it, ["conv_id", "part", "no", "symbols", "after", "last"]):
            s = np.frombuffer(symbols, np.uint8)
            yield conv, part, no, after, last, [t.trace(s, after, q, False)[1] for q in range(STATES)]
    return batched(walk(), _LEADS, lambda r: 64)


_ENTRY = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("after", pa.int32()), ("last", pa.bool_()), ("state", pa.int32())])


def _entries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the states through a conversation's chunks from its start."""
    def walk():
        key, state = object(), 0
        for conv, part, no, after, last, leads in rows_of(it, _LEADS.names):
            if conv != key:
                key, state = conv, 0
            yield part, no, after, last, state
            state = leads[state]
    return batched(walk(), _ENTRY, lambda r: 24)


_PIECE = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                    ("audit", pa.string()), ("cost", pa.int64())]
                   + [(n, t) for n, t in zip(_CHUNK.names, _CHUNK.types, strict=True) if n not in
                      ("part", "no", "symbols", "maps", "roles", "texts")])
PIECE_DDL = ("part int, no long, roles array<string>, texts array<string>, audit string, cost long, conv_id long, alone boolean, "
             "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, head string, "
             "tail string")


def _traced(it: Iterator[pa.RecordBatch], t: Tables) -> Iterator[pa.RecordBatch]:
    rest = _PIECE.names[6:]

    def walk():
        for symbols, after, state, last, roles, texts, part, no, *more in rows_of(
                it, ["symbols", "after", "state", "last", "roles", "texts", "part", "no", *rest]):
            s = np.frombuffer(symbols, np.uint8)
            edits, _ = t.trace(s, after, state, last)
            new_roles, new_texts, cost = [], [], 0
            for i, done in enumerate(edits):
                for op in done:
                    if op == "D":
                        cost += DELETE
                        continue
                    if op == "I":
                        cost += INSERT
                        new_roles.append(ADDED[state])
                        new_texts.append("")
                        state = AFTER[state]
                        continue
                    initial, cut_off = divmod(int(s[i]) - 1, 2)
                    cost += cut_off * CUT_OFF + (REROLE if op == "R" else 0)
                    new_roles.append(ADDED[state] if op == "R" else roles[i])
                    new_texts.append(texts[i])
                    state = AFTER[state] if op == "R" else _kept(initial, state)
            yield part, no, new_roles, new_texts, "".join(edits), cost, *more
    return batched(walk(), _PIECE, lambda r: 200 + sum(map(len, r[3])))


_FINAL = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                    ("repaired_sha256", pa.string())])
FINAL_DDL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
             "repaired_sha256 string")


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order; the digest is fed piece by piece."""
    def walk():
        names = ["conv_id", "lines", "audit", "cost", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn",
                 "last_turn", "head", "tail"]
        for conv, pieces in itertools.groupby(rows_of(it, names), key=lambda r: r[0]):
            digest, started, audit, low, high, tail = hashlib.sha256(), False, [], None, None, None
            sums, turns = [0] * 5, 0
            for _, lines, done, *counts, n, first, final, head, end in pieces:
                if lines is not None:
                    digest.update(b"\n" * started + lines.encode())
                    started = True
                audit.append(done)
                sums = [a + b for a, b in zip(sums, counts, strict=True)]
                if n:
                    turns += n - (first == high)
                    low, high = first if low is None else low, final
                if head is not None:
                    sums[4] += tail is not None and tail + head not in _LEGAL
                    tail = end
            cost, blank, duplicate, truncated, illegal = sums
            gaps = high - low + 1 - turns if turns else 0
            yield conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()
    return batched(walk(), _FINAL, lambda r: 100 + len(r[7]))


def _pieces(rows: DataFrame) -> DataFrame:
    """Traced chunks of ``rows`` (conv_id, turn, role, text, gone); ``alone`` marks whole conversations."""
    t = Tables()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc()]
    chunks = cut(in_order(with_faults(rows), order, [F.col("text").asc()]).mapInArrow(partial(_chunks, t=t), CHUNK_DDL), "chunks")
    split = chunks.where("not alone")
    exits = streamed(split.select("conv_id", "part", "no", "maps"), ["conv_id"], [F.desc("part"), F.desc("no")], _exits,
                     "part int, no long, after int, last boolean")
    leads = (split.select("conv_id", "part", "no", "symbols").join(exits, ["part", "no"])
             .mapInArrow(partial(_leads, t=t), "conv_id long, part int, no long, after int, last boolean, leads array<int>"))
    known = cut(streamed(leads, ["conv_id"], [F.asc("part"), F.asc("no")], _entries,
                         "part int, no long, after int, last boolean, state int"), "entries")
    whole = chunks.where("alone").withColumns({"after": F.lit(0), "last": F.lit(True), "state": F.lit(0)})
    return whole.unionByName(split.join(known, ["part", "no"])).mapInArrow(partial(_traced, t=t), PIECE_DDL)


def _rows(conversations: DataFrame, gone: Column | None, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"))


def repair(conversations: DataFrame, gone: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows that ``gone`` marks are not there, but their conversation is still returned.
    """
    rows = _rows(conversations, gone, id_col, turn_col, role_col, text_col)
    lines = F.when(F.size("roles") > 0, F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n"))
    pieces = cut(_pieces(rows).withColumn("lines", lines).drop("roles", "texts"), "pieces")
    alone = pieces.where("alone").select(
        "conv_id", F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))
    others = streamed(pieces.where("not alone"), ["conv_id"], [F.asc("part"), F.asc("no")], _joined, FINAL_DDL)
    return alone.unionByName(others)


def repaired(conversations: DataFrame, gone: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, no, pos, role, text): the rows of the repaired conversations; (part, no, pos) is their order."""
    pieces = _pieces(_rows(conversations, gone, id_col, turn_col, role_col, text_col))
    return (pieces.select("conv_id", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "row"))
            .select("conv_id", "part", "no", "pos", F.col("row.roles").alias("role"), F.col("row.texts").alias("text")))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with the faults that the hash of ``conv_id:turn`` deals: dropped rows are
    marked ``gone``, repeated ones come twice."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), text.alias("text"), kind.alias("kind"))
    harmed = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return harmed.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")
