"""Repair of damaged conversations: the cheapest edits that give a well-formed sequence of roles.

A row is one of few symbols: whose turn it is (system, user, assistant, other) and whether it is whole, truncated
or has to go. Each symbol is a min-plus transfer matrix between the four places a well-formed sequence
can stand at: nothing yet, behind the system row, behind a user row, behind an assistant row. The symbol sequences of
many conversations are compressed together by pairing; each rule's matrix is the product of
two earlier ones, with its edits as ropes, so what conversations share is worked out once.

Rows travel without their texts: sorted by (conversation, turn) and cut into ranges, so a conversation of any
length is spread over tasks, each of which folds its part to one matrix; parts of a conversation that
crosses ranges are multiplied in order. Texts are read once more for the digest of the repaired
conversation, streamed in order beside its edits; a digest over one text is one stream by its nature, so there, and only there, a
conversation passes through one task, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import settled
from turnlake.llm.grammar import Cell, better, folded, paired, product

SPACES = " \t\n\x0b\f\r"
SYSTEM, USER, ASSISTANT, OTHER = range(4)
WHOLE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, TRUNCATION = 2, 5, 5
#: Symbol of a row that has to go; others are 2 * who + truncated.
GONE = 8
#: Rows of a task whose symbols are compressed together.
BLOCK_ROWS = 100_000
#: Rows a range holds, about.
RANGE_ROWS = 1_000_000
LARGEST = 2 ** 63 - 1

# Places in a well-formed sequence.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
NEXT_USER, NEXT_ASSISTANT = {START, AFTER_SYSTEM, AFTER_ASSISTANT}, {AFTER_USER}


def _matrix(cells: dict[tuple[int, int], Cell]) -> list[list[Cell]]:
    return [[cells.get((i, j)) for j in range(4)] for i in range(4)]


#: Rows put in between: none, one, or a whole exchange.
INSERTS = _matrix({(i, i): (0, "") for i in range(4)} | {
    (START, AFTER_USER): (INSERT, "I"), (AFTER_SYSTEM, AFTER_USER): (INSERT, "I"), (AFTER_ASSISTANT, AFTER_USER): (INSERT, "I"),
    (AFTER_USER, AFTER_ASSISTANT): (INSERT, "I"), (START, AFTER_ASSISTANT): (2 * INSERT, "II"), (AFTER_SYSTEM, AFTER_ASSISTANT): (2 * INSERT, "II")})


def _symbol(symbol: int) -> list[list[Cell]]:
    """What may happen to one row, with what is put in front of it."""
    cells: dict[tuple[int, int], Cell] = {(i, i): (DELETE, "D") for i in range(4)}
    if symbol != GONE:
        who, truncated = divmod(symbol, 2)
        extra = TRUNCATION * truncated

        def allow(origin: int, to: int, cost: int, letter: str) -> None:
            cells[origin, to] = better(cells.get((origin, to)), (cost + extra, letter))

        for origin in NEXT_USER:
            allow(origin, AFTER_USER, 1, "R")
        for origin in NEXT_ASSISTANT:
            allow(origin, AFTER_ASSISTANT, 1, "R")
        if who == SYSTEM:
            allow(START, AFTER_SYSTEM, 0, "K")
        elif who == USER:
            for origin in NEXT_USER:
                allow(origin, AFTER_USER, 0, "K")
        elif who == ASSISTANT:
            for origin in NEXT_ASSISTANT:
                allow(origin, AFTER_ASSISTANT, 0, "K")
    return product(INSERTS, _matrix(cells))


SYMBOLS = [_symbol(s) for s in range(GONE + 1)]


def finished(matrix: list[list[Cell]]) -> tuple[int, str]:
    """Cost and edits of a whole conversation: from nothing to nothing or to an assistant row."""
    row = product(matrix[:1], INSERTS)[0]
    cost, edits = better(row[START], row[AFTER_ASSISTANT])
    return cost, str(edits)


def transfers(sequences: list[bytes]) -> list[list[list[Cell]]]:
    """The matrix of each sequence of symbols; equal sequences and repeated pairs are worked out once."""
    distinct = list(dict.fromkeys(sequences))
    rules, compressed = paired(distinct, len(SYMBOLS))
    made = list(SYMBOLS)
    for left, right in rules:
        made.append(product(made[left], made[right]))
    of = {s: folded([made[x] for x in c]) for s, c in zip(distinct, compressed)}
    return [of[s] for s in sequences]


@dataclass
class Part:
    """Consecutive rows of a conversation: its matrix, counts, and what its neighbours need to know."""

    matrix: list[list[Cell]]
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int
    first_turn: int | None
    last_turn: int | None
    first_who: int
    last_who: int

    def then(self, other: "Part") -> "Part":
        met = self.last_turn is not None and self.last_turn == other.first_turn
        return Part(product(self.matrix, other.matrix), self.blank + other.blank, self.duplicate + other.duplicate,
                    self.truncated + other.truncated, self.illegal + other.illegal + (not legal(self.last_who, other.first_who)),
                    self.turns + other.turns - met, other.first_turn if self.first_turn is None else self.first_turn,
                    self.last_turn if other.last_turn is None else other.last_turn, self.first_who, other.last_who)

    def result(self) -> dict:
        cost, audit = finished(self.matrix)
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, LARGEST)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost, "audit": audit}


def legal(a: int, b: int) -> bool:
    return (a, b) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


_LEGAL = np.array([[legal(a, b) for b in range(4)] for a in range(4)])
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PART = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_who int, last_who int"
_RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_PART_NAMES = [c.split()[0] for c in PART.split(", ")]


def _parts(who: np.ndarray, fault: np.ndarray, turn: np.ndarray, known: np.ndarray, starts: np.ndarray) -> list[Part]:
    """One part for each run of rows; ``starts``: the first row of each run."""
    n = len(who)
    ends = np.append(starts[1:], n)
    symbol = np.where((fault == BLANK) | (fault == DUPLICATE), GONE, 2 * who + (fault == TRUNCATED)).astype(np.uint8).tobytes()
    inside = np.ones(n, bool)
    inside[starts] = False
    before = np.maximum(np.arange(n) - 1, 0)
    broken = inside & ~_LEGAL[who[before], who]
    new_turn = known & ~(inside & known[before] & (turn[before] == turn))
    count = lambda x: np.add.reduceat(x.astype(np.int64), starts).tolist()
    columns = [count(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED)] + [count(broken), count(new_turn)]
    has = np.add.reduceat(known.astype(np.int64), starts)
    # Unknown turns come first.
    first, last = (np.minimum(ends - has, n - 1)), ends - 1
    matrices = transfers([symbol[a:b] for a, b in zip(starts, ends)])
    return [Part(m, *values, int(turn[f]) if h else None, int(turn[e]) if h else None, int(who[a]), int(who[e]))
            for m, *values, h, f, e, a in zip(matrices, *columns, has, first, last, starts)]


def _changes(ids: pa.Array) -> np.ndarray:
    """Rows whose id differs from the row before; the first row always does. Null is an id."""
    out = np.ones(len(ids), bool)
    if len(ids) > 1:
        a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] = differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _folding(kind: pa.DataType):
    """Sorted rows of a range to results of conversations inside it, and to parts of those at its ends."""
    def rows_of(entries: list[tuple], place: int) -> pa.RecordBatch:
        """entries: (id, part, whether it lies at an end)."""
        columns: dict[str, list] = {name: [] for name in ("conv_id", "place", *dict.fromkeys(_RESULT_NAMES + _PART_NAMES), "costs", "edits")}
        for key, part, at_end in entries:
            columns["conv_id"].append(key)
            columns["place"].append(place if at_end else None)
            values = {n: getattr(part, n) for n in _PART_NAMES} if at_end else part.result()
            for name in dict.fromkeys(_RESULT_NAMES + _PART_NAMES):
                columns[name].append(values.get(name))
            cells = [c for row in part.matrix for c in row] if at_end else None
            columns["costs"].append(cells and [c and c[0] for c in cells])
            columns["edits"].append(cells and [c and str(c[1]) for c in cells])
        types = [kind, pa.int64(), *[pa.string() if n == "audit" else pa.int32() if n.endswith("who") else pa.int64()
                                     for n in dict.fromkeys(_RESULT_NAMES + _PART_NAMES)], pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types)], list(columns))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        open_key, open_part, first = None, None, True
        for block in _blocks(batches):
            times = block.column("n").to_numpy()
            known = block.column("known").to_numpy(zero_copy_only=False).astype(bool)
            turn = pc.fill_null(block.column("turn"), 0).to_numpy()
            who, fault = block.column("who").to_numpy().astype(np.int64), block.column("fault").to_numpy().astype(np.int64)
            ids = block.column("conv_id").combine_chunks()
            run = np.nonzero(_changes(ids))[0]
            keys = ids.take(pa.array(run)).to_pylist()
            # Equal rows of a turn: the first one stands, unless the text was seen in an earlier turn.
            at = np.repeat(np.arange(len(times)), times)
            begin = np.cumsum(times) - times
            fault = fault[at]
            repeat = np.ones(len(at), bool)
            stands = block.column("stands").to_numpy(zero_copy_only=False).astype(bool)
            repeat[begin[stands]] = False
            fault[repeat & (fault != BLANK)] = DUPLICATE
            made = list(zip(keys, _parts(who[at], fault, turn[at], known[at], begin[run])))
            out = []
            if open_part is not None:
                if keys[0] == open_key:
                    made[0] = (open_key, open_part.then(made[0][1]))
                else:
                    out.append((open_key, open_part, first))
                    first = False
            for key, part in made[:-1]:
                out.append((key, part, first))
                first = False
            open_key, open_part = made[-1]
            if out:
                yield rows_of(out, place)
        if open_part is not None:
            yield rows_of([(open_key, open_part, True)], place)

    return fold


def _multiplied(kind: pa.DataType):
    """Parts of one conversation, from all the ranges it crosses, to its result."""
    def multiply(table: pa.Table) -> pa.Table:
        total = None
        for row in sorted(table.to_pylist(), key=lambda r: r["place"]):
            cells = [None if c is None else (c, e) for c, e in zip(row["costs"], row["edits"])]
            part = Part([cells[i:i + 4] for i in range(0, 16, 4)], *[row[n] for n in _PART_NAMES])
            total = part if total is None else total.then(part)
        values = total.result()
        names = ["conv_id", *_RESULT_NAMES]
        types = [kind] + [pa.string() if n == "audit" else pa.int64() for n in _RESULT_NAMES]
        return pa.table([pa.array([v], t) for v, t in zip([table.column("conv_id")[0].as_py(), *[values[n] for n in _RESULT_NAMES]], types)], names=names)

    return multiply


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows with the contract's damage. Null ids and turns are one space in
    the key, null roles and texts are one space. Dropped rows stay as marks without text."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    return conversations.select("conv_id", "turn", "role", "text", kind.alias("_kind")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("_kind") == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
        (F.col("_kind") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _same(role: str = "role", text: str = "text") -> Column:
    """Digest of role and text together."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256))


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation with rows.

    ``rows`` has conv_id, turn, role and text without nulls in the last two.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    who = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(body == "", BLANK).when(F.substring(body, -1, 1).isin(".", "!", "?"), WHOLE).otherwise(TRUNCATED)
    light = rows.select("conv_id", F.col("turn").isNotNull().alias("known"), "turn", _same().alias("same"),
                        who.cast("byte").alias("who"), fault.cast("byte").alias("fault"))
    # Where a text is met first in its conversation, and how many equal rows a turn has: two sums, no join.
    counted = light.groupBy("conv_id", "known", "turn", "same", "who", "fault").agg(F.count(F.lit(1)).alias("n"))
    first = light.groupBy("conv_id", "same", "who", "fault").agg(F.min(F.struct("known", "turn")).alias("at")).select(
        "conv_id", "at.known", "at.turn", "same", "who", "fault", F.lit(0).cast("long").alias("n"), F.lit(True).alias("stands"))
    turns = settled(counted.withColumn("stands", F.lit(False)).unionByName(first).groupBy(
        "conv_id", "known", "turn", "same", "who", "fault").agg(F.sum("n").alias("n"), F.max("stands").alias("stands")), "turns")
    spark = turns.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // RANGE_ROWS))
    order = ["conv_id", "known", "turn", "same"]
    kind = turns.schema["conv_id"].dataType
    arrow = _arrow_type(turns)
    schema = f"conv_id {kind.simpleString()}, place long, {RESULT}, turns long, first_turn long, last_turn long, first_who int, last_who int, costs array<long>, edits array<string>"
    folds = settled(turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_folding(arrow), schema), "folds")
    inside = folds.filter("place is null").select("conv_id", *_RESULT_NAMES)
    ends = folds.filter("place is not null").select("conv_id", "place", *_PART_NAMES, "costs", "edits")
    crossing = ends.groupBy("conv_id").applyInArrow(_multiplied(arrow), f"conv_id {kind.simpleString()}, {RESULT}")
    return inside.unionByName(crossing)


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema["conv_id"].dataType)


class Written:
    """The repaired rows of one conversation, written on end into a digest as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.digest, self.rows = audit, 0, START, hashlib.sha256(), 0

    def _add(self, role: str, text: str) -> None:
        self.digest.update((f"\n{role}:{text}" if self.rows else f"{role}:{text}").encode())
        self.rows += 1

    def _next(self, text: str) -> None:
        """A row that takes the role due."""
        user = self.place in NEXT_USER
        self.place = AFTER_USER if user else AFTER_ASSISTANT
        self._add("user" if user else "assistant", text)

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._next("")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.place = {"s": AFTER_SYSTEM, "u": AFTER_USER, "a": AFTER_ASSISTANT}[role[0]]
            self._add(role, text)
        elif letter == "R":
            self._next(text)

    def end(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def _writing(kind: pa.DataType):
    """Results and rows of conversations, sorted with the result first, to one row each."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *_RESULT_NAMES, "repaired_sha256"]
        types = [kind] + [pa.string() if n == "audit" else pa.int64() for n in _RESULT_NAMES] + [pa.string()]
        columns: list[list] = [[] for _ in names]
        key, values, written = None, None, None

        def close() -> None:
            for column, value in zip(columns, (key, *values, written.end())):
                column.append(value)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_pylist()
            results = batch.column("result").to_pylist()
            rows = zip(ids, results, batch.column("role").to_pylist(), batch.column("text").to_pylist(), batch.column("dropped").to_pylist())
            for new, result, role, text, dropped in rows:
                if values is None or new != key:
                    if values is not None:
                        close()
                    key = new
                    # A conversation without rows left has marks of dropped rows only.
                    values = tuple(result.values()) if result is not None else (0, 0, 0, 0, 0, 0, "")
                    written = Written(values[-1])
                if result is None and not dropped:
                    written.row(role, text)
            if len(columns[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)
                columns = [[] for _ in names]
        if values is not None:
            close()
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)

    return write


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    ``rows`` has conv_id, turn, role, text (neither null) and dropped; those with ``dropped`` only say that a conversation
    exists. A conversation is its rows by turn, unknown turns first; different rows of one turn
    stand in the order of a digest of role and text. Each row's first fault counts: blank, duplicate (role and text stood
    in it before), truncated. An id that is null is a conversation like others. A role that begins with none of s, u and a,
    or is empty, can't be kept. Edits of least cost are taken, of equals the first in ASCII order. Very long texts and
    conversations are streamed, an empty table gives an empty one.
    """
    result = F.struct(*_RESULT_NAMES)
    found = edits(rows.filter("not dropped").select("conv_id", "turn", "role", "text"))
    empty = lambda kind: F.lit(None).cast(kind)
    with_results = found.select("conv_id", F.lit(0).alias("part"), empty("boolean").alias("known"), empty("long").alias("turn"), empty("binary").alias("same"),
                                empty("string").alias("role"), empty("string").alias("text"), F.lit(False).alias("dropped"), result.alias("result"))
    texts = rows.select("conv_id", F.lit(1).alias("part"), F.col("turn").isNotNull().alias("known"), "turn", _same().alias("same"), "role", "text", "dropped",
                        F.lit(None).cast(with_results.schema["result"].dataType).alias("result"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return with_results.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", "known", "turn", "same").select(
        "conv_id", "role", "text", "dropped", "result").mapInArrow(_writing(_arrow_type(rows)), f"conv_id {kind}, {RESULT}, repaired_sha256 string")


REPAIR_SQL = r"""with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as codes from conversations),
kinds as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from keyed, crc),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, range(2) as copies(copy) where kind <> 0 and (copy = 0 or kind = 3)),
tied as (select *, length(role)::varchar || ':' || role || text as both_texts, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
    case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as who from damaged),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(both_texts)) as ix from tied),
repeated as (select *, row_number() over (partition by conv_id, both_texts order by ix) > 1 as again from numbered),
turns as (select *, case when body = '' then 'blank' when again then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else 'whole' end as fault,
    lag(who) over (partition by conv_id order by ix) || who as meeting from repeated),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (meeting is not null and meeting not in ('su', 'ua', 'au')) as illegal, count(*) as n from turns group by conv_id),
places as (select unnest([0, 1, 2, 3]) as place),
-- Rows put in between: from a place to a place.
inserts(origin, place, cost, letters) as (select place, place, 0, '' from places
  union all (values (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I'))),
-- What happens to a row: only K asks whose row it is; D is open to all rows.
edits(origin, place, who, cost, letter) as (select place, place, null::varchar, 2, 'D' from places
  union all (values (0, 1, 's', 0, 'K'), (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (3, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K'),
    (0, 2, null, 1, 'R'), (1, 2, null, 1, 'R'), (3, 2, null, 1, 'R'), (2, 3, null, 1, 'R'))),
steps as (select i.origin, e.place, e.who, i.cost + e.cost as cost, i.letters || e.letter as letters, e.letter from inserts i join edits e on i.place = e.origin),
walk(conv_id, ix, place, cost, letters) as (select conv_id, 0::bigint, 0, 0::bigint, '' from counts
  union all
  select w.conv_id, t.ix, s.place, w.cost + s.cost + case when t.fault = 'truncated' and s.letter <> 'D' then 5 else 0 end, w.letters || s.letters
  from walk w join turns t on t.conv_id is not distinct from w.conv_id and t.ix = w.ix + 1 join steps s on s.origin = w.place
    and (s.letter = 'D' or t.fault in ('whole', 'truncated')) and (s.who is null or s.who = t.who)
  qualify row_number() over (partition by w.conv_id, s.place order by
    w.cost + s.cost + case when t.fault = 'truncated' and s.letter <> 'D' then 5 else 0 end, w.letters || s.letters) = 1),
ended as (select w.conv_id, w.cost + i.cost as cost, w.letters || i.letters as audit from walk w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.ix
    join inserts i on i.origin = w.place and i.place in (0, 3)
  qualify row_number() over (partition by w.conv_id order by w.cost + i.cost, w.letters || i.letters) = 1),
-- The letters again, each with the row it stands for and its place among the rows that stay.
letters as (select conv_id, audit, unnest(string_split(audit, '')) as letter, unnest(range(1, length(audit) + 1)) as pos from ended where audit <> ''),
placed as (select *, sum(case when letter = 'I' then 0 else 1 end) over (partition by conv_id order by pos) as ix,
    sum(case when letter = 'D' then 0 else 1 end) over (partition by conv_id order by pos) as nth from letters),
staying as (select p.conv_id, p.nth, p.letter, case when letter = 'I' then null else t.role end as role, case when letter = 'I' then '' else t.text end as text,
    count(*) over (partition by p.conv_id) % 2 as odd
  from placed p left join turns t on t.conv_id is not distinct from p.conv_id and t.ix = p.ix where letter <> 'D'),
written as (select conv_id, string_agg(case when letter = 'K' then role when (nth + odd) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by nth) as whole
  from staying group by conv_id)
select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
  sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) d left join counts c on c.conv_id is not distinct from d.conv_id
  left join ended e on e.conv_id is not distinct from d.conv_id left join written w on w.conv_id is not distinct from d.conv_id"""
