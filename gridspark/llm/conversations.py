"""Conversation structure repair: cheapest edits that give ``(s?(ua)+)?``, by a checkpointed dynamic programme.

A conversation is its rows in the order of their turns.  Keeping a row costs nothing, giving it
the role user or assistant 2, inserting an empty row of either role 2, deleting a row 3; a
truncated row that stays costs 1 more; blank and repeated rows have to go.  Four states tell
what may follow: nothing yet, a system row, a user row, a whole pair.

One conversation may hold a large part of all rows, so rows are first written in order and cut
into chunks (``common.ordered``).  A piece is what a chunk holds of one conversation:

1. Pieces that may go on in the next chunk (the last and first of each) give their four by four
   matrix of costs, a min-plus product over their rows.
2. Along each conversation these matrices, from the end, give the cost vector behind each piece.
3. Each such piece tells the state that it is left in for each state that it is entered in,
   and along each conversation these give the state that each piece is entered in.
4. Each piece is walked forwards.  Cost vectors are kept only at every square root of its rows;
   a block's own are computed again when the walk comes to it.  Of the edits that keep the
   least cost, the one first in ASCII is taken.
5. Rows and edits meet again by conversation and are read once in order.  A conversation's hash
   and its string of edits are sequential, so this pass is one task's for each conversation; it
   holds one batch of rows and the letters.

Defined results: a null role or text counts as one space.  Rows of null turn come first, ties
go by role and then by digest of the text.  Rows of null ``conv_id`` are one conversation.
Repeated rows count as duplicates.  Very long texts only pass through.  Further columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridspark.llm.common import ordered, query, settle, table

CHUNK_ROWS = 1 << 15
DELETE, INSERT, RELABEL, CUT_OFF = 3, 2, 2, 1
FAR = 1 << 40  #: a cost that no edits reach
START, SYSTEM, USER, PAIR = range(4)
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIR}, PAIR: {"u": USER}}
NEXT = (USER, USER, PAIR, USER)  #: the state after an inserted or relabelled row
CLOSED = (0, FAR, FAR, 0)  #: what is left to pay at the end, before inserts
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
KEPT, TRUNCATED, GONE = range(3)  #: what the dynamic programme needs to know of a row's fault
BLANKS = " \t\n\x0b\x0c\r"


def _settled(cost: list[int]) -> tuple[int, ...]:
    """Costs once rows may still be inserted here."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


def _based(cost) -> tuple[int, tuple[int, ...]]:
    low = min(cost)
    return low, tuple(min(c - low, FAR) for c in cost)


@lru_cache(maxsize=1 << 14)
def _before(initial: str, fault: int, behind: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The cost vector before a row from that behind it, as its least value and the rest."""
    out = []
    for q in range(4):
        best = DELETE + behind[q]
        if fault != GONE:
            extra = CUT_OFF * (fault == TRUNCATED)
            best = min(best, RELABEL + extra + behind[NEXT[q]])
            if initial in AFTER[q]:
                best = min(best, extra + behind[AFTER[q][initial]])
        out.append(min(best, FAR))
    return _based(_settled(out))


@lru_cache(maxsize=1 << 14)
def _edits(q: int, initial: str, fault: int, behind: tuple[int, ...]) -> tuple[str, int]:
    """The letters for one row, inserts before it included, and the state after it."""
    letters = ""
    while True:
        extra = CUT_OFF * (fault == TRUNCATED)
        here = [DELETE + behind[q], FAR, FAR]
        if fault != GONE:
            if initial in AFTER[q]:
                here[1] = extra + behind[AFTER[q][initial]]
            here[2] = RELABEL + extra + behind[NEXT[q]]
        low, rest = _before(initial, fault, behind)
        now = low + rest[q]
        if here[0] == now:
            return letters + "D", q
        if INSERT + low + rest[NEXT[q]] == now:
            letters, q = letters + "I", NEXT[q]
        elif here[1] == now:
            return letters + "K", AFTER[q][initial]
        else:
            return letters + "R", NEXT[q]


def closing(q: int) -> str:
    """Inserts after the last row."""
    letters = ""
    while CLOSED[q]:
        letters, q = letters + "I", NEXT[q]
    return letters


END_VECTOR = _based(_settled(list(CLOSED)))[1]


def walk(initials: list[str], faults: list[int], behind: tuple[int, ...], q: int) -> tuple[list[str], int]:
    """Letters of every row and the state at the end, for a piece entered in ``q`` with costs ``behind`` it."""
    n = len(initials)
    step = isqrt(n) + 1
    marks, vector = {}, behind
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            marks[i // step] = vector  # behind the block's last row
        vector = _before(initials[i], faults[i], vector)[1]
    letters = []
    for block in range(-(-n // step)):
        low, high = block * step, min((block + 1) * step, n)
        vectors = [marks[block]]
        for i in range(high - 1, low, -1):
            vectors.append(_before(initials[i], faults[i], vectors[-1])[1])
        for i in range(low, high):
            found, q = _edits(q, initials[i], faults[i], vectors[high - 1 - i])
            letters.append(found)
    return letters, q


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), FAR)


@lru_cache(maxsize=64)
def _matrix(initial: str, fault: int) -> tuple[tuple[int, ...], ...]:
    """Least cost from each state before a row to each state behind it."""
    columns = []
    for target in range(4):
        low, rest = _before(initial, fault, tuple(0 if q == target else FAR for q in range(4)))
        columns.append([min(low + r, FAR) for r in rest])
    return tuple(zip(*columns))


def costs(initials: list[str], faults: list[int]) -> np.ndarray:
    """The matrix of a whole piece."""
    steps = np.array([_matrix(a, f) for a, f in zip(initials, faults)], dtype=np.int64)
    while len(steps) > 1:
        if len(steps) % 2:
            steps = np.concatenate([steps[:-2], _product(steps[-2:-1], steps[-1:])])
            continue
        steps = _product(steps[::2], steps[1::2])
    return steps[0]


def rows_in_order(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``conv_id, turn, role, text, initial, fault, ord, chunk`` in order; ``fault``: blank, duplicate, truncated or none."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("*", F.substring("role", 1, 1).alias("initial"), tail.alias("tail"), F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("digest"))
    rows = rows.select("conv_id", "turn", "role", "text", "initial", "digest", F.when(F.col("tail") == "", "blank").when(~F.substring("tail", -1, 1).isin(".", "!", "?"), "truncated").alias("fault"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    return ordered(rows, keys, chunk_rows, "conversation-rows")


def _marked(rows: DataFrame) -> DataFrame:
    """The rows without texts, repeats marked: a row is the first with its digest, or a duplicate."""
    light = rows.select("conv_id", "ord", "chunk", "initial", "fault", "digest")
    first = light.groupBy("conv_id", "digest").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("fault"))
    return settle(light.join(first, "ord", "left").select("conv_id", "ord", "chunk", "initial", fault.alias("fault")), "conversation-faults")


def _pieces(part: pa.Table) -> list[tuple]:
    """(conversation, initials, faults) of a chunk's pieces; its rows are sorted."""
    conv, initial, fault = (part[c].to_pylist() for c in ("conv_id", "initial", "fault"))
    initial = [a if a in "sua" else "" for a in initial]
    fault = [KEPT if f is None else TRUNCATED if f == "truncated" else GONE for f in fault]
    edge = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]]
    return [(conv[a], initial[a:b], fault[a:b]) for a, b in zip(edge, [*edge[1:], len(conv)])]


def _open_pieces(part: pa.Table) -> list[tuple]:
    """The pieces that may go on beyond the chunk."""
    found = _pieces(part.sort_by("ord"))
    return found if len(found) < 3 else [found[0], found[-1]]


def _table(schema: T.StructType, rows: list[tuple], conv: pa.DataType) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(schema)
    kinds = [conv, *(_ARROW[f.dataType.simpleString()] for f in schema.fields[1:])]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def edits(rows: DataFrame) -> DataFrame:
    """``conv_id, ord, fault, letters`` of every row of ``rows_in_order``; inserts behind the last row are not among them."""
    marked = _marked(rows)
    key = marked.schema["conv_id"]
    shape = lambda text: T.StructType([key, *T._parse_datatype_string(text).fields])

    cost_shape = shape("chunk long, cost array<long>")

    def cost_of(part: pa.Table) -> pa.Table:
        chunk = part["chunk"][0].as_py()
        return _table(cost_shape, [(conv, chunk, costs(*piece).ravel().tolist()) for conv, *piece in _open_pieces(part)], part["conv_id"].type)

    open_costs = settle(marked.groupBy("chunk").applyInArrow(cost_of, cost_shape), "conversation-costs")
    along = lambda df, order: df.repartition("conv_id").sortWithinPartitions("conv_id", order)

    vector_shape = shape("chunk long, behind array<long>")

    def vectors(batches):  # from each conversation's last piece to its first
        last, vector = (), END_VECTOR
        for batch in batches:
            out = []
            for conv, chunk, cost in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != last:
                    last, vector = (conv,), END_VECTOR
                out.append((conv, chunk, list(vector)))
                vector = _based([min(map(sum, zip(cost[4 * q : 4 * q + 4], vector))) for q in range(4)])[1]
            yield from _table(vector_shape, out, batch.column(0).type).to_batches()

    behind = settle(along(open_costs, F.desc("chunk")).mapInArrow(vectors, vector_shape), "conversation-vectors")

    leave_shape = shape("chunk long, leaves array<long>")

    def leaves_of(part: pa.Table, given: pa.Table) -> pa.Table:
        known = dict(zip(given["conv_id"].to_pylist(), map(tuple, given["behind"].to_pylist())))
        chunk = given["chunk"][0].as_py()
        return _table(leave_shape, [(conv, chunk, [walk(*piece, known[conv], q)[1] for q in range(4)]) for conv, *piece in _open_pieces(part)], part["conv_id"].type)

    leaves = marked.groupBy("chunk").cogroup(behind.groupBy("chunk")).applyInArrow(leaves_of, leave_shape)

    enter_shape = shape("chunk long, behind array<long>, enter long")

    def entries(batches):  # from each conversation's first piece to its last
        last, q = (), START
        for batch in batches:
            out = []
            for conv, chunk, leave, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != last:
                    last, q = (conv,), START
                out.append((conv, chunk, vector, q))
                q = leave[q]
            yield from _table(enter_shape, out, batch.column(0).type).to_batches()

    both = leaves.select("chunk", F.col("conv_id").alias("same"), "leaves").join(behind, "chunk").where(F.col("same").eqNullSafe(F.col("conv_id")))
    enter = settle(along(both.select("conv_id", "chunk", "leaves", "behind"), F.asc("chunk")).mapInArrow(entries, enter_shape), "conversation-entries")

    edit_shape = shape("ord long, fault string, letters string")

    def edits_of(part: pa.Table, given: pa.Table) -> pa.Table:
        known = {conv: (tuple(vector), q) for conv, vector, q in zip(*(given[c].to_pylist() for c in ("conv_id", "behind", "enter")))}
        part = part.sort_by("ord")
        letters = [x for conv, *piece in _pieces(part) for x in walk(*piece, *known.get(conv, (END_VECTOR, START)))[0]]
        return part.select(["conv_id", "ord", "fault"]).append_column("letters", pa.array(letters, pa.string()))

    return marked.groupBy("chunk").cogroup(enter.groupBy("chunk")).applyInArrow(edits_of, edit_shape)


class _Conversation:
    """Figures of one conversation, its rows fed in order."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns, self.lowest, self.highest = 0, None, None
        self.illegal, self.initial, self.cost, self.q = 0, None, 0, START
        self.audit, self.hash, self.lines = [], hashlib.sha256(), 0

    def line(self, role: str, text: str, initial: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
        self.lines += 1
        self.q = AFTER[self.q][initial]

    def insert(self, letters: str) -> None:
        for _ in letters:
            self.cost += INSERT
            initial = "a" if self.q == USER else "u"
            self.line(ROLES[initial], "", initial)

    def row(self, turn, role, text, initial, fault, letters) -> None:
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            if turn != self.highest:
                self.turns += 1
            self.lowest, self.highest = turn if self.lowest is None else self.lowest, turn
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.audit.append(letters)
        self.insert(letters[:-1])
        edit = letters[-1]
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += CUT_OFF * (fault == "truncated") + RELABEL * (edit == "R")
        if edit == "R":
            initial = "a" if self.q == USER else "u"
            role = ROLES[initial]
        self.line(role, text, initial)

    def result(self) -> tuple:
        if self.audit:
            self.audit.append(last := closing(self.q))
            self.insert(last)
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, conversations: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text``), and of ``conversations`` where given."""
    rows = rows_in_order(rows, chunk_rows)
    found = settle(edits(rows), "conversation-edits")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    texts = rows.select("conv_id", "ord", F.lit(1).alias("kind"), "turn", "role", "text", "initial", none("string", "fault"), none("string", "letters"))
    told = found.select("conv_id", "ord", F.lit(0).alias("kind"), none("long", "turn"), none("string", "role"), none("string", "text"), none("string", "initial"), "fault", "letters")
    both = texts.unionByName(told)
    if conversations is not None:
        named = conversations.select("conv_id").distinct()
        both = both.unionByName(named.select("conv_id", F.lit(-1).cast("long").alias("ord"), F.lit(-1).alias("kind"), *(none(t, n) for n, t in texts.dtypes[3:])))
    shape = T.StructType([both.schema["conv_id"], *T._parse_datatype_string(_RESULT).fields])

    def read(batches):
        last, now, edit = None, None, None
        for batch in batches:
            out = []
            for conv, _, kind, turn, role, text, initial, fault, letters in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != last:
                    if last:
                        out.append((*last, *now.result()))
                    last, now = (conv,), _Conversation()
                if kind == 0:
                    edit = fault, letters
                elif kind == 1:
                    now.row(turn, role, text, initial, *edit)
            if out:
                yield _batch(out, batch.schema.field(0).type)
        if last:
            yield _batch([(*last, *now.result())], batch.schema.field(0).type)

    def _batch(out, conv):
        kinds = [conv, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=shape.names)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "ord", "kind").mapInArrow(read, shape)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by the checksum of ``conv_id:turn``: the given test of the operator."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def _sql() -> str:
    """The damage by a checksum built from its polynomial, and the programme run forwards: a cheapest (cost, letters, lines) for each state."""
    far = f"{{'c': {FAR}, 'a': '', 't': ''}}"
    joined = lambda line: f"CASE WHEN s.t = '' THEN {line} ELSE s.t || chr(10) || {line} END"

    def step(state: str, cost: str, letter: str, line: str | None = None) -> str:
        after = joined(line).replace("s.t", f"{state}.t") if line else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {after}}}"

    user, assistant = "'user:'", "'assistant:'"
    insert_u = lambda q: step(q, str(INSERT), "I", user)
    closed = lambda of: f"""SELECT * REPLACE (list_min([u, {insert_u('z')}, {insert_u('y')}, {insert_u('p')}]) AS u) FROM
        (SELECT * REPLACE (list_min([p, {step('u', str(INSERT), 'I', assistant)}]) AS p) FROM
        (SELECT * REPLACE (list_min([u, {insert_u('z')}, {insert_u('y')}, {insert_u('p')}]) AS u) FROM {of}))"""  # noqa: E731
    when = lambda test, cand: f"CASE WHEN {test} THEN {cand} ELSE {far} END"
    keep = lambda q, initial: when(f"NOT gone AND initial = '{initial}'", step(q, "cut", "K", "role || ':' || text"))
    relabel = lambda q, name: when("NOT gone", step(q, f"{RELABEL} + cut", "R", f"{name} || text"))
    delete = lambda q: step(q, str(DELETE), "D")
    return rf"""
WITH RECURSIVE tab AS (SELECT CAST(i AS BIGINT) AS n, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT key, CAST(4294967295 AS BIGINT) AS c, 0 AS pos FROM (SELECT DISTINCT key FROM given)
  UNION ALL SELECT crc.key, xor(crc.c >> 8, tab.c), pos + 1 FROM crc JOIN tab ON tab.k = 8 AND tab.n = xor(crc.c, CAST(ascii(substr(crc.key, pos + 1, 1)) AS BIGINT)) % 256 WHERE pos < length(crc.key)),
faults AS (SELECT key, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS fault FROM crc WHERE pos = length(key)),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM given JOIN faults USING (key), range(2) r(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail, substr(role, 1, 1) AS initial FROM ranked),
rows_ AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
told AS (SELECT conv_id, turn, role, text, k, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM rows_),
run AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS z, {{'c': CAST({FAR} AS BIGINT), 'a': '', 't': ''}} AS y, {{'c': CAST({FAR} AS BIGINT), 'a': '', 't': ''}} AS u, {{'c': CAST({FAR} AS BIGINT), 'a': '', 't': ''}} AS p
  FROM (SELECT DISTINCT conv_id FROM told)
  UNION ALL SELECT w.conv_id, w.n + 1, {delete('z')}, list_min([{delete('y')}, {keep('z', 's')}]),
    list_min([{delete('u')}, {', '.join(f"{keep(q, 'u')}, {relabel(q, user)}" for q in 'zyp')}]), list_min([{delete('p')}, {keep('u', 'a')}, {relabel('u', assistant)}])
  FROM ({closed('run')}) w JOIN told ON told.conv_id IS NOT DISTINCT FROM w.conv_id AND told.k = w.n + 1),
last AS (SELECT conv_id, list_min([z, p]) AS best FROM ({closed('(SELECT run.* FROM run JOIN (SELECT conv_id, max(n) AS n FROM run GROUP BY 1) m ON run.conv_id IS NOT DISTINCT FROM m.conv_id AND run.n = m.n)')})),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM g.conv_id"""


@query("op11_conversation_repair", _sql())
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repair(damaged(given), given)
