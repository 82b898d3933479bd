"""Conversation repair beside exhaustive search, and conversations cut into many pieces."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest

from gridspark.llm import conversations
from gridspark.llm.common import table
from gridspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def broken(rows):
    """The contract's damage, in plain Python."""
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)


def judged(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        tail = text.rstrip(BLANK)
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else None if tail[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """(cost, letters) over all edits, by recursion from the front with at most three inserts in a row."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(maxsize=None)
    def best(i, q, inserted):
        found = []
        if i == len(initials) and q in ("", "a"):
            found.append((0, ""))
        if inserted < 3:
            for x in "ua":
                if x in step[q]:
                    c, rest = best(i, step[q][x], inserted + 1)
                    found.append((c + 2, "I" + rest))
        if i < len(initials):
            c, rest = best(i + 1, q, 0)
            found.append((c + 3, "D" + rest))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if initials[i] in step[q]:
                    c, rest = best(i + 1, step[q][initials[i]], 0)
                    found.append((c + cut, "K" + rest))
                for x in "ua":
                    if x in step[q]:
                        c, rest = best(i + 1, step[q][x], 0)
                        found.append((c + 2 + cut, "R" + rest))
        return min(found, default=(10**9, ""))

    for i in range(len(initials), -1, -1):  # keeps the recursion shallow
        for q, n in itertools.product(step, (3, 2, 1, 0)):
            best(i, q, n)
    return best(0, "", 0)


def expected(rows):
    """A conversation's row of results; ``rows`` in order."""
    faults, initials = judged(rows), [r[2][:1] for r in rows]
    cost, letters = cheapest(initials, faults)
    out, q, at = [], "", 0
    for x in letters:
        nxt = "a" if q == "u" else "u"
        name = {"u": "user", "a": "assistant"}[nxt]
        if x == "I":
            out.append(f"{name}:")
            q = nxt
            continue
        if x == "K":
            out.append(f"{rows[at][2]}:{rows[at][3]}")
            q = initials[at]
        if x == "R":
            out.append(f"{name}:{rows[at][3]}")
            q = nxt
        at += 1
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check(got, rows, names):
    groups = {c: [] for c in names}
    for r in rows:
        groups[r[0]].append(r)
    for part in groups.values():
        part.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
    assert sorted(groups, key=str) == sorted((r.conv_id for r in got), key=str)
    for r in got:
        assert tuple(r)[1:] == expected(groups[r.conv_id]), r.conv_id


COLUMNS = "conv_id long, turn long, role string, text string"


def test_given_table(spark):
    given = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op11_conversation_repair"](spark, SF).collect(), broken(given), {r[0] for r in given})


ROLES = ["user", "assistant", "system", "tool", "User", "", None]


def some(seed, conversations_, most):
    r = random.Random(seed)
    texts = ["One.", "two", "", " \n", "Three!", "four? ", "five. x", None, "six" * 50 + "."]
    return [(c, r.choice([None, *range(6)]) if r.random() < 0.2 else t, r.choice(ROLES if r.random() < 0.3 else ROLES[:2]), f"{r.choice(texts) or ''}" if r.random() < 0.4 else f"text {r.randrange(10**6)}{r.choice('. !')}")
            for c in conversations_ for t in range(r.randrange(most) + 1)]


def test_damage_and_ties(spark):
    given = [*some(1, [*range(40), None], 12), (50, None, None, None), (51, 1, "user", None), (51, 1, "user", None)]
    df = spark.createDataFrame(given, COLUMNS).repartition(4)
    check(conversations.repair(conversations.damaged(df), df).collect(), broken(given), {r[0] for r in given})


def test_long_conversations_in_many_pieces(spark):
    """A conversation that holds most rows runs over many chunks; small ones lie between."""
    long = [(7, t, x, f"t{t}{y}") for (t, x), y in zip(enumerate(random.Random(4).choices(ROLES[:4], [4, 3, 1, 1], k=700)), random.Random(5).choices([".", "", "!"], k=700))]
    rows = [*some(2, range(7), 6), *long, *some(3, range(8, 14), 6), *[(14, 3, "user", "same.")] * 90]
    rows = [(c, t, x or " ", y) for c, t, x, y in rows]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = conversations.repair(df, chunk_rows=60)
    check(got.collect(), rows, {r[0] for r in rows})


def test_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert conversations.repair(none, none).count() == 0
    one = spark.createDataFrame([(3, None, None, None)], COLUMNS)
    assert tuple(conversations.repair(one.where("false"), one).first()) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("n", [1, 2, 5, 30])
def test_checkpoints_do_not_change_the_walk(n):
    r = random.Random(n)
    initials, faults = r.choices(["s", "u", "a", ""], k=n), r.choices([0, 0, 1, 2], k=n)
    letters, q = conversations.walk(initials, faults, conversations.END_VECTOR, 0)
    names = {0: None, 1: "truncated", 2: "blank"}
    cost, want = cheapest(initials, [names[f] for f in faults])
    assert "".join(letters) + conversations.closing(q) == want
    assert min(map(sum, zip(conversations.costs(initials, faults)[0].tolist(), conversations._settled(list(conversations.CLOSED))))) == cost
