"""Conversation repair against a plain recursion over all edits, on random conversations cut into small chunks, and against its SQL."""

import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from sheetwise.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, gaps string, id long"
SPACE = r"[^\x20\x09-\x0d]"


def plain_damage(rows):
    out, space = [], lambda v: " " if v is None else v
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = ("user" if kind == 4 else space(role)), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """The result of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    kinds, seen = [], set()
    for _, _, role, text in rows:
        said = re.findall(SPACE, text)
        kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))

    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for x in "ua":
            if inserted < 3 and (state, x) in legal:
                c, a, out = best(i, x, inserted + 1)
                ways.append((c + 3, "I" + a, (("user" if x == "u" else "assistant", ""), *out)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, out = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, out))
            if kinds[i] in ("", "truncated"):
                extra = 3 * (kinds[i] == "truncated")
                for edit, x, name, cost in (("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)):
                    if (state, x) in legal:
                        c, a, out = best(i + 1, x, 0)
                        ways.append((c + cost + extra, edit + a, ((name, text), *out)))
        return min(ways) if ways else (10**9, "", ())

    for i in range(len(rows), -1, -50):  # keeps the recursion shallow
        for s in ("", "s", "u", "a"):
            best(i, s, 0)
    cost, audit, out = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(kinds.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def expected(rows):
    groups = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    return sorted(((c, *plain(g)) for c, g in groups.items()), key=repr)


def conversations():
    r, rows = random.Random(5), []
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None, "User"]
    texts = ["Fine.", "Fine.", "Well?", "no stop", "And é!", " ", "", None, "a:b\nc.", "Ok. \t"]
    for c in range(150):
        rows += [(c, t, r.choice(roles[:12] if c % 2 else roles), r.choice(texts) if c % 3 else f"{t}.") for t in range(r.randrange(1, 14))]
    rows += [(1000, t, ("user", "assistant")[t % 2], r.choice(["Yes.", f"{t} is it", f"{t}!"])) for t in range(400)]
    rows += [(None, 3, "user", "x."), (None, None, None, None), (2000, None, "user", "x."), (2000, None, "assistant", "y"), (2001, 5, "user", "tie."), (2001, 5, "assistant", "tie."), (2001, 9, "user", "w" * 40000)]
    return rows + rows[-6:]


def made(spark, rows, most):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in repair.repair(repair.damaged(df), most).collect()], key=repr)


@pytest.mark.parametrize("most", [3, repair.CHUNK])
def test_against_all_edits(spark, most):
    rows = conversations()
    assert made(spark, rows, most) == expected(rows)


def test_nothing_left_and_nothing_at_all(spark):
    assert made(spark, [], 3) == []
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    empty = hashlib.sha256(b"").hexdigest()
    assert gone and made(spark, gone, 3) == sorted([(c, 0, 0, 0, 0, 0, 0, "", empty) for c, *_ in gone], key=repr)


def test_sql_gives_the_same(spark):
    rows = conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    assert sorted(con.sql(repair.OP11_SQL).fetchall(), key=repr) == expected(rows)
