"""Conversation structure repair: the cheapest edits that give each conversation a legal turn order.

A legal order has role initials (s?(ua)+)?. Keeping a turn is free, giving it the role
user or assistant costs REROLE, deleting it DELETE, inserting an empty turn INSERT, and
keeping a truncated turn TRUNCATED more. Blank and repeated turns must go.

Retained-subsequence dynamic programme: the last retained turn has an initial, one of
s, u, a or none so far, and a running minimum for each holds the cheapest way to it less
the sum of deletions up to there, so a gap costs the difference of two prefix sums. The
pair of initials around a gap says how many turns to insert. Ways of equal cost are told
apart by their audits, the initials of the edits in order (Delete, Insert, Keep, Rerole
in ASCII order; in a gap deletions come first). Of two audits over the same turns none
begins the other unless they are equal, so the order of the audits so far settles a tie
for good, and a rank in place of the audit is enough.

Scale: rows are range-partitioned by conversation, turn, role and the beginning of the
text, so a huge conversation spreads over many tasks, and cut into chunks of up to CHUNK
turns, one row each. A chunk that holds its whole conversation, nearly all do, is
repaired on the spot. The others return a small summary: for each initial before the
chunk and each behind it the least cost and the rank of its audit. A fold over the
summaries of a conversation fixes the initial at each border, then all chunks are
repaired in parallel, and the digests run over the pieces in order. A text's earlier
occurrence in another chunk is found by a grouped minimum over digests.

Defined results: turns are ordered by turn (nulls first), role and text; null text and
role count as one space, and so do a null conv_id and turn in the damage's key; a null
conv_id is a conversation of its own; repeated rows are turns of their own; texts of any
length are taken whole; roles other than those that begin with s, u or a can only be
reroled or deleted; rows marked as gone leave a conversation without turns: zeros, an
empty audit and the hash of an empty string; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a chunk, and bytes of text after which it is closed.
CHUNK, CHUNK_BYTES = 1024, 4 << 20
NONE, INITIALS = 0, {"s": 1, "u": 2, "a": 3}
U, A = INITIALS["u"], INITIALS["a"]
STATES = range(4)
#: Turns to insert between two retained initials (the first one may be none); others cannot follow each other.
BETWEEN = {(0, 1): 0, (0, 2): 0, (1, 2): 0, (3, 2): 0, (2, 2): 1, (2, 3): 0, (0, 3): 1, (1, 3): 1, (3, 3): 1}
#: Turns to insert behind the last retained initial.
BEHIND = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"


def fault(text: str) -> str:
    """'blank', 'truncated' or '' for one text."""
    said = text.rstrip(SPACES)
    return "blank" if not said else "" if said[-1] in ".!?" else "truncated"


class Path:
    """The cheapest edits of some turns, entered behind one initial.

    add() takes (initial of the role, may it stay, is it truncated) of the turns in order.
    """

    def __init__(self, enter: int):
        self.enter, self.turns = enter, 0
        #: by initial: cost less the deletions so far, rank of the audit, last retained turn (-1: none)
        self.low: list[tuple[int, int, int] | None] = [None] * 4
        self.low[enter] = (0, 0, -1)
        #: for each turn and initial: (edit, turns inserted before it, initial before it, the turn retained before it)
        self.steps: list[list[tuple[str, int, int, int] | None]] = []

    def add(self, initial: str, stays: bool, truncated: bool) -> None:
        step: list[tuple[str, int, int, int] | None] = [None] * 4
        best: list[tuple | None] = [None if x is None else (x[0], x[1], "D", x[2]) for x in self.low]
        own = INITIALS.get(initial, NONE)
        for to in ((own,) if own == 1 else ()) + (U, A) if stays else ():
            edit, cost = ("K", 0) if to == own else ("R", REROLE)
            ways = []
            for before in STATES:
                if (x := self.low[before]) is not None and (before, to) in BETWEEN:
                    n = BETWEEN[before, to]
                    ways.append((x[0] + cost + TRUNCATED * truncated + INSERT * n - DELETE, x[1], "I" * n + edit, before, x[2]))
            # staying or going, the way is behind the same initial: cost, then audit
            if ways and (best[to] is None or min(ways)[:3] < best[to][:3]):
                way = min(ways)
                best[to] = (*way[:3], self.turns)
                step[to] = (edit, len(way[2]) - 1, way[3], way[4])
        order = {x: k for k, x in enumerate(sorted({x[1:3] for x in best if x is not None}))}
        self.low = [None if x is None else (x[0], order[x[1:3]], x[3]) for x in best]
        self.steps.append(step)
        self.turns += 1

    def cost(self, leave: int) -> int | None:
        return None if self.low[leave] is None else self.low[leave][0] + DELETE * self.turns

    def rank(self, leave: int) -> int:
        return self.low[leave][1]

    def last(self) -> int:
        """The initial to end with: least cost with what must follow, then least audit."""
        return min((self.cost(x) + INSERT * BEHIND[x], self.rank(x), x) for x in STATES if self.low[x] is not None)[2]

    def edits(self, leave: int) -> list[tuple[str, int, int]]:
        """(edit, turns inserted before it, initial that it leaves) of every turn."""
        out: list[tuple[str, int, int]] = [("D", 0, NONE)] * self.turns
        state, at = leave, self.low[leave][2]
        while at >= 0:
            edit, n, before, earlier = self.steps[at][state]
            out[at] = (edit, n, state)
            state, at = before, earlier
        return out


def _inserted(before: int, n: int) -> list[str]:
    """n inserted turns behind an initial."""
    out = []
    for _ in range(n):
        before = A if before == U else U
        out.append("user:" if before == U else "assistant:")
    return out


def _applied(enter: int, leave: int, edits: list[tuple[str, int, int]], roles: list[str], texts: list[str], final: bool) -> tuple[str, list[str]]:
    """(audit, repaired turns) of some turns; what must follow the last one, too, if they are the final ones."""
    audit, turns, state = [], [], enter
    for (edit, n, to), role, text in zip(edits, roles, texts):
        audit.append("I" * n + edit)
        if edit != "D":
            turns += _inserted(state, n)
            turns.append(f"{role if edit == 'K' else 'user' if to == U else 'assistant'}:{text}")
            state = to
    if final:
        audit.append("I" * BEHIND[leave])
        turns += _inserted(leave, BEHIND[leave])
    return "".join(audit), turns


def _faults(roles: list[str], texts: list[str], earlier: set[int]) -> list[str]:
    """The first fault of each turn; earlier: those that repeat a turn of an earlier chunk."""
    out, seen = [], set()
    for k, (role, text) in enumerate(zip(roles, texts)):
        kind = fault(text)
        if kind != "blank" and (k in earlier or (role, text) in seen):
            kind = "duplicate"
        seen.add((role, text))
        out.append(kind)
    return out


def _path(enter: int, roles: list[str], faults: list[str]) -> Path:
    path = Path(enter)
    for role, kind in zip(roles, faults):
        path.add(role[:1], kind in ("", "truncated"), kind == "truncated")
    return path


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of conversations, damaged by the checksum of each row's place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"), space("text").alias("text"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", text.alias("text"), (F.col("kind") == 0).alias("gone"), F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("times")).drop("col")


_LISTS = "turns array<bigint>, roles array<string>, texts array<string>"
_FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_RESULT = f"conv_id string, {_FOUND}, audit string, repaired_sha256 string"


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(","))]))


def _each(work, schema: str):
    """A function for mapInArrow that turns each row, as a dict, into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for k in range(b.num_rows):
                out += work(b.slice(k, 1).to_pylist()[0])
                if len(out) >= 1024:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)

    return run


def chunks(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) in order, as chunks of up to `most` turns; id orders the chunks.

    whole: the chunk is all of its conversation. Conversations at the edge of a task are
    never known to be whole.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "gone")
    dealt = rows.repartitionByRange(parts, *order, F.substring("text", 1, 60)).sortWithinPartitions(*order, "text")
    schema = f"number bigint, conv_id string, whole boolean, {_LISTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bulk, number = [], 0, 0
        now, opened = None, False  # the open chunk; whether its conversation has begun in it, behind another one
        for b in batches:
            for conv, turn, role, text, gone in zip(*(x.to_pylist() for x in b.columns)):
                other = now is None or conv != now["conv_id"]
                if other or len(now["turns"]) >= most or now["size"] >= CHUNK_BYTES:
                    if now is not None:
                        held.append(now | {"whole": opened and other})
                        bulk += now["size"]
                        number += 1
                    opened = other and now is not None
                    now = {"number": number, "conv_id": conv, "turns": [], "roles": [], "texts": [], "size": 0}
                    if len(held) >= 256 or bulk >= CHUNK_BYTES:
                        yield _batch([{k: v for k, v in x.items() if k != "size"} for x in held], schema)
                        held, bulk = [], 0
                if not gone:
                    now["turns"].append(turn)
                    now["roles"].append(role)
                    now["texts"].append(text)
                    now["size"] += len(text)
        if now is not None:
            held.append(now | {"whole": False})
        yield _batch([{k: v for k, v in x.items() if k != "size"} for x in held], schema)

    place = F.shiftleft(F.spark_partition_id().cast("bigint"), 40).bitwiseOR(F.col("number"))
    return dealt.mapInArrow(run, schema).select(place.alias("id"), "conv_id", "whole", "turns", "roles", "texts")


def _spread(turns: list[int | None]) -> dict:
    there = [t for t in turns if t is not None]
    return {"low": min(there, default=None), "high": max(there, default=None), "distinct": len(set(there))}


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _whole(row: dict) -> list[dict]:
    """The result of a conversation that is one chunk."""
    kinds = _faults(row["roles"], row["texts"], set())
    path = _path(NONE, row["roles"], kinds)
    leave = path.last()
    audit, turns = _applied(NONE, leave, path.edits(leave), row["roles"], row["texts"], True)
    found = {"gaps": _gaps(**_spread(row["turns"])), "illegal": _illegal(row["roles"]), "cost": path.cost(leave) + INSERT * BEHIND[leave]}
    counts = {x: kinds.count(x) for x in ("blank", "duplicate", "truncated")}
    return [{"conv_id": row["conv_id"], **found, **counts, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(turns).encode()).hexdigest()}]


def _digests(row: dict) -> list[dict]:
    """(digest, id, place) of each different turn of a chunk."""
    out, head = {}, b"-" if row["conv_id"] is None else b"+" + row["conv_id"].encode()
    for k, (role, text) in enumerate(zip(row["roles"], row["texts"])):
        parts = (head, role.encode(), text.encode())
        out.setdefault(hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in parts)).hexdigest(), k)
    return [{"digest": d, "id": row["id"], "place": k} for d, k in out.items()]


_SUMMARY = "id bigint, conv_id string, first string, last string, first_turn bigint, last_turn bigint, low bigint, high bigint, distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, costs array<bigint>, ranks array<bigint>"


def _summary(row: dict) -> list[dict]:
    """What a fold over chunks must know of one: costs and ranks from each initial to each other."""
    roles, turns, kinds = row["roles"], row["turns"], _faults(row["roles"], row["texts"], set(row["earlier"] or ()))
    paths = [_path(enter, roles, kinds) for enter in STATES]
    ends = {"first": roles[0][:1], "last": roles[-1][:1], "first_turn": turns[0], "last_turn": turns[-1]} if roles else {}
    counts = {x: kinds.count(x) for x in ("blank", "duplicate", "truncated")}
    costs = [p.cost(x) for p in paths for x in STATES]
    ranks = [None if p.low[x] is None else p.rank(x) for p in paths for x in STATES]
    return [{"id": row["id"], "conv_id": row["conv_id"], **ends, **_spread(turns), **counts, "illegal": _illegal(roles), "costs": costs, "ranks": ranks}]


_BORDERS = f"id bigint, enter bigint, leave bigint, final boolean, {_FOUND}"


def _borders(row: dict) -> list[dict]:
    """The initials before and behind each chunk of a conversation; its counts with the last chunk."""
    parts = sorted(row["parts"], key=lambda p: p["id"])
    rest = [[INSERT * n for n in BEHIND]]
    for p in reversed(parts):
        ways = [[c + r for c, r in zip(p["costs"][4 * x : 4 * x + 4], rest[-1]) if c is not None and r is not None] for x in STATES]
        rest.append([min(w, default=None) for w in ways])
    rest.reverse()
    out, state, total = [], NONE, {x: sum(p[x] for p in parts) for x in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    before = None
    for k, p in enumerate(parts):
        fit = [x for x in STATES if (c := p["costs"][4 * state + x]) is not None and c + rest[k + 1][x] == rest[k][state]]
        leave = min(fit, key=lambda x: p["ranks"][4 * state + x])
        out.append({"id": p["id"], "enter": state, "leave": leave, "final": k == len(parts) - 1})
        state = leave
        if p["first"] is not None:
            if before is not None:
                total["illegal"] += before["last"] + p["first"] not in LEGAL
                total["distinct"] -= p["first_turn"] is not None and p["first_turn"] == before["last_turn"]
            before = p
    lows, highs = [p["low"] for p in parts if p["low"] is not None], [p["high"] for p in parts if p["high"] is not None]
    out[-1] |= {"gaps": _gaps(min(lows, default=None), max(highs, default=None), total.pop("distinct")), "cost": rest[0][NONE], **total}
    return out


_PIECES = f"conv_id string, id bigint, final boolean, {_FOUND}, audit string, kept bigint, piece string"


def _piece(row: dict) -> list[dict]:
    """The edits of a chunk and its part of the repaired text."""
    kinds = _faults(row["roles"], row["texts"], set(row["earlier"] or ()))
    edits = _path(row["enter"], row["roles"], kinds).edits(row["leave"])
    audit, turns = _applied(row["enter"], row["leave"], edits, row["roles"], row["texts"], row["final"])
    same = {x: row[x] for x in ("conv_id", "id", "final", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return [same | {"audit": audit, "kept": len(turns), "piece": "\n".join(turns)}]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations whose pieces come in order: the digest runs over them, one at a time."""
    digest, audits, begun = hashlib.sha256(), [], False
    for b in batches:
        out = []
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            if row["kept"]:
                digest.update(("\n" * begun + row["piece"]).encode())
                begun = True
            audits.append(row["audit"])
            if row["final"]:
                out.append({x: row[x] for x in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()})
                digest, audits, begun = hashlib.sha256(), [], False
        yield _batch(out, _RESULT)


def repair(rows: DataFrame, most: int = CHUNK) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text, gone): its faults, the cheapest edits and the digest of what they give."""
    shared_dir(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType
    made = cut(chunks(rows, most))
    whole = made.where("whole").select("conv_id", "turns", "roles", "texts").mapInArrow(_each(_whole, _RESULT), _RESULT)
    pieces = made.where("not whole").drop("whole")
    keys = pieces.select("id", "conv_id", "roles", "texts").mapInArrow(_each(_digests, "digest string, id bigint, place bigint"), "digest string, id bigint, place bigint")
    keys = cut(keys)
    again = keys.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("other")).where("first <> other")
    earlier = keys.join(again, "digest").where("id > first").groupBy("id").agg(F.collect_list("place").alias("earlier"))  # at most `most` of a chunk
    pieces = cut(pieces.join(earlier, "id", "left"))
    parts = pieces.mapInArrow(_each(_summary, _SUMMARY), _SUMMARY)
    folded = parts.groupBy("conv_id").agg(F.collect_list(F.struct(*(c for c in parts.columns if c != "conv_id"))).alias("parts"))
    borders = folded.select("parts").mapInArrow(_each(_borders, _BORDERS), _BORDERS)
    applied = pieces.select("id", "conv_id", "roles", "texts", "earlier").join(borders, "id").mapInArrow(_each(_piece, _PIECES), _PIECES)
    split = applied.repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(_joined, _RESULT)
    return whole.unionByName(split).withColumn("conv_id", F.col("conv_id").cast(kind))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    # the cheapest way through the turns that are left, as nine digits of cost and the audit; one column for each initial before them
    more = lambda v, cost, edits: f"lpad(CAST(CAST(left({v}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{edits}' || substr({v}, 10)"
    ways = []
    for before in STATES:
        out = [more(f"v{before}", DELETE, "D")]
        for to in (1, 2, 3):
            if (before, to) in BETWEEN:
                n = BETWEEN[before, to]
                own, cost = f"own = {to}", f"{INSERT * n} + {TRUNCATED} * cut"
                out.append(f"CASE WHEN stays AND {own} THEN {more(f'v{to}', cost, 'I' * n + 'K')} END")
                if to != 1:
                    out.append(f"CASE WHEN stays AND NOT {own} THEN {more(f'v{to}', f'{cost} + {REROLE}', 'I' * n + 'R')} END")
        ways.append(f"least({', '.join(out)})")
    ends = ", ".join(f"'{INSERT * n:09d}{'I' * n}'" for n in BEHIND)
    word = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  [CAST(4294967295 AS BIGINT)] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM conversations),
m AS (SELECT *, xor(list_reduce(bytes, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE kind <> 0),
p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{word}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '({word})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM p),
g AS (SELECT *, fault IN ('', 'truncated') AS stays, CAST(fault = 'truncated' AS INTEGER) AS cut, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS own FROM f),
w(conv_id, i, v0, v1, v2, v3) AS (SELECT DISTINCT conv_id, n + 1, {ends} FROM g
  UNION ALL SELECT g.conv_id, g.i, {', '.join(ways)} FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i - 1),
a AS (SELECT conv_id, CAST(left(v0, 9) AS BIGINT) AS cost, substr(v0, 10) AS audit FROM w WHERE i = 1),
e AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, audit FROM a),
l AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, length(replace(left(audit, j), 'I', '')) AS i FROM e),
o AS (SELECT l.conv_id, l.edit, g.role, g.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) AS j, first_value(l.edit = 'K' AND g.own = 1) OVER (PARTITION BY l.conv_id ORDER BY l.j) AS s
  FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.i = l.i AND l.edit <> 'I' WHERE l.edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - CAST(s AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS text FROM o GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT q.conv_id, {', '.join(f'CAST(coalesce({x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))}, coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM q.conv_id
"""


OP11_SQL = _sql()
