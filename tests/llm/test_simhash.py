"""Fingerprints and components against a plain version that compares all pairs."""

import random
import re

import xxhash

from sheetwise.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string, root long"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(prints):
    """The least member of each fingerprint's linked group, by all pairs."""
    left, root = set(prints), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        root |= dict.fromkeys(group, min(group))
    return root


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    root, least = plain_roots(prints), {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted([(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)], key=repr)


def made(spark, rows, **args):
    docs = spark.createDataFrame([(i, t, "clash", -1) for i, t in rows], SCHEMA)
    return sorted([tuple(r) for r in simhash.near_duplicates(docs, **args).collect()], key=repr)


def test_masks_cover_every_pair_within_the_radius():
    r = random.Random(1)
    for positions in (list(range(64)), list(range(3, 64, 2))):
        masks = simhash.covering(positions)
        assert len(masks) == 31
        for _ in range(3000):
            off = sum(1 << p for p in r.sample(positions, 4))
            assert any(not m & off for m in masks)
    masks = simhash.covering(list(range(64)))
    for m in masks:
        outside = [p for p in range(64) if not m >> p & 1]
        assert all(len(outside) - x.bit_count() <= 16 for x in simhash.covering(outside))


def test_documents_and_edge_cases(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdÉé") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(40):
        base = [r.choice(words) for _ in range(r.randrange(30, 200))]
        for k in range(3):
            copy = base[:]
            if k:
                copy[r.randrange(len(copy))] = "other"
            rows.append((len(rows) * 3 - 20, " ".join(copy)))
    rows += [(9001, None), (9002, ""), (9003, " \n\t\x0b"), (9004, "A b"), (9005, "a B"), (9005, "a B"), (None, "a  b\n"), (None, "quite alone here it is"), (9006, "x" * 50000), (9007, "Same " * 70000), (9008, "a\x1cb c d e"), (9009, "a b c d e")]
    assert made(spark, rows) == expected(rows)
    assert made(spark, rows, bucket=1) == expected(rows)
    assert made(spark, []) == []


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in set(r.choices(range(64), k=r.randrange(7)))) for c in centres for _ in range(150)}
    prints |= {centres[0] ^ (1 << k) - 1 for k in range(0, 60, 4)}  # a chain of links
    wanted = plain_roots(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for bucket in (simhash.BUCKET, 20):
        root = {p: p for p in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        found = simhash.links(table, bucket=bucket).collect()
        for a, b in {(x.a % 2**64, x.b % 2**64) for x in found}:
            root[top(a)] = top(b)
        groups = lambda f: {frozenset(p for p in prints if f(p) == t) for t in map(f, prints)}
        assert groups(top) == groups(wanted.get)
