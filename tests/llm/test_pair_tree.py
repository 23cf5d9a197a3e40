"""The pair tree against merging by search, with ties and long words; pairs are keyed by one number."""

import random

from sheetwise.llm.bpe import PAIR, PairTree


def plain(ids, ranks, merged):
    while True:
        found = [(ranks[a << PAIR | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << PAIR | b in ranks]
        if not found:
            return ids
        rank, k = min(found)
        ids = [*ids[:k], merged[rank], *ids[k + 2 :]]


def test_tree_merges_as_search_does():
    r = random.Random(4)
    for symbols, length in ((3, 12), (6, 40), (2, 700)):
        merged, ranks = [], {}
        while len(merged) < 30:
            a, b = r.randrange(symbols + len(merged)), r.randrange(symbols + len(merged))
            if a << PAIR | b not in ranks:
                ranks[a << PAIR | b] = len(merged)
                merged.append(symbols + len(merged))
        for n in (1, 2, 3, 4, 5, length, length + 1):
            ids = [r.randrange(symbols) for _ in range(n)]
            assert PairTree(list(ids), ranks, merged).merge_all() == plain(ids, ranks, merged)
