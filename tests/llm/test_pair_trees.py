"""Words merged side by side against one tree each, and texts that learn their pieces together against texts encoded alone."""

import hashlib
import random

import numpy as np

from sheetwise.llm import bpe
from sheetwise.llm.bpe import PAIR, PairTree, PairTrees


def test_trees_side_by_side_merge_as_one_does():
    r = random.Random(7)
    ranks, merged = {}, []
    while len(merged) < 30:
        a, b = r.randrange(4 + len(merged)), r.randrange(4 + len(merged))
        if a << PAIR | b not in ranks:
            ranks[a << PAIR | b] = len(merged)
            merged.append(4 + len(merged))
    trees = PairTrees(ranks, merged)
    for size in (1, 2, 8, 64):
        sizes = np.array([r.randint(1, size) for _ in range(50)])
        ids = np.array([[r.randrange(4) for _ in range(size)] for _ in range(50)])
        want = [tuple(PairTree(row[:n], ranks, merged).merge_all()) for row, n in zip(ids.tolist(), sizes.tolist())]
        assert trees.merge_all(ids, sizes) == want


def test_texts_learn_their_pieces_together(monkeypatch):
    words = bpe.WordBPE(bpe.default_vocabulary())
    texts = ["", " ", "One two, TWO don't", "a" * 64, "b" * 65, "ab" * 900, "Σας é中文 x1y22", "<|endoftext|>end<|endoftext|>", "One again"] * 3
    want = []
    for t in texts:
        ids = words.encode(t)
        want.append((len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), words.decode(ids)))))
    assert list(words.digests(iter(texts))) == want
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CHUNK", 20)
    assert list(bpe.WordBPE(bpe.default_vocabulary()).digests(iter(texts))) == want
