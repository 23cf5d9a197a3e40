"""The text operators against plain versions on small tables: random texts, and the edge cases that their docstrings define."""

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sheetwise.llm import bpe, chat, decontaminate, importance, jaccard, pii, quality_rules, suffix_dedup, token_store, warc

SPACE = r"[^\x20\x09-\x0d]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "a" * 30000), (9005, "twice twice"), (9005, "twice twice"), (None, "no id")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def texts(n, seed, words=60):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(80)]
    return [" ".join(r.choice(pool) for _ in range(r.randrange(0, words))) + r.choice(["", ".", "\n", "  X"]) for _ in range(n)]


# --- quality rules


def measures(x):
    ws = re.findall(SPACE, x)
    lines, seen, dup = [y for y in x.split("\n") if re.search(SPACE, y)], set(), 0
    for y in lines:
        dup += y in seen
        seen.add(y)
    c = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    cover = {j for i in range(len(ws) - 7) if c[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(x.count(s) for s in "#*$%&|<>"), dup, len(cover)


def test_quality_rules(spark):
    rows = [(i, t * (1 + i % 3)) for i, t in enumerate(texts(80, 1))] + EDGES
    got = quality_rules.ledger(table(spark, rows)).collect()
    want = sorted([(i, *measures(t or "")) for i, t in rows], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=repr) == want
    ledger = quality_rules.ledger(table(spark, rows))
    judged = quality_rules.apply_policy(ledger, "base")
    assert all(r.kept == (r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words) for r in judged.collect())
    cost = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(ledger, "base").collect()}
    few = sum(r.n_words < 20 for r in got)
    assert cost["few_words"][0] == few and cost["few_words"][1] <= few
    assert quality_rules.ledger(table(spark, [])).count() == 0


# --- byte-pair encoding and the token store


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


ODD = ["It's X's don't", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> <|endoftext|> <|EndOfText|>. <|endoftext|>.", "<|", "e.,! 9,9 é.,", "\x1c a\x1db", "ΣΑΣ ẞ İ", "é ḍ̇", "x y　z", "한글 ᄀ", "!" * 5000, "ab" * 4000]


def test_bpe_is_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(60, 2) + ODD)] + EDGES
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    made = bpe.encode(table(spark, rows), bpe.default_vocabulary())
    want = sorted([(i, tuple(x), library.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids)], key=repr)
    assert sorted([(r.doc_id, tuple(r.ids), r.decoded) for r in made.collect()], key=repr) == want
    digests = bpe.encode(table(spark, rows), bpe.default_vocabulary(), digests_only=True).collect()
    want = sorted([(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(rows, ids)], key=repr)
    assert sorted([tuple(r) for r in digests], key=repr) == want
    assert sorted(r.text for r in bpe.decode(made, bpe.default_vocabulary()).collect()) == sorted(r.decoded for r in made.collect())


def test_token_store(spark, library, tmp_path):
    import numpy as np

    rows = [(i * 3 - 5, t) for i, t in enumerate(texts(70, 3) + ODD)] + EDGES
    at = f"file://{tmp_path}/store"
    token_store.write_store(table(spark, rows), at, bpe.default_vocabulary(), shards=3)
    got = token_store.read_store(spark, at).collect()
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=repr) == sorted(((i, crc(t)) for i, t in rows), key=repr)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:]) and got[0].doc_id is None
    store = token_store.TokenStore(spark, at)
    assert len(store.get(9005)) == 2 and not store.get(10**6) and not store.get(9000)
    for i, t in rows[:40]:
        assert list(store.get(i)[0])[:-1] == library.encode(t, add_special_tokens=False).ids
    token_store.write_store(table(spark, []), at + "0", bpe.default_vocabulary(), shards=2)
    assert token_store.read_store(spark, at + "0").count() == 0


def test_perfect_hash():
    import numpy as np

    for n in (1, 2, 5, 1000):
        _, _, slots = token_store.build_index(np.arange(n) * 977 - 12345)
        assert sorted(slots) == list(range(n))


def test_store_query_reads_through_the_index(spark, library, tmp_path):
    """The registered query's columns against the library; two long words that a sum of powers confuses are told apart."""
    import numpy as np

    thue = ["".join("ab"[(bin(k).count("1") + c) % 2] for k in range(1024)) for c in (0, 1)]
    rows = [(i, t) for i, t in enumerate(texts(30, 8))] + [(50, thue[0]), (51, thue[1]), (52, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got, start = {r.doc_id: r for r in token_store.op7_token_store(spark, f"file://{tmp_path}").collect()}, 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# --- near duplicates


def linked(rows):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted([(i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows)], key=repr)


def test_near_duplicates(spark):
    r, rows = random.Random(5), []
    for _ in range(60):
        base = [r.choice("abcdefgh") + str(r.randrange(300)) for _ in range(r.choice([1, 4, 5, 6, 9, 10, 14, 20, 50, 150]))]
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w.insert(r.randrange(len(w) + 1), f"z{r.randrange(50)}")
            rows.append((len(rows), " ".join(w) if r.random() < 0.9 else "  ".join(w).upper()))
    rows += EDGES
    got = jaccard.near_duplicates(table(spark, rows))
    assert sorted([tuple(x) for x in got.collect()], key=repr) == linked(rows)


def test_near_copies_without_an_id(spark):
    """One links two documents that are not near to each other; another pair of texts has no id at all."""
    w = [f"w{k}" for k in range(120)]
    base, other = w[:60], w[60:]
    rows = [(1, " ".join([f"a{k}" for k in range(6)] + base[6:])), (2, " ".join(base[:-6] + [f"b{k}" for k in range(6)])), (None, " ".join(base))]
    rows += [(None, " ".join(other)), (None, " ".join(other + ["end"])), (3, "far from all of them")]
    want = linked(rows)
    assert (2, 56, 1) in want and (None, 56, 1) in want
    assert sorted([tuple(x) for x in jaccard.near_duplicates(table(spark, rows)).collect()], key=repr) == want


def test_crowds(spark):
    """Variants of one text, some linked to it and some to few others; unlinked texts that share a passage; words that a sum of powers confuses."""
    r = random.Random(15)
    base, passage, rows = [f"b{k}" for k in range(90)], [f"p{k}" for k in range(40)], []
    for k in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(200)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join([f"q{k}.{j}" for j in range(r.randrange(3, 40))] + passage + [f"s{k}.{j}" for j in range(r.randrange(3, 40))])) for k in range(60)]
    thue = ["".join("ab"[(bin(k).count("1") + c) % 2] for k in range(2048)) for c in (0, 1)]
    rows += [(300, thue[0]), (301, thue[1])]
    want = linked(rows)
    assert len({c for _, _, c in want}) > 70
    assert sorted([tuple(x) for x in jaccard.near_duplicates(table(spark, rows)).collect()], key=repr) == want


def test_large_bands_of_small_sets_use_deletions():
    """Both allocations find every pair within the distance, and one-deletion is chosen where many small sets meet."""
    import numpy as np

    chosen = {jaccard.allocation(b, 10**8)[2] for b in range(20) if jaccard.most_misses(b)}
    assert chosen == {True, False}
    r, weights = np.random.default_rng(3), np.full(jaccard.SLOTS, jaccard.RARE, np.uint8)
    for sets in (1, 10**8):
        plan = [jaccard.allocation(b, sets) for b in range(len(jaccard.bands()))]
        for n in (4, 5, 7, 9, 12, 20, 33, 60, 200):
            for _ in range(20):
                x = np.sort(r.integers(0, 2**64, n, np.uint64, endpoint=False))
                gone, new = r.integers(0, n // 9 + 1), r.integers(0, n // 9 + 1)
                y = np.sort(np.concatenate([np.delete(x, r.choice(n, gone, replace=False)), r.integers(0, 2**64, new, np.uint64, endpoint=False)]))
                both = len(np.intersect1d(x, y))
                if 100 * both >= 80 * (len(x) + len(y) - both) and gone + new:
                    assert len(np.intersect1d(jaccard.segment_keys(x, weights, plan), jaccard.segment_keys(y, weights, plan)))


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


# --- repeated strings


def unrepeated(rows):
    low, data = {}, [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - 49):
            low[b[k : k + 50]] = min(i, low.get(b[k : k + 50], i))
    out = []
    for (i, _), (key, b) in zip(rows, data):
        m = bytearray(len(b))
        for k in range(len(b) - 49):
            if low[b[k : k + 50]] < key:
                m[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_strings(spark):
    r = random.Random(4)
    pool = ["".join(r.choice("abcd é") for _ in range(r.randrange(10, 150))) for _ in range(30)]
    rows = [(i, "".join(r.choice(pool) for _ in range(r.randrange(0, 9)))) for i in range(150)] + EDGES
    rows += [(9100, "a" * 400 + "b" + "a" * 400), (9101, "ab" * 200), (9005, "twice twice" * 20), (9102, "twice twice" * 20)]
    got = suffix_dedup.remove_repeats(table(spark, rows), with_text=True).collect()
    assert sorted([tuple(x)[:5] for x in got], key=repr) == unrepeated(rows)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got)
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_loser_tree():
    r = random.Random(6)
    runs = []
    for _ in range(7):
        rows = sorted({bytes(r.choice(b"ab") for _ in range(suffix_dedup.ROW)) for _ in range(r.randrange(0, 30))})
        if rows:
            import numpy as np

            runs.append((rows, suffix_dedup.front_code(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1))))
    merged = [row for _, row, _ in suffix_dedup.LoserTree([suffix_dedup.decode_run(c) for _, c in runs])]
    assert merged == sorted(x for rows, _ in runs for x in rows)


# --- personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def counts(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, t or "") if counts(k, m[0])]


def test_personal_data(spark):
    r = random.Random(2)
    bits = ["a", "b@c.d", "@", "x.y", "_", " ", "-", "é😀", "1", "12", "255", "256.1.1.1", ".", "+", "(", "4111 1111 1111 1111", "+1 (555) 123-4567", "5", "\n", "%"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 25)))) for i in range(400)] + EDGES
    rows += [(9200, "a" * 50000 + "@b.c"), (9201, "1" * 20000), (9202, "a@b" + ".c" * 9000), (9203, "+1" + " " * 9000), (9204, "1.1.1.1" * 2000)]
    got = pii.spans(table(spark, rows)).select("doc_id", pii.ordered(F.col("pii_base")).alias("s"), pii.ordered(F.col("pii_added")).alias("more")).collect()
    assert sorted([(x.doc_id, x.s) for x in got], key=repr) == sorted([(i, base_spans(t)) for i, t in rows], key=repr)
    assert pii.spans(table(spark, [])).count() == 0


def test_added_spans_and_redaction(spark):
    rows = [(1, "call 555-123-4567 now, order 555-123-4567, mail me at bob.12[at]site[dot]com, b@c.de"), (2, None), (3, "nothing")]
    got = {r.doc_id: r for r in pii.redact(table(spark, rows)).collect()}
    assert got[1].text == "call [PHONE] now, order 555-123-4567, mail me at [EMAIL], [EMAIL]"
    assert got[2].text is None and got[3].text == "nothing"


def test_added_spans_of_many_forms(spark):
    found = ["mail me at john.smith[at]site[dot]com", "email john.smith (at) site (dot) org", "write to jane [at] site [dot] co [dot] uk", "contact bob at site dot com", "mail ann@server", "my email is j.d.7(at)host(dot)net", "ask there, john.smith[at]site[dot]com"]
    phones = ["my number is 555-123-4567", "call me at (555) 123-4567", "phone 5551234567", "reach me at 555.123.4567"]
    hosts = ["server 10[.]1[.]20[.]3", "ip: 192 (dot) 168 (dot) 0 (dot) 12"]
    left = ["order 5551234567", "table 555 123 4567", "version 1[.]2[.]3[.]4", "we met (at) noon (dot) then", "version pack@main", "item 555-123-4567"]
    texts = found + phones + hosts + left
    got = {r.doc_id: [x.kind for x in r.pii_added] for r in pii.spans(table(spark, list(enumerate(f"so {t} ok" for t in texts)))).collect()}
    want = ["email"] * len(found) + ["phone"] * len(phones) + ["ip"] * len(hosts) + [None] * len(left)
    assert {t: got[k] for k, t in enumerate(texts)} == {t: [w] if w else [] for t, w in zip(texts, want)}


# --- chats


def test_chat_round_trip(spark):
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[TEXT]", "\\", "a", "\n", " ", "[", "<", "[OUT]", "é"]
    r, rows = random.Random(8), []
    for c in range(40):
        for k in range(r.randrange(1, 6)):
            rows.append((c, k, r.choice(["user", "assistant", "system", None, "tool", "we[TEXT] ird"]), "".join(r.choice(bits) for _ in range(r.randrange(0, 9)))))
    rows += [(None, 0, "user", None), (50, 0, "user", "same"), (50, 0, "user", "same"), (51, 0, "user", "q"), (51, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {x.conv_id: x for x in chat.format_chats(df).withColumn("p", chat.parse_chat(F.col("formatted"))).collect()}
    for c, own in {c: [x for x in rows if x[0] == c] for c in {x[0] for x in rows}}.items():
        want = [(x[2] or "", x[3] or "") for x in sorted(own, key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in got[c].p] == want
        learned = "".join(s.text for s in got[c].segments if s.loss)
        assert re.sub(r"(?s)\\(.)", r"\1", learned) == "".join(t for role, t in want if role == "assistant")
    assert got[51].valid and not got[50].valid


# --- archives


def test_archives(spark, tmp_path):
    r = random.Random(3)
    parts = ["\r\n", "\r\n\r\n", "\r", "\n", "x" * 3000, "WARC/1.1\r\n", "Content-Length: 5\r\n", "é😀"]
    pages = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 14)))) for i in range(60)] + [(100, None), (101, ""), (102, "\r\n"), (103, "\r\n"), (None, "no id")]
    df = spark.createDataFrame([(i, None, h) for i, h in pages], "page_id long, url string, html string")
    same = collections.defaultdict(list)
    for i, h in pages:
        same[h or ""].append(i)
    want = []
    for i, h in pages:
        b, top = (h or "").encode(), max((x for x in same[h or ""] if x is not None), default=None)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    for chunk in (50, warc.CHUNK):
        at = f"file://{tmp_path}/warc{chunk}"
        warc.write_archives(df.repartition(3), at, chunk=chunk)
        assert sorted([tuple(x) for x in warc.read_archives(spark, at).collect()], key=repr) == sorted(want, key=repr)


# --- benchmark passages


def test_decontamination(spark):
    r = random.Random(9)
    item = lambda n: " ".join("w" + str(r.randrange(5000)) for _ in range(n))
    items = [(k, item(r.randrange(20, 40))) for k in range(12)] + [(50, None), (51, "one two three"), (52, "again " * 30)]
    rows, want = [], set()
    for i in range(60):
        k, t = items[r.randrange(12)]
        w = t.split()
        if i % 3 == 0:
            want.add((i, k))
        elif i % 3 == 1:  # too many changes
            for p in range(0, len(w), 6):
                w[p] = "changed"
        else:
            w = item(30).split()
        rows.append((i, item(r.randrange(0, 60)) + " " + " ".join(w).upper() + "\n" + item(r.randrange(0, 60))))
    got = decontaminate.contaminated(table(spark, rows + EDGES), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and all(x.similarity >= 0.8 for x in got)


# --- importance resampling


def test_importance(spark):
    r = random.Random(10)
    good, bad = [f"w{k}" for k in range(200)], [f"*{k}*" for k in range(20)]
    rows = [(i, " ".join(r.choice(bad if i % 5 == 0 else good) for _ in range(80))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model, out = importance.fit(table(spark, rows + EDGES), labels)
    kept = {x.doc_id: x.kept for x in out.collect()}
    assert sum(kept[i] for i in range(600) if i % 5 == 0) == 0
    assert sum(kept[i] for i in range(600) if i % 5) >= 475
    docs = table(spark, rows + EDGES)
    assert importance.keep_resampled(docs, labels).count() == out.where("kept").count()
    everything = importance.fit(docs, labels.limit(0))[1]
    assert everything.where("not kept").count() == 0


def test_importance_of_rare_ngrams(spark):
    """Toxic words that occur eight times each, in documents that are ordinary otherwise and fill a small table many times."""
    r = random.Random(13)
    toxic = [f"tox{k}" for k in range(40)]
    rows = [(i, " ".join([f"w{r.randrange(10**6)}" for _ in range(200)] + ([toxic[(4 * i + k) % 40] for k in range(4)] if i < 80 else []))) for i in range(1500)]
    labels = spark.createDataFrame([(i, 1, int(i < 80)) for i in range(1500)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id: x.kept for x in importance.fit(table(spark, rows), labels)[1].collect()}
    assert sum(kept[i] for i in range(80)) <= 4 and sum(kept[i] for i in range(80, 1500)) >= 1400


def test_kth_largest(spark):
    r = random.Random(12)
    values = [r.choice([0.0, 1.5, r.random() * 9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, 500):
        assert importance.kth_largest(df, "v", k, bins=8, gather=3) == sorted(values, reverse=True)[k - 1]


# --- names, lengths and whole queries

CLASHES = ["_t", "_text", "_row", "row", "text_0", "salt_0", "key_0", "_gone", "_key", "pii_base", "pii_added", "ids", "t", "n", "id", "x", "c", "h", "hs", "ws", "slot", "missing", "tie", "k", "good", "weight", "label_id", "item", "windows", "all"]


def test_clashing_columns(spark, tmp_path):
    """Columns of any name change no result and come through unharmed."""
    import corpus_pipeline

    r = random.Random(31)
    rows = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(0, 60)))) for i in range(40)]
    rows += [(100, rows[5][1] + " end"), (101, "write to a.b@c.org"), (102, None), (None, "no id")]
    plain = table(spark, rows)
    wide = plain.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, " ".join(rows[7][1].split()[:30]) or "a b c d e")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for f in (
        lambda d: pii.spans(d).select("doc_id", "pii_base", "pii_added"),
        lambda d: pii.redact(d).select("doc_id", "text"),
        lambda d: bpe.encode(d, bpe.default_vocabulary()),
        lambda d: bpe.encode(d, bpe.default_vocabulary(), keep=True).select("doc_id", "ids"),
        lambda d: quality_rules.ledger(d),
        lambda d: jaccard.near_duplicates(d),
        lambda d: suffix_dedup.remove_repeats(d),
        lambda d: decontaminate.contaminated(d, items),
        lambda d: importance.fit(d, labels)[1],
        *[lambda d, stage=stage: stage(spark, d, str(tmp_path)).select("doc_id", "text") for _, stage in corpus_pipeline.STAGES],
    ):
        assert sorted(map(repr, map(tuple, f(wide).collect()))) == sorted(map(repr, map(tuple, f(plain).collect())))
    for stage in dict(corpus_pipeline.STAGES[:4]).values():
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns and all(x[c] == f"clash {c}" for x in out.collect() for c in CLASHES)


def test_custom_template(spark):
    """Control strings come from the template that is used; one that can't be read back is an error."""
    own = chat.Template(roles={"u": ("<|u|>", "<|e|>", False), "a": ("<|a|>", "<|e|>", True)}, other=("<|o|>", "<|t|>", "<|e|>"), moves={"start": {"u": "u"}, "u": {"a": "a"}}, accepting=("a",))
    said = [(1, 0, "u", "x <|e|><|a|> y"), (1, 1, "a", "<|u|>\\<|e|"), (1, 2, "tool", "<|t|> [INST]")]
    df = spark.createDataFrame(said, "conv_id long, turn int, role string, text string")
    got = chat.format_chats(df, own).select(chat.parse_chat(F.col("formatted"), own).alias("p")).first().p
    assert [(x.role, x.text) for x in got] == [(x[2], x[3]) for x in said]
    for bad in ("aa", " ", "x", "\\n"):
        with pytest.raises(ValueError):
            chat.format_chats(df, chat.Template(roles={"u": ("<|u|>", bad, False)}))


def test_chats_of_nothing(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_long_benchmark_items(spark):
    """An item of 20,000 words, found whole with a few changes; counters of SimHash go beyond 16,383 shingles."""
    r = random.Random(41)
    words = [f"w{r.randrange(10**6)}" for _ in range(20000)]
    near = list(words)
    for k in range(0, 20000, 400):
        near[k] = "changed"
    rows = [(1, "before it " + " ".join(near) + " and after"), (2, " ".join(f"v{r.randrange(10**6)}" for _ in range(20000)))]
    items = spark.createDataFrame([(0, " ".join(words)), (1, None)], "item_id long, text string")
    got = decontaminate.contaminated(table(spark, rows), items).collect()
    assert [(x.doc_id, x.item_id) for x in got] == [(1, 0)] and got[0].similarity > 0.95 and got[0].distance <= decontaminate.RADIUS


def test_added_personal_data(spark):
    """What the trees add, and what they leave, in forms and contexts of their own."""
    yes = {"call me at 020 7946 0958 now": "phone", "mail jane [at] example [dot] com please": "email", "iban: GB82 WEST 1234 5698 7654 32 ok": "iban", 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" x': "secret", "host 2001:db8::ff00:42:8329 up": "ip", "ssn 123-45-6789": "id"}
    no = ["order 123-45-6789", "commit f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "part number GB82 WEST 1234 5698 7654 33", "at 12:30:45 and so on", "a dot on the map"]
    rows = [(i, t) for i, t in enumerate([*yes, *no])]
    got = {x.doc_id: [s.kind for s in x.pii_added] for x in pii.spans(table(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [[k] for k in yes.values()] + [[]] * len(no)


def test_digest_columns(spark, tmp_path):
    """op1's digests of spans, from the registered query."""
    rows = [(1, "a.b@c.org or 1.2.3.4, +1 (555) 123-4567 and 4111 1111 1111 1111"), (2, None), (3, "")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in pii.op1_pii(spark, f"file://{tmp_path}").collect()}
    for i, t in rows:
        want = ",".join(base_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(got[i].spans.split(","))
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
