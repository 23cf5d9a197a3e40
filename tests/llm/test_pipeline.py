"""The pipeline's stages on a small corpus, each against what was planted in it."""

import random

import pytest

import corpus_pipeline
from sheetwise.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('corpus')}"
    r = random.Random(21)
    word = lambda: "".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(30), text(120)
    docs = {i: text(r.randrange(40, 160)) for i in range(200)}
    bad = set(range(0, 200, 8))
    for i in bad:
        docs[i] = " ".join(f"*{r.randrange(9)}*" for _ in range(80))
    docs[301], docs[302], docs[303] = base, base + " end", base.upper()
    docs[310] = text(30) + " " + passage + " " + text(30)
    docs[320] = text(40) + " write a.b@c.org or +1 (555) 123-4567 " + text(20)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (1, docs[1], "en", "s", len(docs[1])), (None, "no id here", "en", "s", 10)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, passage), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, bad


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_stages(spark, corpus):
    at, docs, bad = corpus
    stages = dict(corpus_pipeline.STAGES)
    raw = spark.read.parquet(f"{at}/documents.parquet")
    good = stages["quality classifier"](spark, raw, at)
    kept = ids(good)
    assert not bad & set(kept) and len(kept) >= len(docs) - len(bad) and good.columns == raw.columns
    one = stages["near duplicates"](spark, good, at)
    assert ids(one) == sorted({*kept} - {302, 303}, key=repr)
    clean = stages["decontamination"](spark, one, at)
    assert ids(clean) == sorted({*kept} - {302, 303, 310}, key=repr)
    safe = {r.doc_id: r for r in stages["personal data"](spark, clean, at).collect()}
    assert "write [EMAIL] or [PHONE]" in safe[320].text and safe[320].n_chars == len(safe[320].text)
    assert all(safe[i].text == t for i, t in docs.items() if i in safe and i != 320)


def test_filters_decide_by_row(spark, tmp_path):
    """Clean rows that share an id with a copy or a contaminated row stay; copies and passages without an id go."""
    at, r = f"file://{tmp_path}", random.Random(22)
    text = lambda n: " ".join(f"w{r.randrange(9999)}" for _ in range(n))
    base, passage, clean = text(80), text(30), [text(60) for _ in range(3)]
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    rows = [(-5, base), (7, base + " end"), (7, clean[0]), (None, base + " more"), (None, clean[1]), (8, clean[2]), (8, text(20) + " " + passage), (None, text(9) + " " + passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["near duplicates"](spark, docs, at)
    assert one.columns == docs.columns and sorted(x.text for x in one.collect()) == sorted(t for k, (_, t) in enumerate(rows) if k not in (1, 3))
    two = stages["decontamination"](spark, one, at)
    assert two.columns == docs.columns and sorted(x.text for x in two.collect()) == sorted([base, *clean])


def test_run(spark, corpus):
    at, _, _ = corpus
    out = corpus_pipeline.run(spark, at).collect()
    plain = bpe.WordBPE(bpe.default_vocabulary())
    assert len(out) > 150 and all(list(r.ids) == plain.encode(r.text or "") for r in out)


def test_nothing(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
