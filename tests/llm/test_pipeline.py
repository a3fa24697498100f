"""The stages one after the other, each held against its operator's rule."""

import random
import time

import numpy as np

import corpus_pipeline
from basaltine.llm import decontaminate, mixing, neardup


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], data).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert out.count() > 0
        seen.append(out)
    toxic, near, clean, mix, shard = seen[1:]
    groups = neardup.groups(toxic)
    assert near.count() == groups.where("kept").count()
    assert decontaminate.contaminated(clean, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    assert mix.count() == sum(r.copies for r in mixing.copies(clean).collect())
    assert shard.count() == mix.count() and shard.where("shard IS NULL").count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_near_duplicates_move_texts_of_alike_documents_only(spark, data, monkeypatch):
    """The second stage, with full counters: documents with one passage in common stay where they are."""
    rnd = random.Random(6)
    prose = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage = prose(24)
    texts = [f"{prose(90)} {passage} {prose(90)}" for _ in range(12)]
    rows = [(i, t, "en") for i, t in enumerate([*texts, texts[7] + " more"])]
    gathered, packed = set(), neardup.packed_texts

    def noted(documents, ids):
        gathered.update(r.doc for r in ids.select("doc").collect())
        return packed(documents, ids)

    monkeypatch.setattr(neardup, "rarity", lambda reps: np.zeros(neardup.COUNTERS, np.uint8))
    monkeypatch.setattr(neardup, "packed_texts", noted)
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), data)
    assert sorted(map(tuple, out.collect())) == rows[:12]
    assert gathered == {7, 12}


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (blocks.apply(k).getName() for k in range(blocks.size())) if name.startswith("shuffle_")}


def test_near_duplicates_leave_no_shuffle_files(spark, data):
    """The second stage's steps release their disk at once, and the session's setting stays as it was."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs, before, held = spark.read.parquet(f"{data}/documents.parquet"), _shuffle_files(spark), spark.conf.get(setting)
    stage = corpus_pipeline.drop_near_duplicates(spark, docs, data)
    for _ in range(20):  # files go a moment after their action
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    assert not left and spark.conf.get(setting) == held
    assert stage.count() == neardup.groups(docs).where("kept").count()


def test_near_duplicates_drop_rows_in_place(spark, data, monkeypatch):
    """The second stage moves no row of a dropped document, and of kept ones those of a repeated id and those that a small filter lets through."""
    rnd = random.Random(7)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate([*texts, *texts[:40], *texts[:40]])] + [(59, texts[59], "en"), (58, "one text more of an id", "en")]
    moved, split = [], neardup._split

    def noted(documents, *filters):
        out = split(documents, *filters)
        if "text" in documents.columns:
            moved.append({r.doc_id for r in out[0].collect()})
        return out

    monkeypatch.setattr(neardup, "_split", noted)
    want = sorted(rows[:60] + rows[-1:])
    for bits in (26, 8):
        monkeypatch.setattr(neardup, "FILTER_BITS", bits)
        out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), data)
        assert sorted(map(tuple, out.collect())) == want
    assert moved[0] == {58, 59} and {58, 59} <= moved[1]
