"""The pipeline, stage by stage, against plain Python."""

import re

import numpy as np
import pytest

import corpus_pipeline
from gleaner.llm import line_crf

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, key string"
TOKEN = r"[^\x20\x09-\x0D]+"


def _rows():
    draw = np.random.default_rng(11)
    words = [f"w{i}" for i in range(600)]
    say = lambda n: " ".join(draw.choice(words, n))
    passage = say(45)
    good = [f"{say(70)}\n{say(60)}" for _ in range(14)]
    bad = [" ".join(draw.choice(["$$", "buy", "NOW", "%%", "click"], 60)) for _ in range(14)]
    changed = good[0].split(" ")
    changed[80] = "other"
    texts = [*good, *bad, good[0], " ".join(changed), f"{say(30)} {passage} {say(25)}", f"{passage} {say(50)} ann.lee@example.org"]
    return [*enumerate(texts), (100, None), (101, ""), (102, " \n "), (30, texts[30])]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = _rows()
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), "extra") for i, t in rows], DOCUMENT)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(i < 14), 0) for i in range(28)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def _pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_rejects_take_effect(spark, given):
    folder, rows = given
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == corpus_pipeline.COLUMNS
    scores = line_crf.quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    chosen = {r.doc_id for r in scores if r.predicted == 1}
    assert _pairs(kept) == sorted([x for x in rows if x[0] in chosen], key=str)
    assert not {i for i, _ in _pairs(kept)} & set(range(14, 28)) and set(range(14)) <= chosen


def test_one_near_copy_stays(spark, given):
    folder, rows = given
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def shingles(text):
        words = re.findall(TOKEN, (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in rows}
    gone = {
        j for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    assert {28, 29} <= gone
    assert _pairs(corpus_pipeline.near_duplicates(spark, docs, folder)) == sorted([x for x in rows if x[0] not in gone], key=str)


def test_repeated_passages_go(spark, given):
    folder, rows = given
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, want = set(), []
    for i, text in sorted(set(rows), key=lambda x: x[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(data[at : at + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g).decode()
        want += [(i, kept)] * rows.count((i, text))
    found = corpus_pipeline.repeated_passages(spark, docs, folder)
    assert found.columns == corpus_pipeline.COLUMNS
    assert _pairs(found) == sorted(want, key=str)


def test_whole_run(spark, given):
    folder, _ = given
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, folder)
    cut = before.collect()
    assert not any("ann.lee" in (r.text or "") for r in cut)
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in cut}
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in found) == sorted(
        (r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows.collect()
    )
    filled = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
