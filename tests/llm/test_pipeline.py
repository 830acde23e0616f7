"""The pipeline's stages, each on its own input, against plain versions."""

import numpy as np

import corpus_pipeline
from evidentia.llm import mixing, pii, quality_rules
from evidentia.llm.common import WordHashes, shingles


def test_stages_and_run(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(vocabulary, 80)), "en", f"s{i % 2}", 0))
    for i in range(60, 80):  # copies and near copies
        text = rows[i - 60][1].split()
        text[int(rng.integers(80))] = "other"
        rows.append((i, " ".join(text), "en", "s0", 0))
    rows += [(90, "short", "en", "s0", 0), (91, rows[30][1] + " mail me at a.b@c.org", "en", "s1", 0), (92, None, None, None, None), (5, rows[5][1], "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), check in zip(corpus_pipeline.STAGES, (quality, near, private, mixed, packed), strict=True):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or out.columns == docs.columns
        check(docs.collect(), out.collect(), docs)
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def quality(before, after, docs):
    kept = {r.doc_id for r in quality_rules.assess(docs).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and 90 not in kept and 92 not in kept and 1 in kept


def near(before, after, docs):
    hashes = WordHashes()
    sets = {(r.doc_id, r.text): set(shingles(r.text, hashes).tolist()) for r in before}
    keys = sorted(sets)
    group = {k: k for k in keys}
    for _ in keys:
        for a in keys:
            for b in keys:
                if group[a] != group[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                    group[a] = group[b] = min(group[a], group[b])
    assert sorted((r.doc_id, r.text) for r in after) == sorted(set(group.values()))


def private(before, after, docs):
    assert len(before) == len(after) and not any("a.b@c.org" in r.text for r in after)
    spans = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after if not spans[r.doc_id])


def mixed(before, after, docs):
    want = sorted(r.doc_id for r in mixing.mix(docs).collect())
    assert sorted(r.doc_id for r in after) == want and {r.doc_id for r in after} <= {r.doc_id for r in before}


def packed(before, after, docs):
    assert len(after) >= len(before) and sum(r.length for r in after) > 0
    fill = {}
    for r in after:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096
