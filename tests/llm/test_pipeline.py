import random
from collections import Counter

import corpus_pipeline
from spanlake.llm.quality_classifier import quality_scores

from .test_line_dedup import plain_dedup
from .test_pairs import plain_near
from .test_scores import corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_a_plain_version(spark, documents, tmp_path):
    docs = corpus()
    docs += [(500, docs[3][1], "xx", "s"), (501, docs[4][1].replace("an", "en", 1), "xx", "t"), (502, docs[5][1] + "\n" + docs[6][1], "xx", "t"), (503, None, "xx", "t"), (504, "", None, None)]
    documents(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d < 200), 0) for d, *_ in docs if d < 300], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage-{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        assert k == 4 or now.columns == COLUMNS
        seen.append(now.collect())
    good, lines, near, mixed, packed = seen
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    accepted = {r.doc_id for r in quality_scores(frame, labels).collect() if r.predicted}
    assert {r.doc_id for r in good} == accepted and len([d for d in accepted if d < 200]) >= 150
    assert sorted((r.doc_id, r.text or "") for r in lines) == sorted((d, t or "") for d, t, _ in plain_dedup([(r.doc_id, r.text) for r in good]))
    assert all(r.text is None or r.n_chars == len(r.text) for r in lines)
    _, groups = plain_near([(r.doc_id, r.text) for r in lines])
    assert sorted(r.doc_id for r in near) == sorted(set(groups.values()))
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in near}
    total = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(total(mixed) - 1.5 * total(near)) < 0.1 * total(near) and total(packed) == total(mixed)


def test_near_copies_of_similarity_between_80_and_85_percent_go(spark, documents):
    rng = random.Random(6)
    docs, pairs = [], []
    for k in range(40):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(220)]
        copy = list(base)
        for at in (30, 80, 130, 180):
            copy[at] = "other"
        shingles = [{tuple(x[i:i + 5]) for i in range(216)} for x in (base, copy)]
        assert 0.80 < len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) < 0.85
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, documents(docs), "").collect()) == list(range(0, 80, 2))
