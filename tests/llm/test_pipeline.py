import random
from collections import Counter

import corpus_pipeline
from codeweave.llm import mixing, packing


def corpus(spark, folder):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "io", "un", "or")]
    word = lambda: "".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for k in range(240):
        words = [word() for _ in range(rng.randint(120, 300))]
        if k % 6 == 5:
            words = [w + "###" for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 6 != 5), 0))
    for k in range(0, 40, 4):  # near copies: a few words changed, and exact ones
        words = docs[k][1].split()
        words[50] = "changed"
        docs += [(1000 + k, " ".join(words)), (2000 + k, docs[k][1])]
    docs += [(3000, None), (3001, "too short"), (None, "too short"), (None, None), (None, " ".join(word() for _ in range(150))), (8, docs[8][1])]
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(docs)


def test_stages(spark, tmp_path):
    texts = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(Counter(r.doc_id for r in docs.collect()))
    classified, ruled, unique, mixed, packed = seen
    good = {i for i, t in texts.items() if i is None or t and "###" not in t and len(t.split()) > 10}
    assert set(ruled) == good and ruled[None] == 1 and ruled[8] == 2 and good <= set(classified) and not any("###" in (texts[i] or "") for i in classified)
    assert set(unique) == {i for i in good if i is None or i < 1000} and max(unique.values()) == 1
    words = {i: len(texts[i].split()) for i in unique}
    again = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/out2")).collect()}
    assert mixed == Counter({i: c * unique[i] for i, c in again.items() if c})
    pieces = docs.collect()
    assert sum(r.length for r in pieces) == sum(words[i] * c for i, c in mixed.items())
    assert max(r.offset + r.length - r.capacity for r in pieces) <= 0 and {r.capacity for r in pieces} <= set(packing.LENGTHS)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces))
