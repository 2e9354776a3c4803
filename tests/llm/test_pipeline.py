"""The pipeline's stages on a small folder of tables, and run() as a whole."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import changed, prose


def tables(spark, folder):
    rng = random.Random(21)
    items = [(k, prose(30, rng)) for k in range(5)]
    rows, labels = [], []
    for i in range(600):
        text, toxic = prose(50, rng), i % 5 == 0
        if toxic:
            words = text.split()
            for at in rng.sample(range(50), 6):
                words[at] = rng.choice(["idiot", "moron", "scum"])
            text = " ".join(words)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    base = prose(100, rng)
    near = [(1000 + k, base if k < 3 else changed(base, 1, rng), "en", "src0", 0) for k in range(8)]
    leaks = [(2000 + k, f"{prose(20, rng)} {t} {prose(20, rng)}", "en", "src1", 0) for k, t in items]
    private = [(3000 + k, f"{prose(20, rng)} mail a{k}@b.co {prose(20, rng)}", "en", None, 0) for k in range(4)]
    odd = [(4000, None, None, None, None), (4001, "", "en", "src2", 0), (None, prose(40, rng), "en", "src2", 0), (4002, prose(30, rng), "en", "src2", 0)]
    rows += near + leaks + private + odd + [odd[-1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    plain = {i for i in range(600) if i % 5} | set(range(3000, 3004)) | {4000, 4001, 4002, None}
    assert sum(i is not None and i < 600 and i % 5 == 0 for i in ids["toxicity"]) <= 3 and plain <= set(ids["toxicity"])
    assert [i for i in ids["ngram_jaccard"] if i and 1000 <= i < 2000] == [1000] and ids["ngram_jaccard"].count(4002) == 1 and plain <= set(ids["ngram_jaccard"])
    assert not [i for i in ids["decontamination"] if i and 2000 <= i < 3000] and plain <= set(ids["decontamination"])
    assert len(kept["pii"]) == len(kept["decontamination"])
    texts = {r.doc_id: r.text for r in kept["pii"]}
    assert all("<email>" in texts[i] and "@" not in texts[i] for i in range(3000, 3004)) and texts[4000] is None
    last = kept["mixing"]
    assert all(r.copies in (1, 2) and r.taken == r.copies * r["size"] for r in last)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id or -1, r.copies) for r in whole.collect()) == sorted((r.doc_id or -1, r.copies) for r in last)
    assert whole.groupBy("source").agg(F.sum("taken")).count() == len({r.source for r in last})


def test_decisions_name_rows(spark, tmp_path):
    """Rows without an id and rows that share one are judged by themselves."""
    rng = random.Random(22)
    items = [(1, prose(30, rng))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base, other = prose(60, rng), prose(60, rng)
    rows = [(None, items[0][1]), (7, items[0][1]), (7, other), (8, base), (8, other + " more"), (9, base), (None, base), (None, None), (None, None), (10, None), (11, prose(40, rng)), (11, prose(40, rng))]
    docs = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row string, n int")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(r.n for r in left) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    left = corpus_pipeline.drop_near_duplicates(spark, docs.where("n >= 2"), str(tmp_path))
    assert left.columns == docs.columns
    kept = sorted(r.n for r in left.collect())
    assert kept in ([2, 3, 7, 9, 10, 11], [2, 3, 8, 9, 10, 11])  # of two equal rows either
