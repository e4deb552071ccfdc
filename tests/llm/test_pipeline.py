import brute
from helixframe.llm.tokens import public_path


def plain(rows, items):
    """Documents left after the first four stages: doc_id to words."""
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    classes = {i: c for i, _, c in brute.op7(rows)}
    rows = [(i, t) for i, t in rows if i is None or classes[i] == i]
    seqs = [(i, brute.words(t)) for i, t in rows]
    kept = []
    for (i, s), marks in zip(seqs, brute.covered(seqs, 50), strict=True):
        left = [w for w, m in zip(s, marks, strict=True) if not m]
        if left or not any(marks):
            kept.append((i, " ".join(left)))
    leaks = {i for i, _, _ in brute.op4(kept, items)}
    return {i: t.split() for i, t in kept if i not in leaks}


def test_stages_equal_plain_versions(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{src}/documents.parquet").limit(150)
    data.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{src}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in data.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    left = {r["doc_id"]: brute.words(r["text"]) for r in docs.collect()}
    assert left == plain(rows, items)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").collect()} == set(left)


def test_stages_take_odd_rows_and_clashing_columns(spark, docs, none):
    import corpus_pipeline

    for table in (docs, none):
        current = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, "/root/testdata/sf0.001")
            assert current.columns == table.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, current, "").count() >= current.count()
    assert public_path("word_bpe_49k.json")


def test_texts_under_one_doc_id_are_judged_apart(spark):
    import random

    import corpus_pipeline
    from conftest import frame, prose

    p, q, r, s, t = (" ".join(prose(random.Random(k), 60)) for k in range(5))
    rows = [(1, p), (1, q), (2, q + " end"), (3, p), (4, t), (4, t), (0, r), (5, r), (5, s), (None, p), (6, None), (6, "")]
    made = frame(spark, rows)
    got = corpus_pipeline.near_duplicates(spark, made.repartition(3), "")
    assert got.columns == made.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted([(1, p), (1, q), (4, t), (0, r), (5, s), (None, p), (6, got.where("doc_id = 6").first()["text"])], key=str)
    assert got.where("doc_id = 4").first() == min((x for x in made.where("doc_id = 4").collect()), key=lambda x: x["lang"] or "~")
