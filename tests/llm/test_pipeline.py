"""The stages on a small folder, each against what its input demands; whole run without crashing on odd rows."""

import random

import corpus_pipeline
from brute import WORDS, jaccard_classes
from scoutgrid.llm import secret_scan

STOP = "the of and to in is that it".split()


def folder(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(STOP) if i % 3 == 0 else rng.choice(WORDS) for i in range(n))
    item = " ".join(rng.choice(WORDS) for _ in range(25))
    rows = [(i, text(rng.randrange(40, 120)), "en", f"src{i % 3}") for i in range(60)]
    base = rows[0][1].split()
    for i in range(60, 80):
        w = list(base)
        w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w), "en", "src0"))
    rows += [(80, rows[1][1], "en", "src1"), (80, rows[1][1], "en", "src1"), (81, rows[2][1] + " " + item + " " + text(20), "en", None),
             (82, text(50) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + text(10), "de", "src9"), (83, None, None, None),
             (84, "", "en", "src0"), (None, text(60), "en", "src0"), (85, "### $$$ " * 40, "en", "src0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), item


def test_stages_in_turn(spark, tmp_path):
    sf, item = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = f"{sf}/out{n}"
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[n] = docs.collect()
        if n < 4:
            assert docs.columns == columns
        if n == 0:
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in kept[0]} == {83, 84, 85}
        if n == 1:
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = {c for _, _, c, _ in jaccard_classes(rows, 5, 80)}
            assert {r["doc_id"] for r in kept[1]} == want and len(kept[1]) == len(want)
        if n == 2:
            assert {r["doc_id"] for r in kept[1]} - {r["doc_id"] for r in kept[2]} == {81}
        if n == 3:
            assert len(kept[3]) == len(kept[2]) and not any(secret_scan.base_spans(r["text"]) for r in kept[3])
            assert all(r["n_chars"] == len(r["text"]) for r in kept[3])
    assert docs.columns == [*columns, "size", "source_size", "target", "taken"]
    assert all(0 < r["taken"] <= 3 * r["size"] for r in kept[4])
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, kept[4]))


def test_empty_tables(spark, tmp_path):
    sf, _ = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
