"""JSON arrays read by splits, against the whole documents."""

import json
import random

import pytest

from scoutgrid.operators.slices import SLICE
from scoutgrid.sources import readers


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return "".join(rng.choice('ab "\\{}[],:\n\té}') for _ in range(rng.randrange(9)))
    if kind < 5:
        return [rng.randrange(100), rng.random() < 0.5, None][kind - 2]
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{rng.choice('{}]x')}{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def elements(document):
    items = document if isinstance(document, list) else [document]
    return [x if isinstance(x, dict) else None for x in items]


def read(spark, path):
    rows = readers.read_json_objects(spark, path, "array").orderBy("source_path", "source_index").collect()
    assert len({(r["source_path"], r["source_index"]) for r in rows}) == len(rows)
    out = {}
    for r in rows:
        out.setdefault(r["source_path"].rsplit("/", 1)[1], []).append(None if r["value"] is None else json.loads(r["value"]))
    return out


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_split_reader_equals_whole_documents(spark, tmp_path, split):
    rng = random.Random(split)
    documents = {f"d{i}.json": [value(rng) for _ in range(rng.randrange(25))] for i in range(6)}
    documents |= {"empty.json": [], "numbers.json": [1, "}", [2]], "mixed.json": [1, {"a": {"b": [{}]}}, "x", [{"c": 1}], {"d": "\\"}, None], "one.json": {"a": {"b": "}"}}, "bare.json": {}}
    for i, (name, document) in enumerate(documents.items()):
        text = json.dumps(document, ensure_ascii=False, indent=[None, 1][i % 2])
        (tmp_path / name).write_text(["", "\ufeff"][i % 3 == 0] + text + ["", "\n"][i % 2], encoding="utf-8")
    (tmp_path / "blank.json").write_text(" \n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        tasks = spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions()
        assert tasks > 20 if split == 40 else tasks <= len(documents) + 1
        got = read(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {name: elements(d) for name, d in documents.items() if elements(d)}


def test_bad_chunks_are_null_elements(spark):
    text = '[{"a":1},{bad},{"b":2}, nope, {"c":3}]'
    pieces = [("f", n // 2, n, v) for n, v in enumerate(text.split("}"))]
    got = readers.array_elements(spark.createDataFrame(pieces, f"source_path string, {SLICE} bigint, source_index bigint, value string")).orderBy("source_index").collect()
    assert [r["value"] for r in got] == ['{"a":1}', None, '{"b":2}', None]
    assert readers.array_elements(spark.createDataFrame([], f"source_path string, {SLICE} bigint, source_index bigint, value string")).count() == 0
