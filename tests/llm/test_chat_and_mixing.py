import random

from pyspark.sql import functions as F

from scoutgrid.llm import chat, mixing


def tree(spark, rows):
    return spark.createDataFrame(rows, "id long, parent long, role string, text string, score double").withColumn("depth", F.lit(9)).withColumn("root", F.lit(9))


def test_best_branches_of_a_tree(spark):
    rows = [(1, None, "user", "q", 0.0), (2, 1, "assistant", "bad", -1.0), (3, 1, "assistant", "good <|im_end|>\\e [x]", 2.0), (4, 3, "user", None, 0.5),
            (5, 3, "user", "more", 1.0), (6, 99, None, "alone\n", None), (7, 8, "user", "loop", 9.0), (8, 7, "user", "loop", 9.0)]
    got = {(r["root"], r["rank"]): r for r in chat.read_back(chat.conversations(tree(spark, rows), per_root=2)).collect()}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert turns == {(1, 1): [("user", "q"), ("assistant", "good <|im_end|>\\e [x]"), ("user", "more")],
                     (1, 2): [("user", "q"), ("assistant", "good <|im_end|>\\e [x]"), ("user", "")], (6, 1): [("", "alone\n")]}
    assert got[1, 1]["loss_texts"] == ["good <|im_end|>\\e [x]"]
    assert chat.conversations(tree(spark, rows).limit(0)).count() == 0


def test_mask_covers_the_escaped_text(spark):
    rows = [(1, None, "user", "é[a]", 0.0), (2, 1, "assistant", "b<c\\", 0.0), (3, 2, "assistant", "", 0.0)]
    r = chat.conversations(tree(spark, rows)).first()
    assert [r["formatted"][m["start"]:m["end"]] for m in r["loss_mask"]] == ["b\\lc\\e", ""]
    assert r["formatted"].count("[") == 0 and r["formatted"].count("<|im_start|>") == 3


def test_long_chains_and_logs(spark):
    rows = [("a" if i % 3 else None, i // 2, "user", f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r["root"]["key"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.conversations(chat.chained(df, "conv_id", "turn"))).collect()}
    for key in ("a", None):
        assert got[key] == [t for _, _, t in sorted((turn, role, text) for k, turn, role, text in rows if k == key)]


def quotients(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if votes[i] > 0), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_quotas_are_highest_quotients(spark):
    rng = random.Random(3)
    groups = [(g, [rng.choice((0, 1, 5, 5, 40, rng.random() * 100)) for _ in range(7)], rng.randrange(0, 60)) for g in range(30)]
    rows = [(g, i, float(v), seats) for g, votes, seats in groups if any(votes) for i, v in enumerate(votes)]
    got = mixing.apportioned(spark.createDataFrame(rows, "g long, i long, v double, s long"), "v", "s", ["g"], ["i"]).collect()
    want = {(g, i): q for g, votes, seats in groups if any(votes) for i, q in enumerate(quotients(votes, seats))}
    assert {(r["g"], r["i"]): r["quota"] for r in got} == want


def filled(sizes, weights, times):
    target, full, total = {}, set(), sum(sizes)
    while True:
        left, w = total - sum(times * sizes[i] for i in full), sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = {i: times * sizes[i] if i in full else left * weights[i] / w for i in range(len(sizes))}
        over = {i for i in target if i not in full and target[i] > times * sizes[i]}
        if not over:
            return target
        full |= over


def test_targets_and_taken_words(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["s1", "s1", "s1", "s1", "s2", "S3", "tiny", None]), " ".join(["w"] * rng.randrange(0, 300))) for i in range(600)]
    rows = [r for r in rows if r[1] != "tiny" or r[0] < 60] + [(1007, "s2", None), (1008, "s2", "same words"), (1008, "s2", "same words")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x"))
    got = mixing.mixed(docs, shard_words=5000).collect()
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None]
    size = {s: sum(len((t or "").split()) for _, u, t in rows if u == s) for s in names}
    want = filled([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    of = {i: s for i, s, _ in rows}
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for i, s in enumerate(names):
        mine = [r for r in got if of[r["key"]] == s]
        assert abs(mine[0]["target"] - want[i]) < 1e-6 and mine[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in mine) - want[i]) <= 32 * 10
    again = mixing.mixed(docs.repartition(5), shard_words=5000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    kept = mixing.mix(docs)
    assert kept.columns == ["doc_id", "source", "text", "size", "source_size", "target", "taken"]
    assert kept.agg(F.sum("taken")).first()[0] == sum(r["taken"] for r in mixing.mixed(docs).collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_loss_texts_are_cut_by_the_mask(spark):
    """A shifted mask reads other text; signs outside the basic plane count as one."""
    rows = [(1, None, "user", "q\U0001f600", 0.0), (2, 1, "assistant", "\U0001f600b<c\\ [é", 0.0), (3, 2, "user", "x", 0.0), (4, 3, "assistant", "end", 0.0)]
    made = chat.conversations(tree(spark, rows))
    assert chat.read_back(made).first()["loss_texts"] == ["\U0001f600b<c\\ [é", "end"]
    shifted = made.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.struct(m["turn"].alias("turn"), (m["start"] + 1).alias("start"), (m["end"] + 1).alias("end"))))
    assert chat.read_back(shifted).first()["loss_texts"] != ["\U0001f600b<c\\ [é", "end"]


def test_hot_source_of_blank_and_equal_rows(spark):
    """A third of all rows blank, a third equal, all of one source: blank ones lie on no line, equal ones share a stretch."""
    rows = [(i, "hot", None if i % 2 else " \n") for i in range(300)] + [(5000, "hot", "same three words")] * 300 + [(1000 + i, f"s{i % 3}", "w " * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs, shard_words=400, block_words=4).collect()
    assert len(got) == len(rows)
    hot = [r for r in got if r["key"] == 5000]
    assert len(hot) == 300 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert max(r["taken"] for r in hot) <= 9 and abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 40
    assert len({r["source_size"] for r in got if r["key"] in (5000, 1)}) == 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(docs.repartition(7), shard_words=400, block_words=4).collect()))
