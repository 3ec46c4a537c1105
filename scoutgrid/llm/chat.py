"""Reply trees: iterative self-joins find every root-to-leaf path, the best branches become formatted conversations.

The self-joins double their reach each round (parent, grandparent, four up, ...), so that a path of
depth d takes log2(d) rounds; a node carries its depth and the score summed up to its root, never the path itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scoutgrid.session import cut_lineage

# Fixed values of the template. Control strings start with "<" or "["; neither sign is left in an escaped text.
START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escaped(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From (id, parent, score): (id, root, depth, total) per node, and the tables (id, up) of the ancestors 1, 2, 4, ... up.

    A parent that is null or not among the nodes makes a root. Nodes of a cycle have no root and are left out.
    """
    known = nodes.select(F.col("id").alias("up"), F.lit(True).alias("found"))
    state = cut_lineage(nodes.join(known, nodes["parent"] == known["up"], "left").select(
        "id", F.when(F.col("found"), F.col("parent")).alias("up"), F.col("id").alias("root"), F.lit(1).alias("depth"), "score"))
    ups, before = [], None
    while True:
        open_ = state.where("up is not null")
        left = open_.count()
        if left == 0 or left == before and _only_cycles(state):
            break
        ups.append(open_.select("id", "up"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"),
                             F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        further = open_.join(above, "up").select(
            "id", F.col("up2").alias("up"), F.col("root2").alias("root"),
            (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score"))
        state = cut_lineage(state.where("up is null").unionByName(further))
        before = left
    return state.where("up is null").select("id", "root", "depth", F.col("score").alias("total")), ups


def _only_cycles(state: DataFrame) -> bool:
    """No open node's pointer reaches a finished one: whatever is still open runs in circles."""
    done = state.where("up is null").select(F.col("id").alias("up"))
    return state.where("up is not null").join(done, "up", "left_semi").isEmpty()


def branches(nodes: DataFrame, per_root: int = 1) -> DataFrame:
    """The ``per_root`` best root-to-leaf paths: (root, leaf, rank, id, depth), one row per node of a path.

    Ranked by the mean score along the path, then the longer path, then the smaller leaf id.
    """
    paths, ups = climbed(nodes)
    inner = nodes.select(F.col("parent").alias("id")).where("id is not null").distinct()
    order = Window.partitionBy("root").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "id")
    chosen = cut_lineage(paths.join(inner, "id", "left_anti").withColumn("rank", F.row_number().over(order))
                         .where(F.col("rank") <= per_root).select("root", F.col("id").alias("leaf"), "rank", "id"))
    for up in reversed(ups):
        chosen = cut_lineage(chosen.unionByName(chosen.join(up, "id").select("root", "leaf", "rank", F.col("up").alias("id"))))
    return chosen.join(paths.select("id", "depth"), "id")


def formatted(turns: DataFrame, by: list[str], loss_roles=("assistant",)) -> DataFrame:
    """One conversation per key from rows (``by``, depth, role, text): ``formatted`` and ``loss_mask``.

    Each turn is ``<|im_start|>role``, a line break, the escaped text and ``<|im_end|>`` with a line break. The mask lists (turn,
    start, end) of every text of a loss role, in code points, end exclusive. Null roles and texts count as empty.
    A conversation is one output row, so it is the unit that must fit a task.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    parts = turns.select(*by, "depth", F.concat(F.lit(START), role, F.lit(BREAK)).alias("head"), body.alias("body"),
                         F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"))
    size = F.length("head") + F.length("body") + len(END)
    upto = F.sum(size).over(Window.partitionBy(*by).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.select(*by, "depth", F.concat("head", "body", F.lit(END)).alias("chunk"), "loss",
                          (upto - len(END) - F.length("body")).alias("start"), (upto - len(END)).alias("end"))
    rows = placed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("depth", "chunk", "loss", "start", "end"))).alias("rows"))
    mask = F.filter(F.transform("rows", lambda x, i: F.struct(
        i.alias("turn"), x["start"].alias("start"), x["end"].alias("end"), x["loss"].alias("loss"))), lambda x: x["loss"])
    return rows.select(*by, F.array_join(F.transform("rows", lambda x: x["chunk"]), "").alias("formatted"),
                       F.transform(mask, lambda x: x.dropFields("loss")).alias("loss_mask"))


def read_back(conversations: DataFrame) -> DataFrame:
    """``turns`` (role, text) of ``formatted``, and ``loss_texts``: what ``formatted`` has between the start and the end of each
    entry of ``loss_mask``; both unescaped.

    The text is laid out in four bytes a code point, so that a cut costs its own length wherever it lies.
    """
    rest = [c for c in conversations.columns if c != "formatted"]
    bodies = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda s: s != "")
    wide = F.array(F.encode("formatted", "UTF-32"))  # an element of an array is worked out once for all cuts
    pieces = F.transform(wide, lambda w: F.transform("loss_mask", lambda m: F.decode(
        F.substring(w, (4 * m["start"] + 1).cast("int"), (4 * (m["end"] - m["start"])).cast("int")), "UTF-32")))
    cut = conversations.select(*rest, F.get(pieces, F.lit(0)).alias("pieces"), F.transform(bodies, lambda s: F.struct(
        F.substring_index(s, BREAK, 1).alias("head"),
        F.substring(s, F.locate(BREAK, s) + 1, F.length(s) - F.locate(BREAK, s) - len(END)).alias("body"))).alias("cut"))
    role = lambda s: unescaped(F.replace(s, F.lit("\\n"), F.lit("\n")))
    return cut.select(
        *rest, F.transform("cut", lambda x: F.struct(role(x["head"]).alias("role"), unescaped(x["body"]).alias("text"))).alias("turns"),
        F.transform("pieces", unescaped).alias("loss_texts"))


def conversations(messages: DataFrame, per_root: int = 1, loss_roles=("assistant",)) -> DataFrame:
    """Format the best branches of message trees: (root, rank, formatted, loss_mask).

    ``messages`` has id, parent, role, text, score; ids are unique and not null, null scores count as 0. Texts
    travel only once, with the chosen paths. Extra columns are ignored; an empty table gives no conversations.
    """
    nodes = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    paths = branches(cut_lineage(nodes), per_root)
    turns = paths.join(messages.select("id", "role", "text"), "id").select("root", "rank", "depth", "role", "text")
    return formatted(turns, ["root", "rank"], loss_roles)


def chained(rows: DataFrame, key: str, turn: str) -> DataFrame:
    """A linear log as reply trees: each row answers the one before it; equal or null turns are ordered by role and text."""
    order = Window.partitionBy(key).orderBy(F.col(turn).asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    at = rows.select(F.col(key).alias("key"), "role", "text", F.row_number().over(order).alias("at"))
    return at.select(F.struct("key", "at").alias("id"), F.when(F.col("at") > 1, F.struct("key", (F.col("at") - 1).alias("at"))).alias("parent"),
                     "role", "text", F.lit(0.0).alias("score"))
