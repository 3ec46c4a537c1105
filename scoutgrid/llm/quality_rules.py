"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scoutgrid.llm.text import once, packed, words

WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for as with was on be by this are from at or an have not they which you "
    "der die das und ist von zu den mit sich auf für im ein eine nicht auch dem des "
    "le la les et est dans qui que pour sur par au du une un il ne pas de "
    "el en y los las con para del se su al es lo como por"
).split()


@dataclass(frozen=True)
class Rule:
    """Accept a text if ``low`` % <= 100 * numerator / denominator <= ``high`` %."""

    name: str
    numerator: str
    denominator: str
    low: int
    high: int


TABLE = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", 0, 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, 100),
    Rule("lines", "n_dup_lines", "n_lines", 0, 40),
)


def spelled(stop_words) -> list[str]:
    """The list in lower case, capitalised and in capitals, so that no text has to be lowered."""
    return sorted({v for w in stop_words for v in (w, w.capitalize(), w.upper())})


def repeated_words(w: Column) -> Column:
    """Words inside windows of eight words that occur twice or more: windows by hash, sorted; covered stretches are summed."""
    last = F.size(w) - WINDOW
    # one-element arrays bind a value to a name inside the expression: it is computed once
    windows = F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), lambda hashes: F.transform(
        F.slice(hashes, F.lit(1), last + 1), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)])))

    def starts(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.array(ordered), lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["p"])))[0]

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")), lambda a, x: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), x - a["p"])).alias("n"), x.alias("p")), lambda a: a["n"])

    counted = F.transform(windows, lambda hs: F.when(
        F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(starts(hs))))[0]
    return F.when(last >= 1, counted).otherwise(F.lit(0))


def measured(docs: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """``row`` (the input row) and the counts that rules refer to. A null text counts as empty: all counts are 0."""
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    split = packed(docs, t=body, w=words(body), lines=F.filter(F.split(body, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    long = lambda c: c.cast("long")
    return split.select(
        "row",
        long(F.size("w")).alias("n_words"),
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("w"))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.filter("w", lambda x: x.isin(spelled(stop_words))))).alias("n_stop_words"))


def judged(docs: DataFrame, text: str = "text", table=TABLE, stop_words=STOP_WORDS, min_words: int = 20,
           max_repeat_percent: int = 30) -> DataFrame:
    """One row per input row: ``row``, all counts, ``base_failed``, ``failed_rules`` and ``kept``.

    Fewer than ``min_words`` words or more than ``max_repeat_percent`` % repeated words fail the base;
    every row of ``table`` that is not met is listed in ``failed_rules``. Kept are rows without either.
    Null and empty texts have no words and fail the base; repeated rows are judged alike; an empty
    table gives an empty result; the input's own columns stay inside ``row`` whatever their names.
    """
    counts = measured(docs, text, stop_words)
    names = [c for c in counts.columns if c != "row"]
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    unmet = F.array_compact(F.array(*[
        F.when((100 * F.col(r.numerator) < r.low * F.col(r.denominator)) | (100 * F.col(r.numerator) > r.high * F.col(r.denominator)),
               F.lit(r.name)) for r in table]))
    counts = once(counts, ["row"], **{n: F.col(n) for n in names})
    return counts.select("row", *names, base.alias("base_failed"), unmet.alias("failed_rules"),
                         (~base & (F.size(unmet) == 0)).alias("kept"))


def keep_clean(docs: DataFrame, **options) -> DataFrame:
    """The input rows that ``judged`` keeps, with their own columns only."""
    return judged(docs, **options).where("kept").select("row.*")
