"""Quality rules: one threshold table compiled into one Spark projection, without user functions.

Handling of odd input: a null text counts as empty (no words, base_failed). Ratios over zero words or lines are null and break
no rule. Repeated rows and repeated or null doc_ids are judged row by row. An empty table gives an empty result. Only the text
column is read; other columns, whatever their names, pass through ``annotate`` unless they clash with a name that it writes,
which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, free_name

#: Stop words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in that is was for with as at by on be it this from are or "
    "der die das und in von zu mit für auf ist nicht ein eine den des "
    "le la les de des et un une en que qui dans est pour pas du "
    "el los las de y que en un una por con para del al se"
).split()

SYMBOLS = r"[#*$%&|<>]"
_WORD_CHAR = r"[^\x20\x09-\x0D]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; a null metric or bound never breaks the rule."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. Bounds are wide on purpose: they reject junk and keep plain prose.
THRESHOLDS = (
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 2, 20),
    Rule("symbols_per_word", None, 0.1),
    Rule("dup_line_ratio", None, 0.6),
    Rule("stop_word_ratio", 0.01, None),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside a 5-word window whose content occurs twice or more.

    Windows are hashed to 64 bits. Where all differ the answer is 0; else they are sorted with their place, a window is repeated
    if a neighbour in that order has its hash, and the repeated places, in text order, cover min(5, distance to the next) words.
    """
    hashes = F.slice(
        F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)])), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))
    )

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(placed))

    return _let(hashes, count)


def _covered(ordered: Column) -> Column:
    def pick(o: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            return (F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False)))

        return F.sort_array(F.transform(F.filter(o, again), lambda x: x["i"]))

    def total(p: Column) -> Column:
        return F.coalesce(
            F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda acc, x: acc + x,
            ),
            F.lit(0),
        )

    return _let(_let(ordered, pick), total)


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once: a one-element transform binds it to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def annotate(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """``docs`` with the counts, the rule metrics, ``base_failed``, ``failed_rules`` (array of metric names) and ``kept``."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
            "mean_word_chars", "symbols_per_word", "dup_line_ratio", "stop_word_ratio", "base_failed", "failed_rules", "kept"}
    through = [c for c in docs.columns if c.lower() not in made]
    t, w, ls, c = (free_name(docs, name) for name in ("_text", "_words", "_lines", "_counts"))
    base = docs.select(*[F.col(f"`{c}`") for c in through], F.coalesce(F.col(text), F.lit("")).alias(t))
    base = base.withColumn(w, _words(F.col(t))).withColumn(ls, F.filter(F.split(t, "\n"), lambda x: x.rlike(_WORD_CHAR)))
    n = F.size(w)
    stop = list(dict.fromkeys(form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(w), n).cast("long").alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
    )
    # exploding the one struct of counts keeps them from being computed again in every rule and filter above
    counted = base.select(*[F.col(f"`{c}`") for c in through], F.explode(F.array(counts)).alias(c)).select(*[F.col(f"`{c}`") for c in through], f"{c}.*")
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    metrics = counted.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        # one stop word is granted, so that a short text without any doesn't break the rule
        "stop_word_ratio": F.try_divide(F.col("n_stop_words") + 1.0, F.col("n_words").cast("double")),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })
    broken = [F.when(_breaks(r), F.lit(r.metric)) for r in rules]
    return metrics.withColumn("failed_rules", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def _breaks(rule: Rule) -> Column:
    m = F.col(rule.metric)
    out = F.lit(False)
    if rule.low is not None:
        out = out | F.coalesce(m < F.lit(rule.low), F.lit(False))
    if rule.high is not None:
        out = out | F.coalesce(m > F.lit(rule.high), F.lit(False))
    return out
