"""Text statistics and learned decision lists over them, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import pinned

SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: What a rule may test, each a share of the text's words or characters.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over each whole text, inside its row: nothing is shuffled or exploded.

    A window of three words is known by its hash; hashes are sorted with the
    place in their low bits, and neighbours with equal hashes are compared word by
    word. Columns beside the id: n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, n_upper, n_marks, n_digits. A null text has none
    of anything. The counts are pinned: a filter on them would otherwise be pushed
    below and repeat the whole computation in its condition.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    ).select(
        "_id",
        "_text",
        F.array_remove(F.split("_text", SPACE_RUN), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_lines"),
    )
    rows = rows.select(
        "_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit("[!?|]")).cast("long").alias("n_marks"),
        F.regexp_count("_text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("_words").cast("long"))).alias("_bits"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    counts = [c for c in rows.columns if c.startswith(("n_", "word_"))]
    shift = lambda x: F.call_function("shiftleft", x, F.col("_bits"))
    back = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    windows = F.transform(
        F.col("_hashes"),
        lambda h, i: shift(F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))
        + i.cast("long"),
    )
    rows = rows.select(
        "_id",
        "_words",
        "_bits",
        *counts,
        F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))).alias("_keys"),
        (shift(F.lit(1).cast("long")) - 1).alias("_mask"),
    )
    word = lambda x, k: F.get("_words", (x.bitwiseAND(F.col("_mask")) + k).cast("int"))

    def same(x: Column, y: Column) -> Column:
        """Whether two keys, neither null, are the same window."""
        equal = back(x) == back(y)
        for k in range(3):
            equal = equal & (word(x, k) == word(y, k))
        return F.coalesce(equal, F.lit(False))

    rows = rows.select(
        "_id",
        *counts,
        F.sort_array(
            F.transform(
                F.filter(
                    "_keys",
                    lambda x, i: same(x, F.get("_keys", i + 1)) | same(x, F.get("_keys", i - 1)),
                ),
                lambda x: x.bitwiseAND(F.col("_mask")),
            )
        ).alias("_found"),
    )
    steps = F.transform(
        "_found",
        lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_found", i + 1) - x, F.lit(3).cast("long"))),
    )
    return pinned(
        rows.select(
            F.col("_id").alias(id_col),
            *counts,
            F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        )
    )


@dataclass(frozen=True)
class Test:
    """``feature >= cut`` or ``feature <= cut``; both cover the cut itself."""

    feature: str
    cut: float
    above: bool

    def on(self, value: Column) -> Column:
        return value >= self.cut if self.above else value <= self.cut

    def on_columns(self) -> Column:
        return self.on(F.col(self.feature))

    def on_values(self) -> Column:
        return self.on(F.expr(FEATURES[self.feature]))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Test, ...]

#: Shares of the bad rows cut off at either end, beside the evenly spaced quantiles.
TAILS = [2.0**-k for k in range(6, 14)]
#: Rules after which the rows they leave are stored anew.
STORED = 8


def both(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def covered(rule: Rule) -> Column:
    return both([t.on_columns() for t in rule])


def learn_rules(
    labelled: DataFrame,
    bad: str = "_bad",
    cuts: int = 49,
    max_tests: int = 3,
    precision: float = 0.9,
    least: int = 3,
) -> list[Rule]:
    """Rules for bad rows by sequential covering: grow, prune, take off what is covered.

    ``labelled`` holds the statistics and a boolean ``bad``; all its rows count.
    Two thirds of them (by a hash) grow a rule: the threshold with the best
    information gain is added while it leaves good rows in. The rest prunes it to
    the prefix with the best (bad - good) / (bad + good) and must confirm the
    ``precision``. If it does not, rules that begin with the best test of each
    other feature and side are grown together and the first that is confirmed is
    taken; learning ends when none is. As a rule takes off at least ``least`` bad
    rows, it does end.

    Thresholds are values of the bad rows a rule still covers, found anew for each
    test: ``cuts`` quantiles, finer ones at both ends, the ends, and the smallest
    above 0. A step is one aggregate for these and one into at most two sums per
    threshold and place between; only they reach the driver.
    """
    left = pinned(
        labelled.select(
            F.col(bad).alias("_bad"),
            (F.pmod(F.xxhash64(*FEATURES_INPUT), F.lit(3)) == 0).alias("_prune"),
            *[F.expr(e).cast("double").alias(name) for name, e in FEATURES.items()],
        )
    )
    rules: list[Rule] = []
    while True:
        rows, held = left.where("not _prune"), left.where("_prune")
        starts = ranked(rows, [()], cuts)[0]
        rule: Rule = ()
        for group in (starts[:1], starts[1:]):
            if group and not rule:
                rule = confirmed(held, grown(rows, group, cuts, max_tests), precision, least)
        if not rule:
            return rules
        rules.append(rule)
        left = left.where(~covered(rule))
        if len(rules) % STORED == 0:
            left = pinned(left)


FEATURES_INPUT = ("n_words", "word_chars", "n_symbols", "n_lines", "n_upper", "n_repeat_words")


def grown(rows: DataFrame, starts: list[Test], cuts: int, max_tests: int) -> list[Rule]:
    """For each start the conjunction that grows by the test of the best gain while it covers good rows."""
    rules: list[Rule] = [(test,) for test in starts]
    growing = list(range(len(rules)))
    for _ in range(max_tests - 1):
        if not growing:
            break
        found = ranked(rows, [rules[i] for i in growing], cuts)
        growing = [i for i, tests in zip(growing, found, strict=True) if tests]
        for i, test in zip(growing, [tests[0] for tests in found if tests], strict=True):
            rules[i] += (test,)
    return rules


def ranked(rows: DataFrame, rules: list[Rule], cuts: int) -> list[list[Test]]:
    """Per rule the best test of each feature and side that improves it, best first.

    A rule that covers no bad row has none, nor has one with tests and no good row.
    """
    edges = thresholds(rows, rules, cuts)
    sums = histogram(rows, rules, edges)
    out: list[list[Test]] = []
    for number, rule in enumerate(rules):
        best: dict[tuple[str, bool], tuple[float, Test]] = {}
        for name in sorted(FEATURES):
            bins = sums.get((number, name), {})
            p, n = (sum(x[i] for x in bins.values()) for i in (0, 1))
            if not p or (rule and not n):
                continue
            base = math.log2(p / (p + n))
            before = [0, 0]
            for place, cut in enumerate(edges[number, name]):
                between, at = bins.get(2 * place, (0, 0)), bins.get(2 * place + 1, (0, 0))
                before = [before[0] + between[0], before[1] + between[1]]
                upto = [before[0] + at[0], before[1] + at[1]]
                for above, (bp, bn) in ((False, upto), (True, [p - before[0], n - before[1]])):
                    if not bp:
                        continue
                    gain = bp * (math.log2(bp / (bp + bn)) - base)
                    if gain > best.get((name, above), (1e-9,))[0]:
                        best[name, above] = (gain, Test(name, cut, above))
                before = upto
        out.append([test for _, test in sorted(best.values(), key=lambda x: (-x[0], str(x[1])))])
    return out


def per_rule(rules: list[Rule], of) -> Column:
    """The structs ``of`` (number of the rule, feature) for all features of the rules that cover the row."""
    return F.explode(
        F.flatten(
            F.filter(
                F.array(*[F.when(covered(r), F.array(*[of(i, f) for f in FEATURES])) for i, r in enumerate(rules)]),
                lambda x: x.isNotNull(),
            )
        )
    )


def thresholds(rows: DataFrame, rules: list[Rule], cuts: int) -> dict[tuple[int, str], list[float]]:
    """Values of the bad rows each rule covers, by rule and feature, sorted."""
    points = sorted({0.0, 1.0, *TAILS, *[1 - x for x in TAILS], *[i / (cuts + 1) for i in range(1, cuts + 1)]})
    found = (
        rows.where("_bad")
        .select(
            per_rule(
                rules,
                lambda i, f: F.struct(F.lit(i).alias("rule"), F.lit(f).alias("feature"), F.col(f).alias("value")),
            ).alias("_at")
        )
        .groupBy("_at.rule", "_at.feature")
        .agg(
            F.percentile_approx("_at.value", points, 10_000).alias("values"),
            F.min(F.when(F.col("_at.value") > 0, F.col("_at.value"))).alias("above_zero"),
        )
        .collect()
    )
    out: dict[tuple[int, str], list[float]] = {(i, f): [] for i in range(len(rules)) for f in FEATURES}
    for r in found:
        out[r["rule"], r["feature"]] = sorted({*r["values"], r["above_zero"]} - {None})
    return out


def bin_of(value: Column, edges: list[float]) -> Column:
    """Twice the number of edges below the value, and one more if it is an edge."""
    if not edges:
        return F.lit(0)
    table = F.array(*map(F.lit, edges))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    below = F.aggregate(
        halves, F.lit(0), lambda at, x: F.when(F.get(table, at + x - 1) < value, at + x).otherwise(at)
    )
    return F.aggregate(
        F.array(below), F.lit(0), lambda _, at: 2 * at + F.when(F.get(table, at) == value, 1).otherwise(0)
    )


def histogram(
    rows: DataFrame, rules: list[Rule], edges: dict[tuple[int, str], list[float]]
) -> dict[tuple[int, str], dict[int, tuple[int, int]]]:
    """Bad and good rows per rule, feature and bin."""
    at = per_rule(
        rules,
        lambda i, f: F.struct(
            F.lit(i).alias("rule"), F.lit(f).alias("feature"), bin_of(F.col(f), edges[i, f]).alias("bin")
        ),
    )
    counted = (
        rows.select("_bad", at.alias("_at"))
        .groupBy("_at.rule", "_at.feature", "_at.bin")
        .agg(F.count_if("_bad").alias("p"), F.count_if(~F.col("_bad")).alias("n"))
    )
    out: dict[tuple[int, str], dict[int, tuple[int, int]]] = {}
    for r in counted.collect():
        out.setdefault((r["rule"], r["feature"]), {})[r["bin"]] = (r["p"], r["n"])
    return out


def confirmed(rows: DataFrame, rules: list[Rule], precision: float, least: int) -> Rule:
    """The first rule with a prefix precise enough on the pruning rows, cut to the best; else empty."""
    prefixes = [[rule[: k + 1] for k in range(len(rule))] for rule in rules]
    got = rows.agg(
        *[
            F.count_if(covered(x) & (F.col("_bad") == kind)).alias(f"{kind}{i}_{k}")
            for i, some in enumerate(prefixes)
            for k, x in enumerate(some)
            for kind in (True, False)
        ]
    ).first()
    for i, some in enumerate(prefixes):
        best: tuple[float, Rule] = (-2.0, ())
        for k, prefix in enumerate(some):
            p, n = got[f"True{i}_{k}"], got[f"False{i}_{k}"]
            if p >= least and p >= precision * (p + n) and (p - n) / (p + n) > best[0]:
                best = ((p - n) / (p + n), prefix)
        if best[1]:
            return best[1]
    return ()


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list as one ordered conditional: false where the first match is a rule."""
    out = None
    for rule in rules:
        test = both([t.on_values() for t in rule])
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    **options,
) -> DataFrame:
    """One row per input row: id, statistics, ``base_failed`` and ``kept``.

    A text fails the base with fewer than 50 words, or if more than half of its
    words stand in repeated three-word windows. The others are judged by the
    decision list learned from the labelled rows that pass the base (``quality`` 0
    is bad).

    Defined cases: null and empty texts have no words and fail; null labels and
    labels without a text don't teach; repeated labels of one id count once, the
    lowest; without labels of both kinds every text that passes the base is kept;
    an empty table gives an empty result. Other columns are not read.
    """
    stats = text_statistics(docs, id_col, text_col)
    marks = labels.where(F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(
        (F.min(quality_col) == 0).alias("_bad")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    labelled = stats.where(~failed).join(marks, F.col(id_col) == F.col("_label_id")).drop("_label_id")
    rules = learn_rules(labelled, **options)
    return stats.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )
