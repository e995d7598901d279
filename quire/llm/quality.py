"""Operator 10: quality rules as learned decision lists.

Each document gets a row of counts and ratios (``text_stats``).  From the
labelled rows (``labels.quality``: 0 is poor) sequential covering learns an
ordered list of rules, each a conjunction of ``statistic >= t`` or
``statistic < t``: a rule grows by the condition of largest FOIL gain on two
thirds of the labelled rows, is pruned back to the prefix that does best on
the other third, and is kept if it is precise there; the rows it covers
are set aside and the next rule is grown; after a rule that is not kept the
next one starts with another condition, until none is left.  The list becomes one ordered
``CASE WHEN`` over the statistics.

Native: statistics are column expressions over the whole text, learning
reads histograms (statistic x threshold bin) that Spark sums over all
labelled rows; the driver sees a few hundred counts a step, never rows.

Defined results: null or empty text has no words and fails the base rule;
repeated rows are judged alike; labels that are null or neither 0 nor 1 are
left out; with no usable labels the list is empty and the base rule alone
decides; a doc_id labelled twice counts twice; other columns pass by.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, read

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A rule is kept if this share of what it covers among the pruning rows is
# poor (one poor row is counted in advance), one at least, and it covers twice
# MIN_COVER poor rows of all; MIN_COVER is the least that a condition may cover.
# Both end the learning: every kept rule takes rows with it, every further
# condition clean rows, and a start that led to no rule is not tried again.
MIN_PRECISION = 0.97
MIN_COVER = 3
# Labelled rows that a task of the learning counts.
TASK_ROWS = 50_000
QUANTILES = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.975, 0.99, 0.995, 0.999)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANK = r"[\x20\x09-\x0D]"
_SYMBOLS, _MARKS, _DIGITS, _UPPER = "#*$%&|<>", "!?", "0-9", r"\p{Lu}"
# low bits that hold a window's place: more than a text has words
_PLACE_BITS = 30


def text_stats(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The base counts and a few more of every row.

    Windows are first matched by 34 hash bits, packed with their places into
    longs that sort fast; only those that meet another one are then compared
    as words."""
    d = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    d = d.select(*keep, F.array_remove(F.split("_t", _BLANK + "+"), "").alias("_w"),
                 F.regexp_replace("_t", f"[^{_SYMBOLS}{_MARKS}{_DIGITS}{_UPPER}]+", "").alias("_rare"),
                 F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    d = d.select(
        *keep, "_w", F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        *[F.length(F.regexp_replace("_rare", f"[^{chars}]+", "")).cast("long").alias(name)
          for name, chars in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_marks", _MARKS), ("n_digits", _DIGITS))],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    rest = [c for c in d.columns if c not in ("_w", "_n")]
    window = lambda i: [F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)]
    packed = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.shiftleft(F.xxhash64(*window(i)), _PLACE_BITS).bitwiseOR(i.cast("long")))
    d = d.select(*rest, "_w", "_n", F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
                 F.sort_array(F.when(F.col("_n") >= 3, packed).otherwise(F.array().cast("array<bigint>"))).alias("_packed"))
    same = lambda x, k: F.coalesce(F.shiftright(F.get("_packed", k), _PLACE_BITS) == F.shiftright(x, _PLACE_BITS), F.lit(False))
    met = F.transform(F.filter("_packed", lambda x, k: same(x, k - 1) | same(x, k + 1)),
                      lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int"))
    d = d.select(*rest, "_w", "_n", "n_distinct", met.alias("_met"))
    # those windows sorted with their places
    d = d.select(*rest, "_n", "n_distinct", F.sort_array(
        F.transform("_met", lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i")))).alias("_sorted"))
    none = F.array().cast("array<int>")
    twice = F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))),
                       lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(none))
    d = d.select(*rest, "_n", "n_distinct", F.sort_array(F.array_distinct(F.flatten(twice))).alias("_at"))
    # a window covers three words, or those up to the next such window
    covered = F.aggregate(
        F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3))),
        F.lit(0), lambda a, x: a + x)
    return d.select(*keep, F.col("_n").cast("long").alias("n_words"), *[c for c in rest if c not in keep], "n_distinct",
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def statistics() -> dict[str, Column]:
    """What rules may test, over the columns of ``text_stats``."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "distinct_share": _ratio("n_distinct", "n_words"),
        "upper_share": _ratio("n_upper", "word_chars"),
        "digit_share": _ratio("n_digits", "word_chars"),
        "marks_per_word": _ratio("n_marks", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    value: float

    def column(self) -> Column:
        c = statistics()[self.name]
        return c >= self.value if self.at_least else c < self.value

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(hist: dict, cuts: dict[str, list[float]], p0: int, n0: int, least: int, aside: set) -> Condition | None:
    """The condition of largest gain, given (poor, clean) counts by statistic
    and bin; ``aside`` are (statistic, direction) pairs that are not tried."""
    best, found = 1e-9, None
    for name, values in cuts.items():
        bins = [hist.get((name, k), (0, 0)) for k in range(len(values) + 1)]
        p = n = 0
        for k, v in enumerate(values):
            p, n = p + bins[k][0], n + bins[k][1]
            for at_least, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if a >= least and b < n0 and (name, at_least) not in aside and (g := _gain(a, b, p0, n0)) > best:
                    best, found = g, Condition(name, at_least, v)
    return found


def _bin(name: str, values: list[float]) -> Column:
    """How many of the thresholds the statistic reaches."""
    if not values:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in values]), lambda v: v <= F.col(name)))


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules from rows with the statistics, ``poor`` (boolean) and ``grow``
    (boolean: grows rules, else prunes them)."""
    names = list(statistics())
    marks = [F.percentile_approx(F.when(F.col("poor") == poor, F.col(c)), list(QUANTILES), 10_000).alias(f"{c}_{poor}")
             for c in names for poor in (False, True)]
    row = labelled.agg(*marks).first()
    cuts = {c: sorted({v for poor in (False, True) for v in row[f"{c}_{poor}"] or ()}) for c in names}
    # a condition tells rows apart by the threshold bins of their statistics
    # alone: rows alike in these are one, with their number
    alike = labelled.select("poor", "grow", *[_bin(c, cuts[c]).alias(c) for c in names]).groupBy("poor", "grow", *names)
    coded = materialize(alike.agg(F.count(F.lit(1)).alias("rows")), "quality-labelled")
    # every step of the learning reads them: few files, whatever the shuffle's partitions
    tasks = max(1, math.ceil(coded.count() / TASK_ROWS))
    coded = materialize(coded.coalesce(tasks), "quality-coded").coalesce(tasks)
    growing = coded.where("grow")
    rules: list[Rule] = []
    aside: set[tuple[str, bool]] = set()
    whole = _histogram(growing.withColumn("rule", F.lit(0)), names).get(0, {})  # of the rows no rule covers yet
    left = _test((), cuts)
    width = 1
    while True:
        # the next starts, best first: after one that leads to no rule comes
        # another statistic or direction; 1, 2, 4 ... of them are grown at once
        tried: list[list[Condition]] = []
        p0, n0 = _totals(whole, names)
        while len(tried) < width and (c := _best(whole, cuts, p0, n0, MIN_COVER, aside)) is not None:
            tried.append([c])
            aside.add((c.name, c.at_least))
        if not tried:
            break
        hists = _grow(growing.where(left), tried, names, cuts)
        seen = _prefix_counts(coded.where(left), tried, cuts)
        kept = next(((i, k) for i, rule in enumerate(tried) if (k := _pruned(rule, seen[i])) is not None), None)
        width *= 2
        if kept is None:
            continue
        i, k = kept
        rules.append(tuple(tried[i][: k + 1]))
        whole = {b: (x[0] - hists[i][k].get(b, (0, 0))[0], x[1] - hists[i][k].get(b, (0, 0))[1]) for b, x in whole.items()}
        left = left & ~_test(rules[-1], cuts)
        aside.clear()
        width = 1
    return rules


def _grow(growing: DataFrame, rules: list[list[Condition]], names: list[str], cuts: dict[str, list[float]]) -> list[list[dict]]:
    """Adds conditions to each rule while one gains; the histograms of the rows
    that each prefix of each rule covers."""
    hists: list[list[dict]] = [[] for _ in rules]
    active = list(range(len(rules)))
    while active:
        covers = F.array_compact(F.array(*[F.when(_test(rules[i], cuts), F.lit(i)) for i in active]))
        got = _histogram(growing.withColumn("rule", F.explode(covers)), names)
        grown = []
        for i in active:
            hists[i].append(hist := got.get(i, {}))
            p0, n0 = _totals(hist, names)
            if p0 and n0 and (c := _best(hist, cuts, p0, n0, MIN_COVER, set())) is not None:
                rules[i].append(c)
                grown.append(i)
        active = grown
    return hists


def _prefix_counts(coded: DataFrame, rules: list[list[Condition]], cuts: dict[str, list[float]]) -> list[list[tuple[int, int, int]]]:
    """By rule and prefix: the poor and the clean pruning rows it covers, and
    the poor rows of all."""
    def depth(rule: list[Condition]) -> Column:
        """How many conditions hold before the first that does not."""
        out = F.when(~_test(rule[:1], cuts), 0)
        for k in range(1, len(rule)):
            out = out.when(~_test(rule[k : k + 1], cuts), k)
        return out.otherwise(len(rule))

    covers = F.array_compact(F.array(*[F.when(_test(r[:1], cuts), F.struct(F.lit(i).alias("rule"), depth(r).alias("depth"))) for i, r in enumerate(rules)]))
    got = coded.select("poor", "grow", "rows", F.explode(covers).alias("c")).groupBy("c.rule", "c.depth", "poor", "grow").agg(F.sum("rows").alias("n")).collect()
    count = lambda i, k, poor, grow: sum(x["n"] for x in got if (x["rule"], x["poor"], x["grow"]) == (i, poor, grow) and x["depth"] > k)
    return [[(p := count(i, k, True, False), count(i, k, False, False), p + count(i, k, True, True)) for k in range(len(r))] for i, r in enumerate(rules)]


def _pruned(rule: list[Condition], seen: list[tuple[int, int, int]]) -> int | None:
    """The place of the last condition of the prefix with the best
    (poor - clean) / covered on the pruning rows; none if it is not precise."""
    k = max(range(len(rule)), key=lambda i: ((seen[i][0] - seen[i][1]) / (seen[i][0] + seen[i][1] + 1), -i))
    p, n, poor = seen[k]
    return None if not p or poor < 2 * MIN_COVER or p / (p + n + 1) < MIN_PRECISION * p / (p + 1) else k


def _totals(hist: dict, names: list[str]) -> tuple[int, int]:
    own = [v for (c, _), v in hist.items() if c == names[0]]
    return sum(v[0] for v in own), sum(v[1] for v in own)


def _histogram(coded: DataFrame, names: list[str]) -> dict[int, dict[tuple[str, int], tuple[int, int]]]:
    """(poor, clean) rows by the rule that covers them, statistic and bin."""
    bins = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("bin")) for c in names])
    count = lambda poor: F.sum(F.when(F.col("poor") == poor, F.col("rows")).otherwise(0))
    got = coded.select("rule", "poor", "rows", F.explode(bins).alias("b")).groupBy("rule", "b.name", "b.bin").agg(count(True).alias("p"), count(False).alias("n")).collect()
    out: dict[int, dict[tuple[str, int], tuple[int, int]]] = {}
    for x in got:
        out.setdefault(x["rule"], {})[x["name"], x["bin"]] = (x["p"], x["n"])
    return out


def _test(conditions, cuts: dict[str, list[float]]) -> Column:
    """The conditions on the bins of the statistics."""
    out = F.lit(True)
    for c in conditions:
        reached = F.col(c.name) > cuts[c.name].index(c.value)
        out = out & (reached if c.at_least else ~reached)
    return out


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    y = labels.where(F.col("quality").isin(0, 1)).select(
        "doc_id", (F.col("quality") == 0).alias("poor"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"))
    own = stats.select("doc_id", *[c.alias(k) for k, c in statistics().items()])
    return y.join(own, "doc_id").drop("doc_id")


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true keeps."""
    out = F.when(base_failed(), False)
    for r in rules:
        out = out.when(_all(r), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row."""
    stats = materialize(text_stats(docs), "quality-stats")
    rules = learn(labelled_stats(stats, labels))
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they came."""
    # written before it is tested: a filter on the statistics would be pushed
    # below them, each statistic then computed anew at every mention
    judged = materialize(text_stats(docs.select(F.struct("*").alias("row"), F.col("text")), keep=("row",)), "quality-rows")
    stats = judged.select(F.col("row.doc_id").alias("doc_id"), *[c for c in judged.columns if c != "row"])
    rules = learn(labelled_stats(stats, labels))
    return judged.where(verdict(rules)).select("row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
