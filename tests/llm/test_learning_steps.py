"""The rule learning reads few files a step and grows failing starts together."""

from pyspark.sql import functions as F

from quire.llm import quality


def labelled(spark):
    mix = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    poor = mix(0, 9) == 0
    own = {c: mix(k, 50).cast("double") for k, c in enumerate(quality.statistics(), 1)}
    own["n_words"] = F.when(poor & (mix(11, 2) == 0), 200 + mix(12, 50)).otherwise(mix(13, 120)).cast("double")
    own["word_length"] = F.when(poor & (mix(11, 2) == 1), 90 + mix(14, 9)).otherwise(mix(15, 92)).cast("double")
    return spark.range(1200).select(poor.alias("poor"), (mix(16, 3) != 0).alias("grow"), *[v.alias(k) for k, v in own.items()])


def plain_learn(rows, cuts):
    """One start after the other, on the rows themselves."""
    names = list(cuts)
    met = lambda r, cs: all((r[c.name] >= c.value) == c.at_least for c in cs)

    def hist(some):
        out = {}
        for r in some:
            for c in names:
                b = (c, sum(v <= r[c] for v in cuts[c]))
                p, n = out.get(b, (0, 0))
                out[b] = (p + r.poor, n + (not r.poor))
        return out

    rules, aside, left = [], set(), rows
    while True:
        rule = []
        while True:
            some = [r for r in left if r.grow and met(r, rule)]
            p0 = sum(r.poor for r in some)
            n0 = len(some) - p0
            if not p0 or not n0 or (c := quality._best(hist(some), cuts, p0, n0, quality.MIN_COVER, set() if rule else aside)) is None:
                break
            rule.append(c)
        if not rule:
            return rules
        seen = []
        for k in range(len(rule)):
            some = [r for r in left if met(r, rule[: k + 1])]
            p, n = (sum(r.poor is y for r in some if not r.grow) for y in (True, False))
            seen.append(((p - n) / (p + n + 1), -k, p, n, sum(r.poor for r in some)))
        _, k, p, n, every = max(seen)
        if not p or every < 2 * quality.MIN_COVER or p / (p + n + 1) < quality.MIN_PRECISION * p / (p + 1):
            aside.add((rule[0].name, rule[0].at_least))
            continue
        rules.append(tuple(rule[: 1 - k]))
        left = [r for r in left if not met(r, rules[-1])]
        aside.clear()


def test_few_files_and_steps_and_the_same_rules(spark, monkeypatch):
    files, cuts, plain, best = [], {}, quality._histogram, quality._best

    def counted(coded, names):
        files.append(len(coded.inputFiles()))
        return plain(coded, names)

    monkeypatch.setattr(quality, "_histogram", counted)
    monkeypatch.setattr(quality, "_best", lambda hist, c, *a: cuts.update(c) or best(hist, c, *a))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = quality.materialize(labelled(spark), "rows")
        rules = quality.learn(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    monkeypatch.undo()
    assert len(rules) >= 2 and max(files) == 1
    steps, single = len(files), []
    monkeypatch.setattr(quality, "_best", lambda *a: single.append(1) or best(*a))
    assert plain_learn(rows.collect(), cuts) == rules
    assert steps < len(single)
