"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides are the labelled ones: accepted and rejected. For each class a variable-order Markov
model gives the chance of a character after up to ``ORDER`` others, smoothed after Witten and Bell: a context
mixes what followed it with what its shorter context says. The score of a URL (host and path) is the
difference of the two log-likelihoods over its length. The cut is calibrated on labelled URLs that the models
have not seen (a hash picks about 3 in 16): the score at which the sum of both classes' error shares is least.

Every row is counted and scored; URLs that occur often are scored once and weigh as often as they occur.
Per-character values are whole millionths, so sums don't depend on their order. The table of character
grams is sent to all tasks if it has at most ``BROADCAST_GRAMS`` rows (counted first); beyond, it is
shuffled. DataFrame operations only.

Defined results: null URLs and those without ``://`` have empty host and path and are judged like others;
with no labelled URL of one class, scores are the other class's against the uniform model; an empty table
gives an empty one; a score at the cut is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written

#: Fixed values: (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
ORDER = 4
UNIT = 1_000_000
UNIFORM = 256
#: Calibration: first hex digit of the MD5 of the URL below this.
HELD_BACK = "3"
STEPS = 1000  # of the cut, per unit of score
RANGE = 20_000  # scores beyond +-20 count as the last step
BROADCAST_GRAMS = 500_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = [F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(part[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part[1]


def ruled(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for action, text in sorted(RULES, key=lambda r: -len(r[1])):
        cut = text.index("/")
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return rule, verdict


def _grams(s: Column) -> Column:
    """For every character and the end: the ORDER characters before it, and itself."""
    padded = F.concat(F.lit("\x02" * ORDER), s, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.char_length(s) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, score): millionths of log P(last | rest, accepted) - log P(last | rest, rejected).

    ``counts`` has gram, a and r: how often it occurs in accepted and rejected URLs; 0 for others.
    """
    chance = None
    for k in range(ORDER + 1):
        level = counts.groupBy(F.substring("gram", -(k + 1), k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        sums = {"na": F.sum("a"), "ta": F.count_if(F.col("a") > 0), "nr": F.sum("r"), "tr": F.count_if(F.col("r") > 0)}
        if k:
            level = level.withColumn("ctx", F.substring("g", 1, k))
            level = level.join(level.groupBy("ctx").agg(*[c.alias(name) for name, c in sums.items()]), "ctx")
        else:  # the empty context is that of all
            level = level.withColumns({name: level.agg(c).scalar() for name, c in sums.items()})
        if chance is None:
            level = level.withColumns({"qa": F.lit(1.0 / UNIFORM), "qr": F.lit(1.0 / UNIFORM)})
        else:
            level = level.withColumn("shorter", F.substring("g", 2, k)).join(chance.select(F.col("g").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "shorter")
        chance = level.select(
            "g",
            F.when(F.col("na") > 0, (F.col("a") + F.col("ta") * F.col("qa")) / (F.col("na") + F.col("ta"))).otherwise(F.col("qa")).alias("pa"),
            F.when(F.col("nr") > 0, (F.col("r") + F.col("tr") * F.col("qr")) / (F.col("nr") + F.col("tr"))).otherwise(F.col("qr")).alias("pr"),
        )
    return chance.select(F.col("g").alias("gram"), F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long").alias("score"))


def best_cut(steps: list[tuple[int, int, int]]) -> float:
    """The step at or above which scores are allowed, of (step, accepted, rejected); the lowest of equals."""
    accepted, rejected = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not accepted or not rejected:
        return 0.0
    lost, let_in = 0, rejected
    best, cut = (let_in / rejected, min(s[0] for s in steps)), min(s[0] for s in steps)
    for step, a, r in sorted(steps):
        error = lost / accepted + let_in / rejected
        if error < best[0]:
            best, cut = (error, step), step
        lost, let_in = lost + a, let_in - r
    if lost / accepted + let_in / rejected < best[0]:
        cut = max(s[0] for s in steps) + 1
    return cut / STEPS


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page; reads page_id and url."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("s", F.concat("host", "path"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    urls = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("ruled").alias("ruled"))
    urls = written(urls.withColumn("held", F.substring(F.md5("s"), 1, 1) < HELD_BACK), "urls")

    def counted(label: str) -> Column:
        return F.sum(F.when((F.col("ruled") == label) & ~F.col("held"), F.col("n")).otherwise(0))

    each = urls.withColumn("gram", F.explode(_grams(F.col("s"))))
    counts = each.groupBy("gram").agg(counted("allow").alias("a"), counted("block").alias("r"))
    scores = written(gram_scores(written(counts, "url-grams")), "url-gram-scores")
    if scores.count() <= BROADCAST_GRAMS:
        scores = F.broadcast(scores)
    scored = each.select("s", "gram").join(scores, "gram").groupBy("s").agg(F.sum("score").alias("sum"))
    scored = scored.withColumn("score", F.col("sum") / (F.lit(float(UNIT)) * (F.char_length("s") + 1)))
    scored = written(scored.join(urls, "s").select("s", "score", "n", "ruled", "held"), "url-scores")

    step = F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.floor(F.col("score") * STEPS)))
    seen = scored.where("held and ruled is not null").groupBy(step.alias("step"))
    # at most 2 * RANGE + 1 rows
    seen = seen.agg(F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)), F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)))
    cut = best_cut([tuple(r) for r in seen.collect()])
    model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return rows.join(scored.select("s", "score"), "s").select("page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), "score")
