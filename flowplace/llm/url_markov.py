"""URL filter: rules first, then the likelihood ratio of two character models, in DataFrame operations only.

URLs that a rule accepts train one variable-order Markov model, URLs that a rule rejects the other.
Each order is smoothed with the next lower one in proportion to the number of
different characters seen (Witten-Bell), down to a uniform one. A URL's score is the mean log-likelihood
difference per character; the limit is calibrated on rule-covered URLs that did not train.

Counts are over all URLs that rules cover, each different URL once. Levels are built from the shortest
contexts up, on distinct character runs, so no key gathers all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowplace.llm.common import partitions_of
from flowplace.session import materialise

ORDER = 4  # characters of context
ALPHABET = 256  # size of the uniform model below order 0
FOLDS = 4  # one fold of the rule-covered URLs calibrates, the others train
EDGE = "\u0001"  # stands before the first and behind the last character
# Fixed values: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
Rules = Sequence[tuple[str, str, str]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(rules: Rules) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict, both null without one, from columns ``host`` and ``path``."""
    names, verdicts = [], []
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        own = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = own & F.startswith(F.col("path"), F.lit(path))
        names.append(F.when(fits, F.lit(host + path)))
        verdicts.append(F.when(fits, F.lit(verdict)))
    return F.coalesce(F.lit(None).cast("string"), *names), F.coalesce(F.lit(None).cast("string"), *verdicts)


def runs_of(text: Column, order: int) -> Column:
    """Every character of the text, and its end, with the ``order`` characters before it."""
    padded = F.concat(F.lit(EDGE * order), text, F.lit(EDGE))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def ratios(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(run, ratio) of log-likelihoods for each distinct ``run`` of ``order + 1`` characters in ``wanted``.

    ``counts`` has per run its number among accepted and rejected URLs.
    """
    below = None
    for k in range(order + 1):
        tail = lambda c, n: F.substring(c, order + 1 - n + 1, F.lit(n))  # noqa: E731 - last n characters of a full run
        level = wanted.select(tail(F.col("run"), k + 1).alias("gram")).distinct()
        seen = counts.groupBy(tail(F.col("run"), k + 1).alias("gram")).agg(F.sum("accepted").alias("ca"), F.sum("rejected").alias("cr"))
        context = F.substring("gram", 1, k)
        totals = seen.groupBy(context.alias("context")).agg(
            F.sum("ca").alias("na"), F.sum("cr").alias("nr"), F.count_if(F.col("ca") > 0).alias("ta"), F.count_if(F.col("cr") > 0).alias("tr")
        )
        rows = level.withColumn("context", context).withColumn("shorter", F.substring("gram", 2, k))
        rows = rows.join(seen, "gram", "left").join(totals, "context", "left")
        if below is None:
            rows = rows.withColumns({"qa": F.lit(1 / ALPHABET), "qr": F.lit(1 / ALPHABET)})
        else:
            rows = rows.join(below, "shorter")

        def smoothed(c: str, n: str, t: str, q: str) -> Column:
            total = F.coalesce(F.col(n) + F.col(t), F.lit(0))
            return F.when(total > 0, (F.coalesce(c, F.lit(0)) + F.col(t) * F.col(q)) / total).otherwise(F.col(q))

        below = rows.select(
            F.col("gram").alias("shorter"), smoothed("ca", "na", "ta", "qa").alias("qa"), smoothed("cr", "nr", "tr", "qr").alias("qr")
        )
        below = materialise(below, "urls")
    return below.select(F.col("shorter").alias("run"), (F.log("qa") - F.log("qr")).alias("ratio"))


def limit_of(scores: DataFrame) -> float:
    """Score at which both classes of the calibration fold lie equally many deviations away; 0 if a class is missing there."""
    pick = lambda f, v: f(F.when(F.col("own") == v, F.col("score")))
    a, r, sa, sr = scores.filter("calibrates").agg(
        pick(F.avg, "allow"), pick(F.avg, "block"), pick(F.stddev_pop, "allow"), pick(F.stddev_pop, "block")
    ).first()
    if a is None or r is None:
        return 0.0
    return (a * sr + r * sa) / (sa + sr) if sa + sr > 0 else (a + r) / 2


def judge_urls(pages: DataFrame, rules: Rules = RULES, order: int = ORDER, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score, score_limit.

    Where no rule fits, the verdict is allow if the score reaches the limit. Rules look at host and path, the models at the
    whole URL as it stands, scheme, query and fragment included. Null URLs and such without ``://`` have an
    empty host and path; null is scored as empty text. If rules accept or reject nothing, all scores are near zero
    and the limit is zero. Repeated rows come back each; an empty table gives no rows; other columns are ignored.
    """
    whole = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    host, path = host_and_path(F.col("text"))
    rule, verdict = ruled(rules)
    parsed = pages.select(F.col(f"`{page_id}`").alias("page_id"), whole.alias("text")).select("*", host.alias("host"), path.alias("path"))
    texts = parsed.select("text", "host", "path").distinct().withColumn("own", verdict)
    held = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(FOLDS)) == 0
    texts = materialise(texts.withColumn("calibrates", F.col("own").isNotNull() & held).withColumn("id", F.monotonically_increasing_id()), "urls")
    # Written tables come in few large files; their characters are spread over the job again.
    spread = texts.repartition(partitions_of(pages), "id")
    runs = spread.select("id", "own", "calibrates", F.explode(runs_of(F.col("text"), order)).alias("run"))
    one = lambda v: F.count_if((F.col("own") == v) & ~F.col("calibrates"))
    counts = materialise(runs.groupBy("run").agg(one("allow").alias("accepted"), one("block").alias("rejected")), "urls")
    ratio = ratios(counts.select("run"), counts, order)
    scores = runs.select("id", "run").join(ratio, "run").groupBy("id").agg(F.avg("ratio").alias("score"))
    scored = materialise(texts.join(scores, "id"), "urls")
    limit = limit_of(scored)
    judged = parsed.join(scored.select("text", "score"), "text")
    return judged.select("*", rule.alias("rule"), verdict.alias("own"), F.lit(limit).alias("score_limit")).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"),
        "score",
        "score_limit",
    )
