"""URL filter: rules by host and path, and for all other URLs a ratio of two character models, in DataFrame operations only.

Accepted and rejected URLs each give a variable-order Markov model of characters: contexts of up to ``order`` characters, smoothed
by Witten-Bell against the next shorter context. A context counts as long as it holds ``least`` of a model's characters, so each
length has at most 2 / least contexts, whatever the input: the model is what is broadcast, and this is its bound (times
the alphabet, for the characters seen after a context). A URL's score is the log-likelihood difference of the models per character.
Its threshold is calibrated on a fifth of the labelled URLs that the models have not seen: where the two error rates' mean is least.

Digits are alike to the models, and URLs that read the same to them are counted, scored and joined back as one, so a host with a third of all
rows costs one row per distinct text.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule, and is scored as its whole text (null: empty).
Without labelled URLs of both kinds nothing can be told apart and all that no rule blocks is allowed. Repeated rows
are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored_table

START, END = "\x02", "\x03"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = 0.01

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, lower-cased; from there to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _A, _Z)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def readable(url: Column) -> Column:
    """What the models read: without the scheme, lower case, digits alike, with an end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)
    return F.concat(F.regexp_replace(F.translate(F.coalesce(rest, F.lit("")), _A, _Z), "[0-9]", "0"), F.lit(END))


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """The n-grams of 1 to order + 1 characters that end at each place."""
    padded = F.concat(F.lit(START * order), F.col("reads"))
    places = texts.withColumn("place", F.explode(F.sequence(F.lit(1), F.length("reads"))))
    grams = [F.substring(padded, F.lit(order - m) + F.col("place"), F.lit(m + 1)).alias(f"g{m}") for m in range(order + 1)]
    return places.select("*", *grams)


def train_ratio(labelled: DataFrame, order: int = 4, least: float = 1 / 20_000) -> tuple[DataFrame, DataFrame]:
    """From rows (reads, accepted, n): grams with the log ratio of both models' probabilities, and contexts with the log ratio of their back-off weights."""
    wide = _grams(labelled, order)
    grams = wide.select("accepted", "n", F.explode(F.array(*[F.col(f"g{m}") for m in range(order + 1)])).alias("gram"))
    good, bad = F.when(F.col("accepted"), F.col("n")).otherwise(0), F.when(F.col("accepted"), 0).otherwise(F.col("n"))
    counts = stored_table(grams.groupBy("gram").agg(F.sum(good).alias("good"), F.sum(bad).alias("bad")), "grams")
    counts = counts.withColumns({"m": F.length("gram") - 1, "context": F.expr("substring(gram, 1, length(gram) - 1)")})
    totals = counts.filter("m = 0").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("alphabet")).first()
    kept = counts.groupBy("context").agg(
        *[f.alias(f"{what}_{k}") for k in ("good", "bad") for what, f in (("total", F.sum(k)), ("kinds", F.count_if(F.col(k) > 0)))]
    )
    kept = kept.filter(
        (F.length("context") == 0) | (F.col("total_good") >= least * (totals["all_good"] or 0)) & (F.col("total_good") > 0) | (F.col("total_bad") >= least * (totals["all_bad"] or 0)) & (F.col("total_bad") > 0)
    )
    weight = {k: F.when(F.col(f"total_{k}") > 0, F.col(f"kinds_{k}") / (F.col(f"total_{k}") + F.col(f"kinds_{k}"))).otherwise(1.0) for k in ("good", "bad")}
    kept = stored_table(kept.withColumns({f"weight_{k}": w for k, w in weight.items()}), "contexts")
    base, below, parts = 1.0 / (totals["alphabet"] + 1), None, []
    for m in range(order + 1):
        own = counts.filter(F.col("m") == m).join(F.broadcast(kept), "context")
        if below is not None:
            own = own.join(F.broadcast(below), F.substring("gram", 2, m) == F.col("shorter"))
        p = {
            k: F.when(F.col(f"total_{k}") > 0, F.col(k) / (F.col(f"total_{k}") + F.col(f"kinds_{k}"))).otherwise(0.0)
            + F.col(f"weight_{k}") * (F.lit(base) if below is None else F.col(f"p_{k}"))
            for k in ("good", "bad")
        }
        own = stored_table(own.select("gram", p["good"].alias("q_good"), p["bad"].alias("q_bad")), "order")
        below = own.select(F.col("gram").alias("shorter"), F.col("q_good").alias("p_good"), F.col("q_bad").alias("p_bad"))
        parts.append(own.select("gram", (F.log("q_good") - F.log("q_bad")).alias("ratio")))
    ratios = parts[0]
    for part in parts[1:]:
        ratios = ratios.unionByName(part)
    return ratios, kept.select("context", (F.log("weight_good") - F.log("weight_bad")).alias("ratio"))


def scored(texts: DataFrame, ratios: DataFrame, contexts: DataFrame, order: int = 4) -> DataFrame:
    """Rows (reads, score): the log-likelihood difference per character of each distinct text."""
    rows = _grams(texts.select("reads").distinct(), order)
    for m in range(order + 1):
        rows = rows.join(F.broadcast(ratios.select(F.col("gram").alias(f"gram{m}"), F.col("ratio").alias(f"r{m}"))), F.col(f"g{m}") == F.col(f"gram{m}"), "left")
        own = contexts.select(F.col("context").alias(f"context{m}"), F.col("ratio").alias(f"b{m}"))
        rows = rows.join(F.broadcast(own), F.expr(f"substring(g{m}, 1, {m})") == F.col(f"context{m}"), "left")
    value = F.lit(0.0)
    for m in range(order + 1):
        value = F.when(F.col(f"r{m}").isNotNull(), F.col(f"r{m}")).otherwise(F.coalesce(F.col(f"b{m}"), F.lit(0.0)) + value)
    return rows.select("reads", value.alias("value")).groupBy("reads").agg(F.avg("value").alias("score"))


def threshold(scores: DataFrame) -> float:
    """From rows (score, accepted, n): where the mean of both error rates is least; halfway between the best steps that tie."""
    step = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) / _STEP).cast("int").alias("step")
    good, bad = F.when(F.col("accepted"), F.col("n")).otherwise(0), F.when(F.col("accepted"), 0).otherwise(F.col("n"))
    steps = sorted(scores.groupBy(step).agg(F.sum(good).alias("good"), F.sum(bad).alias("bad")).collect())  # 4001 rows at most
    good, bad = sum(r["good"] for r in steps), sum(r["bad"] for r in steps)
    if not good or not bad:
        return float("-inf")
    best, lost, let = (2.0, 0.0), 0, bad
    for k, r in enumerate(steps):
        error = lost / good + let / bad
        low = steps[k - 1]["step"] if k else r["step"] - 1
        if error < best[0]:
            best = (error, (low + r["step"]) / 2 * _STEP)
        lost, let = lost + r["good"], let - r["bad"]
    return best[1]


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, order: int = 4, least: float = 1 / 20_000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where a rule decides). ``labelled`` has rows (url,
    accepted); without it the URLs that a rule decides are the labelled ones."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), readable(url).alias("reads"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = stored_table(rows.withColumns({"rule": rule, "by_rule": verdict}), "urls")
    if labelled is None:
        known = rows.filter(F.col("rule").isNotNull()).select("reads", (F.col("by_rule") == "allow").alias("accepted"))
    else:
        known = labelled.select(readable(F.col("url").cast("string")).alias("reads"), F.col("accepted").cast("boolean").alias("accepted")).filter("accepted is not null")
    known = stored_table(known.groupBy("reads", "accepted").agg(F.count("*").alias("n")), "labelled")
    aside = F.crc32(F.col("reads").cast("binary")) % 5 == 0
    ratios, contexts = train_ratio(known.filter(~aside), order, least)
    texts = known.select("reads").unionByName(rows.filter(F.col("rule").isNull()).select("reads")).distinct()
    scores = stored_table(scored(texts, ratios, contexts, order), "scores")
    least_score = threshold(known.filter(aside).join(scores, "reads"))
    judged = rows.join(scores.withColumnRenamed("reads", "of"), F.col("rule").isNull() & (F.col("reads") == F.col("of")), "left")
    method = F.when(F.col("score") < least_score, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "score")
