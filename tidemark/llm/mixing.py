"""Mixing to target weights with soft membership.

A naive Bayes classifier, learnt from a labelled table, gives each document a posterior over domains, from the telling
words and word shapes that it has or from having none; what words tell is divided by a temperature that is fitted on
labels held back. Rates, one a document, are fitted so that the expected tokens of each domain (rate * tokens * posterior,
summed) match targets: nonnegative least squares, drawn to a rate of 1, by projected gradient steps from rates of 1, each
one aggregation over a narrow table, until the totals do not move any more. A step is scaled by the Gram matrix of the
rows whose rates are free (a two-metric projection) and damped until it lowers the sum of squares; where no damping does,
the steps are scaled by the matrix of all rows from then on, accelerated and restarted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, table, unit_hash


@dataclass(frozen=True)
class Mix:
    """targets: wanted shares of expected tokens by domain, made to sum to 1. The total leaves the
    domain of the largest target as many tokens as it has, so its documents stay; `total_tokens` sets another. max_rate: the greatest rate,
    without bound if it is infinite; with one, a domain that is too rare for its target stays below it. steps: so many gradient
    steps at most; None: as many as it takes. per_class: labelled
    documents of each domain that the classifier learns from, at most, those of the least keyed hash. buckets: hashed
    words and shapes; telling: the least likelihood ratio statistic (G) of a bucket against the domains, so that hardly one of all
    counts by chance; contrast: how far the log of the share of a domain's documents that have it must be above the next
    domain's, so that it tells of one domain. ridge: pull to a rate of 1."""

    targets: dict[str, float] = field(default_factory=lambda: {"clean": 0.90, "low": 0.05, "toxic": 0.05})
    per_class: int = 2000
    buckets: int = 1 << 16
    telling: float = 24.0
    contrast: float = 1.5
    ridge: float = 1e-6
    temperatures: tuple[float, ...] = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)
    held: int = 5
    max_rate: float = math.inf
    steps: int | None = None
    total_tokens: float | None = None
    seed: int = 5


#: Characters between words, and ASCII signs.
BLANK = "[ \\n\\t\\r]+"
SIGNS = "[\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]+"


def _shapes(text: Column) -> Column:
    """array of a text's word shapes: runs of letters in upper case, of digits and of other letters as one control character each, signs as they are."""
    shape = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x00-\\x40\\x5b-\\x60\\x7b-\\x7eA-Z]+", "\x01")
    return F.split(F.regexp_replace(F.regexp_replace(shape, "[A-Z]+", "\x02"), "[0-9]+", "\x03"), BLANK, -1)


def _bare(text: Column) -> Column:
    """array of a text's words, lower-cased and without outer signs."""
    return F.split(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), f"(?:{SIGNS})?{BLANK}(?:{SIGNS})?", -1)


def _features(text: Column) -> Column:
    """array of a text's different words and word shapes, and of empty ones."""
    return F.array_distinct(F.concat(_bare(text), _shapes(text)))


def _bucket(feature: Column, m: Mix) -> Column:
    return F.pmod(F.xxhash64(feature), F.lit(m.buckets)).cast("int")


@dataclass(frozen=True)
class Classifier:
    """weights: a table (bucket, w_0..) of each telling bucket's log rates; priors: each domain's log prior; none: the log
    chance that its documents have no telling bucket; temperature: what a document's sums of weights are divided by."""

    weights: DataFrame
    priors: dict[str, float]
    none: dict[str, float]
    temperature: float = 1.0


def _told(used: DataFrame, chosen: DataFrame, work: Workspace, m: Mix, key: str) -> tuple[DataFrame, dict[str, float]]:
    """The weights and the chances of no telling bucket, of rows (key, domain, bucket) of the chosen documents."""
    names = sorted(m.targets)
    sizes = {r["domain"]: float(r["n"]) for r in chosen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    learnt = [sizes.get(d, 0.0) for d in names]
    counts = used.groupBy("bucket").agg(*(F.sum((F.col("domain") == d).cast("double")).alias(f"n_{k}") for k, d in enumerate(names)))
    # documents of each domain that use a bucket, against what the share of all chosen documents would make it
    every = sum((F.col(f"n_{k}") for k in range(len(names))), F.lit(0.0))
    share = every / F.lit(max(sum(learnt), 1.0))
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = sum((term(F.col(f"n_{k}"), n * share) + term(n - F.col(f"n_{k}"), n - n * share) for k, n in enumerate(learnt)), F.lit(0.0)) * 2
    rates = [F.log((F.col(f"n_{k}") + 1) / F.lit(n + 2)) for k, n in enumerate(learnt)]
    centre = sum(rates, F.lit(0.0)) / len(names)
    ranked = F.sort_array(F.array(*rates), asc=False)
    apart = F.coalesce(F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)), F.lit(0.0))
    weights = work.write(counts.where((ratio >= m.telling) & (apart >= m.contrast)).select("bucket", *((w - centre).alias(f"w_{k}") for k, w in enumerate(rates))), "weights")
    some = {r["domain"]: r["n"] for r in used.join(F.broadcast(weights), "bucket", "left_semi").groupBy("domain").agg(F.countDistinct(key).alias("n")).collect()}
    return weights, {d: math.log((n - some.get(d, 0) + 1) / (n + 2)) for d, n in zip(names, learnt)}


def _temperature(used: DataFrame, chosen: DataFrame, priors: dict[str, float], work: Workspace, m: Mix, key: str) -> float:
    """The temperature of the least log loss on the chosen documents that are held back, by what the others teach; a
    domain's documents weigh as much as its prior. 1 if nothing is held back."""
    names = sorted(m.targets)
    back = F.pmod(F.xxhash64(F.lit(m.seed + 1).cast("long"), F.col(key)), F.lit(m.held)) == 0
    weights, none = _told(used.where(~back), chosen.where(~back), work, m, key)
    sums = used.where(back).join(F.broadcast(weights), "bucket").groupBy(key).agg(*(F.sum(f"w_{k}").alias(f"s_{k}") for k in range(len(names))))
    held = work.write(chosen.where(back).join(sums, key, "left"), "held")
    sizes = {r["domain"]: r["n"] for r in held.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return 1.0
    own = lambda values: reduce(lambda c, x: c.when(F.col("domain") == x[0], x[1]), list(zip(names, values))[1:], F.when(F.col("domain") == names[0], values[0]))
    heavy = own([F.lit(math.exp(priors[d]) / max(sizes.get(d, 0), 1)) for d in names])
    losses = [F.sum(-F.log(F.greatest(own(_softmax(_logits(priors, none, m, t))), F.lit(1e-12))) * heavy).alias(f"t{i}") for i, t in enumerate(m.temperatures)]
    row = held.agg(*losses).first()
    return min(m.temperatures, key=lambda t: (row[f"t{m.temperatures.index(t)}"], t))


def _logits(priors: dict[str, float], none: dict[str, float], m: Mix, temperature: float) -> list[Column]:
    """Of sums s_0.. of weights, null where there is no telling bucket."""
    return [F.coalesce(F.col(f"s_{k}") / F.lit(temperature), F.lit(none[d])) + F.lit(priors[d]) for k, d in enumerate(sorted(m.targets))]


def _softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    raised = [F.exp(F.greatest(x - top, F.lit(-700.0))) for x in logits]
    total = sum(raised, F.lit(0.0))
    return [e / total for e in raised]


def learn(docs: DataFrame, labelled: DataFrame, work: Workspace, m: Mix, key: str = "doc_id", text: str = "text") -> Classifier:
    """Of rows (key, domain).

    The chosen keys are at most per_class for each target domain and the table has at most `buckets` rows, so both may be
    broadcast at any size of the input. A key with several domains teaches the least of them; null keys, domains without a target
    and labels of no document teach nothing. A domain without labels has a prior as if it had one document.
    """
    names = sorted(m.targets)
    clean = labelled.where(F.col(key).isNotNull() & F.col("domain").isin(*names)).join(docs.select(key), key, "left_semi").groupBy(key).agg(F.min("domain").alias("domain"))
    clean = work.write(clean, "labels")
    sizes = {r["domain"]: r["n"] for r in clean.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(sizes.values()) + len(names)
    priors = {d: math.log((sizes.get(d, 0) + 1) / whole) for d in names}
    chosen = None
    for d in names:
        part = clean.where(F.col("domain") == d).orderBy(unit_hash(F.col(key), seed=m.seed), key).limit(m.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = work.write(chosen, "chosen")
    features = docs.select(F.col(key), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), key).select(key, "domain", F.explode(_features(F.col("text"))).alias("feature")).where("feature <> ''")
    used = work.write(features.select(key, "domain", _bucket(F.col("feature"), m).alias("bucket")).distinct(), "used")
    weights, none = _told(used, chosen, work, m, key)
    return Classifier(weights, priors, none, _temperature(used, chosen, priors, work, m, key))


def posteriors(docs: DataFrame, model: Classifier, m: Mix, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_tokens and p_0.. of each row of docs; rows that agree in their keys and text are one row here.

    A document without any telling bucket has the chance of just that as evidence: what lacks together would count many
    times if each absence were a factor of its own. Null, empty and blank texts have no tokens and no telling bucket.
    `model.weights` has at most m.buckets rows. A text is read once: a row without a feature, for a bucket of -1 that
    tells nothing, carries its tokens.
    """
    k = range(len(m.targets))
    given = F.col(f"`{text}`")
    # a blank at either end makes an empty shape there
    ends = lambda x: F.size(x) - (F.get(x, F.lit(0)) == "").cast("int") - ((F.size(x) > 1) & (F.element_at(x, -1) == "")).cast("int")
    read = docs.select(*keys, _bare(given).alias("__bare"), _shapes(given).alias("__shapes"))
    features = F.array_distinct(F.concat("__bare", "__shapes"))
    each = read.select(*keys, ends(F.col("__shapes")).alias("n"), F.explode(F.concat(F.array(F.lit(None).cast("string")), features)).alias("feature")).where("feature IS NULL OR feature <> ''")
    rows = each.select(*keys, F.when(F.col("feature").isNull(), F.col("n")).alias("n"), F.when(F.col("feature").isNull(), F.lit(-1)).otherwise(_bucket(F.col("feature"), m)).alias("bucket"))
    spark = docs.sparkSession
    none = spark.range(1).select(F.lit(-1).alias("bucket"), *(F.lit(None).cast("double").alias(f"w_{i}") for i in k))
    # few buckets tell, so few rows are left to be shuffled; one tells once however often a text has it
    told = rows.join(F.broadcast(model.weights.unionByName(none)), "bucket").groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), *(F.max(f"w_{i}").alias(f"w_{i}") for i in k))
    sums = told.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), *(F.sum(f"w_{i}").alias(f"s_{i}") for i in k))
    return sums.select(*keys, "n_tokens", *(p.alias(f"p_{i}") for i, p in enumerate(_softmax(_logits(model.priors, model.none, m, model.temperature)))))


def fit(light: DataFrame, work: Workspace, m: Mix) -> tuple[DataFrame, dict]:
    """light with each row's rate, and what was reached. light (n_tokens, p_0..) is read in each step, so it should be a written table.

    Rates of several scaled steps are one chain of arithmetic; a longer one would not be compiled, so they are written now
    and then. An accelerated step refers to two earlier rates, so each of these is written.
    """
    names = sorted(m.targets)
    k = range(len(names))
    mass = [F.col("n_tokens") * F.col(f"p_{i}") for i in k]
    first = light.agg(*(F.sum(a).alias(f"t_{i}") for i, a in enumerate(mass)), *(F.sum(mass[i] * mass[j]).alias(f"g_{i}_{j}") for i in k for j in k[i:])).first()
    value = lambda row, name: float(row[name] or 0.0)
    square = lambda row: np.array([[value(row, f"g_{min(i, j)}_{max(i, j)}") for j in k] for i in k])
    natural = np.array([value(first, f"t_{i}") for i in k])
    wanted = [m.targets[d] / sum(m.targets.values()) for d in names]
    anchor = max(k, key=lambda i: (wanted[i], -i))
    total = m.total_tokens if m.total_tokens is not None else natural[anchor] / wanted[anchor]
    goal = np.array(wanted) * total
    # the residual is measured in the inverse of the domains' Gram matrix, in which the least squares have a slope of at
    # most 1; a hundredth of its trace is added, lest a domain that hardly occurs outweighs the others
    gram, one = square(first), np.eye(len(names))
    trace = max(float(np.trace(gram)), 1e-30)
    metric = gram + 0.01 * trace * one
    inverse = np.linalg.inv(metric)
    near, least = 1e-7 * max(total, 1.0), 1 / (1 + m.ridge)

    def moved(start: Column, pull: np.ndarray, size: float) -> Column:
        slope = sum((a * F.lit(float(size * x)) for a, x in zip(mass, pull)), F.lit(0.0))
        to = F.greatest(F.lit(0.0), start * F.lit(1 - size * m.ridge) - slope + F.lit(size * m.ridge))
        return to if math.isinf(m.max_rate) else F.least(F.lit(m.max_rate), to)

    def measured(df: DataFrame, rate: Column) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """Totals, the sum of squares that is minimised, and of the rows whose rates are free the Gram matrix and how far their totals are from those at rates of 1."""
        free = ((rate > 0) & (rate < m.max_rate)).cast("double")
        row = df.agg(
            F.sum((rate - 1) * (rate - 1)).alias("far"),
            *(F.sum(rate * a).alias(f"t_{i}") for i, a in enumerate(mass)),
            *(F.sum(free * (rate - 1) * a).alias(f"q_{i}") for i, a in enumerate(mass)),
            *(F.sum(free * mass[i] * mass[j]).alias(f"g_{i}_{j}") for i in k for j in k[i:]),
        ).first()
        totals = np.array([value(row, f"t_{i}") for i in k])
        return totals, float((totals - goal) @ inverse @ (totals - goal) + m.ridge * value(row, "far")) / 2, square(row), np.array([value(row, f"q_{i}") for i in k])

    kept: list[DataFrame] = []

    def written(df: DataFrame) -> DataFrame:
        kept.append(work.write(df, "rates"))
        for old in kept[:-2]:
            work.drop(old)
        del kept[:-2]
        return kept[-1]

    rate, reached, free, moves = F.lit(1.0), natural, gram, 0 * natural
    far = float((natural - goal) @ inverse @ (natural - goal)) / 2
    done, settled, most, damping = 0, False, m.steps or 1000, 1e-6
    while done < most and not settled and damping <= 1:
        done += 1
        if done % 6 == 0:
            light, rate = written(light.withColumn("rate", rate)), F.col("rate")
        # the gradient, scaled by 1 + mass * more * mass on the free rows: zero where the gradient is
        scale = np.linalg.inv(free + damping * trace * one)
        more = (scale @ metric - one) @ scale
        to = moved(rate, scale @ (reached - goal) + m.ridge * more @ moves, 1.0)
        totals, now, *after = measured(light, to)
        settled = damping < 1e-3 and bool(np.abs(totals - reached).max() <= near)
        if now >= far and not settled:  # too long a step
            damping *= 10
            continue
        damping = max(1e-6, damping / 10)
        rate, reached, far, (free, moves) = to, totals, now, after
    if done < most and not settled:
        light = written(light.withColumn("rate", rate))
        rate = ahead = F.col("rate")
        lead, speed = reached, 1.0
    while done < most and not settled:
        done += 1
        light = written(light.select("*", moved(ahead, inverse @ (lead - goal), least).alias("to")))
        totals, now, *_ = measured(light, F.col("to"))
        if now > far and speed > 1:  # too far ahead: start again from the rates themselves
            light, ahead, lead, speed = light.drop("to", "ahead"), rate, reached, 1.0
            continue
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        by = (speed - 1) / faster
        settled = bool(np.abs(totals - reached).max() <= near)
        light = light.select(*(c for c in light.columns if c not in ("rate", "to", "ahead")), F.col("to").alias("rate"), (F.col("to") + F.lit(by) * (F.col("to") - F.col("rate"))).alias("ahead"))
        ahead, lead, reached, far, speed = F.col("ahead"), totals + by * (totals - reached), totals, now, faster
    rated = light.withColumn("rate", rate).drop("ahead", "to")
    return rated, {"domains": names, "natural": natural.tolist(), "goal": goal.tolist(), "reached": reached.tolist(), "steps": done}


def mixed(docs: DataFrame, labelled: DataFrame, work: Workspace, m: Mix | None = None, text: str = "text") -> tuple[DataFrame, dict]:
    """(doc_id, th, n_tokens, p_<domain>.., rate, copies) and what the fit reached.

    th: a hash of the text; rows that agree in doc_id and text are one row, with the tokens of all of them. copies is the rate rounded up or down
    by a keyed hash of doc_id and th, so that its mean is the rate. With an empty table there are no rows.
    """
    m = m or Mix()
    names = sorted(m.targets)
    keyed = docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(f"`{text}`").alias("text"))
    model = learn(docs, labelled, work, m, text=text)
    light = work.write(posteriors(keyed, model, m, ["doc_id", "th"]), "posteriors")
    rated, found = fit(light, work, m)
    copies = (F.floor("rate") + (unit_hash(F.col("doc_id"), F.col("th"), seed=m.seed) < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rated.select("doc_id", "th", "n_tokens", *(F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(names)), "rate", copies.alias("copies")), found


def resampled(docs: DataFrame, labelled: DataFrame, work: Workspace, m: Mix | None = None) -> DataFrame:
    """docs with each row as often as its document has copies; the columns are those of docs, null doc_ids included."""
    rates, _ = mixed(docs, labelled, work, m)
    wanted = work.write(rates.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "copies").where("copies > 0").withColumnRenamed("copies", "__copies"), "copies")
    joined = docs.withColumn("__th", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: low where quality is 0, else toxic where toxic is 1, else clean."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, _ = mixed(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), Workspace(spark, "mixing"))
    return rates.drop("th")
