"""Mixing sources to target weights with soft membership, in DataFrame operations only.

A naive Bayes classifier on whether a document has certain words and word endings, those that best tell the
domains of a table of labelled rows apart, gives each document posteriors of its domains. Words of one text repeat what others
say, so their joint log ratio is tempered by one factor, the one that makes
labelled rows which the counts have not seen most likely; and features of small effect, which are many, count less. Each document then gets a rate of at least 0 such that the expected words of
each domain, the sum of rate * words * posterior, meet their targets in the sense of least squares, to one part in a
million. With words as the metric, of all solutions it is the one nearest to
rate 1 per word: the projection onto nonnegative rates of a step from 1 along the gradients of the domains' totals. The step is
refined, by Newton's method, until what is left of the gradient is below TOLERANCE; each refinement is one distributed sum over all documents.

Scale: the classifier's counts come from at most FIT_ROWS labelled rows (least hash); it is at
most MOST_FEATURES numbers a domain. Scoring is per row. Each Newton step is one aggregation of as many sums as pairs of
domains; the driver holds those alone, and nothing is broadcast but the classifier.

Defined results: `tokens` counts words between blanks; a null or empty text has none and the prior as its posterior; labels with nulls, and labels of unknown
documents, are ignored; a document with several labels counts for each; without labels every document is of
the target's domains in equal parts; domains without a target have target 0; repeated rows get equal rates; an empty table gives an empty table. Only the
named columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.llm.storage import settled

#: Slots of the table that finds a feature's place.
BUCKETS = 1 << 15
#: Bound of the features that the classifier uses, strongest first.
MOST_FEATURES = 1000
#: Bound of the sample of labelled rows; one in HELD_ROWS of them sets the factor of the log ratios.
FIT_ROWS, HELD_ROWS = 20_000, 4
#: Effects from which a feature counts by half, and at all; an effect is a difference in standard errors, divided by the root of the rows. And the least difference.
HALF_EFFECT, LEAST_EFFECT, LEAST_STRENGTH = 0.4, 0.13, 2.0
#: Rows of overall frequency that each domain's frequencies are smoothed with.
PRIOR_ROWS = 2.0
#: Factors that are tried.
FACTORS = tuple(0.02 * 1.25**k for k in range(22))
#: Part of the tokens to which the rates are fitted, and the weight of the step's size, which bounds it where no rates meet the targets.
TOLERANCE, RIDGE = 1e-6, 1e-9
#: Rounds after which a fit that has not met the tolerance is given up with a warning; it takes about ten.
MOST_ROUNDS = 200

log = logging.getLogger(__name__)


def words(text: Column) -> Column:
    """Words between single blanks, line breaks counting as blanks; none for null."""
    blank, spaced = F.lit(" "), F.coalesce(text, F.lit(""))
    for c in "\n\t\r":  # whole searches, much faster than a translation by character
        spaced = F.replace(spaced, F.lit(c), blank)
    return F.array_remove(F.split(spaced, " ", -1), "")


def features(tokens: Column) -> Column:
    """Hashes of the words and of their last two characters."""
    return F.concat(F.transform(tokens, lambda w: F.xxhash64(w)), F.transform(tokens, lambda w: F.xxhash64(F.right(w, F.lit(2)), F.lit(2))))


def _constant(values: list, kind: str) -> Column:
    """A constant array, written as text so that the plan stays small."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Classifier:
    """Naive Bayes on whether each of a few known features is in a text: `prior` is a domain's log probability, `base` its log ratio of a text with none, `shift` what each feature adds, `factor` what log ratios are multiplied with."""

    def __init__(self, prior: dict[str, float], base: dict[str, float], shift: dict[str, dict[int, float]], factor: float = 1.0):
        self.domains = sorted(base)
        self.prior, self.base, self.shift, self.factor = prior, base, shift, factor

        slots: dict[int, int] = {}
        for h in sorted({h for s in shift.values() for h in s}, key=lambda h: (-max(abs(s.get(h, 0.0)) for s in shift.values()), h)):
            slots.setdefault(h % BUCKETS, h)
        #: Features in use by their place in the table; of those that share a place the most telling.
        self.slots = slots

    def found(self, tokens: Column) -> Column:
        """The places, from 1, of the features in use that are among the tokens, each once."""
        if not self.slots:
            return F.expr("CAST(array() AS array<int>)")
        known = _constant(list(self.slots.values()), "bigint")
        place = {b: k for k, b in enumerate(self.slots, start=1)}
        index = _constant([place.get(b, 0) for b in range(BUCKETS)], "int")
        return F.transform(F.array_intersect(features(tokens), known), lambda h: F.element_at(index, F.pmod(h, F.lit(BUCKETS)).cast("int") + 1))

    def ratios(self, found: Column) -> Column:
        """The log ratio of each domain, in order of their names. `found` should be a column: each domain reads it."""

        def ratio(domain: str) -> Column:
            if not self.slots:
                return F.lit(0.0)
            table = _constant([self.shift[domain].get(h, 0.0) for h in self.slots.values()], "double")
            return F.aggregate(found, F.lit(self.base[domain]), lambda a, k: a + F.element_at(table, k))

        return F.array(*(ratio(d) for d in self.domains))

    def posteriors(self, ratios: Column, factor: float | Column) -> Column:
        """Posteriors of the domains for their log ratios, tempered by the factor."""
        priors = F.array(*(F.lit(self.prior[d]) for d in self.domains))
        scores = F.zip_with(ratios, priors, lambda r, p: r * factor + p)
        powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
        return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def fit(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """Fits on the rows of df that `labelled` (id_col, domain) names; None without any."""
    named = labelled.where(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).select(F.col(id_col).alias("label_id"), "domain").distinct()
    sample = named.orderBy(F.xxhash64("label_id"), "label_id", "domain").limit(FIT_ROWS)
    known = df.select(id_col, text_col).join(F.broadcast(sample), F.col(id_col) == F.col("label_id"))
    held = F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(HELD_ROWS)) == 0
    rows = settled(known.select("domain", held.alias("held"), words(F.col(text_col)).alias("words")))
    tokens = rows.select("domain", "held", F.array_distinct(features(F.col("words"))).alias("features"))
    counted = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_if("held").alias("held")).collect()
    every = {r["domain"]: r["n"] for r in counted}
    if not every:
        return None
    spared = all(r["n"] >= 8 * HELD_ROWS and 0 < r["held"] < r["n"] for r in counted)  # else all rows are counted
    learned = tokens.where("NOT held") if spared else tokens
    sizes = {r["domain"]: r["n"] - r["held"] if spared else r["n"] for r in counted}
    domains, total = sorted(sizes), sum(sizes.values())
    seen = F.array(*(F.count_if(F.col("domain") == d) for d in domains))
    counts = learned.select("domain", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), seen.alias("seen")).where("n > 1")
    tests = [(F.col("seen")[k] - F.col("n") * (sizes[d] / total)) / F.sqrt(F.col("n") * (sizes[d] / total) + 1) for k, d in enumerate(domains)]
    strength = F.sqrt(sum((t * t for t in tests), F.lit(0.0)))
    picked = counts.withColumn("strength", F.round(strength, 6)).where(F.col("strength") > max(LEAST_STRENGTH, LEAST_EFFECT * math.sqrt(total))).orderBy(F.desc("strength"), "feature").limit(MOST_FEATURES).collect()
    prior, base, shift, half = {}, {}, {}, (HALF_EFFECT**2 * total) ** 2
    for k, d in enumerate(domains):
        prior[d] = math.log(every[d] / sum(every.values()))
        shift[d], base[d] = {}, 0.0
        for r in picked:
            overall = min(max(r["n"] / total, 1e-6), 1 - 1e-6)
            p = min(max((r["seen"][k] + PRIOR_ROWS * overall) / (sizes[d] + PRIOR_ROWS), 1e-6), 1 - 1e-6)
            trust = r["strength"] ** 4 / (r["strength"] ** 4 + half)
            absent = trust * (math.log1p(-p) - math.log1p(-overall))
            base[d] += absent
            shift[d][r["feature"]] = trust * (math.log(p) - math.log(overall)) - absent
    classifier = Classifier(prior, base, shift)
    scored = rows.where("held") if spared else rows
    scored = scored.select("domain", classifier.found(F.col("words")).alias("found")).select("domain", classifier.ratios(F.col("found")).alias("ratios"))
    own = F.element_at(F.map_from_arrays(F.array(*map(F.lit, domains)), F.array(*(F.lit(k + 1) for k in range(len(domains))))), F.col("domain"))
    likely = [F.sum(F.log(F.greatest(F.element_at(classifier.posteriors(F.col("ratios"), f), own), F.lit(1e-9)))) for f in FACTORS]
    sums = scored.agg(*(x.alias(f"f{k}") for k, x in enumerate(likely))).first()
    classifier.factor = FACTORS[max(range(len(FACTORS)), key=lambda k: sums[k])]
    return classifier


def memberships(df: DataFrame, classifier: Classifier | None, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p array<double>): posteriors of `domains`, in their order."""
    tokens = df.select(id_col, words(F.col(text_col)).alias("tokens"))
    if classifier is None:
        return tokens.select(id_col, F.size("tokens").cast("long").alias("tokens"), F.array(*(F.lit(1 / len(domains)) for _ in domains)).alias("p"))
    met = tokens.select(id_col, F.size("tokens").cast("long").alias("tokens"), classifier.found(F.col("tokens")).alias("found"))
    scored = met.select(id_col, "tokens", classifier.ratios(F.col("found")).alias("ratios"))
    judged = scored.select(id_col, "tokens", F.when(F.col("tokens") > 0, classifier.posteriors(F.col("ratios"), classifier.factor)).otherwise(F.array(*(F.lit(math.exp(classifier.prior[d])) for d in classifier.domains))).alias("own"))
    place = {d: k for k, d in enumerate(classifier.domains)}
    return judged.select(id_col, "tokens", F.array(*(F.col("own")[place[d]] if d in place else F.lit(0.0) for d in domains)).alias("p"))


def rate(p: Column, step: list[float]) -> Column:
    """The rate after a step from 1, projected onto the rates of at least 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((p[k] * F.lit(x) for k, x in enumerate(step)), F.lit(0.0)))


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small positive definite system, by elimination."""
    n = len(right)
    rows = [[*row, x] for row, x in zip(matrix, right, strict=True)]
    for k in range(n):
        for j in range(k + 1, n):
            f = rows[j][k] / rows[k][k]
            rows[j] = [x - f * y for x, y in zip(rows[j], rows[k], strict=True)]
    out = [0.0] * n
    for k in reversed(range(n)):
        out[k] = (rows[k][n] - sum(rows[k][j] * out[j] for j in range(k + 1, n))) / rows[k][k]
    return out


def fit_rates(member: DataFrame, targets: list[float], total: float | None = None, anchor: int | None = None) -> tuple[list[float], float]:
    """A step whose `rate` makes the expected tokens of each domain its target share of `total` tokens, and by how much of the total a domain misses its target at most.

    By default the total is the most that needs no domain's tokens more than once. With an `anchor` it is the one that needs all tokens of that domain, and
    the targets of domains that have less than their share are what they have.

    The rates nearest to 1 are max(0, 1 - p * step) for one step, the minimum of a convex function of as many numbers as domains; Newton steps find it. RIDGE makes it
    finite where no rates meet the targets, and then gives least squares.
    """
    n = len(targets)
    p, t = F.col("p"), F.col("tokens").cast("double")

    def sums(step: list[float]) -> tuple[list[float], list[list[float]], float]:
        """At `step`: expected tokens, their derivatives, and half the squared rates."""
        rated = member.select("p", "tokens", rate(p, step).alias("w"))
        live = F.when(F.col("w") > 0, t).otherwise(F.lit(0.0))
        got = rated.agg(
            *(F.sum(F.col("w") * t * p[k]).alias(f"s{k}") for k in range(n)),
            *(F.sum(live * p[j] * p[k]).alias(f"g{j}_{k}") for j in range(n) for k in range(j + 1)),
            F.sum(t * F.col("w") * F.col("w") / 2).alias("half"),
        ).first()
        return [got[f"s{k}"] or 0.0 for k in range(n)], [[got[f"g{max(j, k)}_{min(j, k)}"] or 0.0 for k in range(n)] for j in range(n)], got["half"] or 0.0

    step = [0.0] * n
    have, gram, half = sums(step)
    if not sum(have):
        return [0.0] * n, 0.0
    share = [x / sum(targets) for x in targets]
    if anchor is not None:
        total = have[anchor] / share[anchor]
    if total is None:
        total = min(h / s for h, s in zip(have, share, strict=True) if s > 0)
    want = [total * s if anchor is None else min(total * s, h) for s, h in zip(share, have, strict=True)]
    ridge = [RIDGE * gram[k][k] or 1.0 for k in range(n)]  # 1: a domain without tokens, whose step stays 0
    now = have

    def cost(step: list[float], half: float) -> float:
        return half + sum(w * x + r * x * x / 2 for w, x, r in zip(want, step, ridge, strict=True))

    def slope(step: list[float], now: list[float]) -> list[float]:
        return [(w - s + r * x) if h else 0.0 for w, s, x, r, h in zip(want, now, step, ridge, have, strict=True)]

    for _ in range(MOST_ROUNDS):
        down = slope(step, now)
        if max(map(abs, down)) <= TOLERANCE * total:
            break
        move = solved([[x + (ridge[j] if j == k else 0.0) for k, x in enumerate(row)] for j, row in enumerate(gram)], [-x for x in down])
        fall, before, size = sum(x * y for x, y in zip(down, move, strict=True)), cost(step, half), 1.0
        while True:
            tried = [x + size * m for x, m in zip(step, move, strict=True)]
            now, gram, half = sums(tried)
            if cost(tried, half) <= before + 1e-4 * size * fall + 1e-12 * abs(before) or size < 1e-12:
                break
            size /= 2
        step = tried
    else:
        log.warning("rates after %d rounds: slope %g of %g tokens", MOST_ROUNDS, max(map(abs, slope(step, now))), total)
    return step, max(abs(x - w) for x, w in zip(now, want, strict=True)) / (total or 1.0)


def _members(df: DataFrame, labelled: DataFrame, names: list[str], id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    classifier = fit(df, labelled, id_col, text_col)
    names = names + [d for d in (classifier.domains if classifier else []) if d not in names]
    return settled(memberships(df, classifier, names, id_col, text_col)), names


def mix(df: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None, anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p array<double>, rate, residual) of each row; `targets` has a weight for each domain, `p` follows its names in order, then other labelled domains; `residual` is by how much of all tokens a domain misses its target at most. `total` and `anchor` (a domain) as in `fit_rates`."""
    member, names = _members(df, labelled, sorted(targets), id_col, text_col)
    step, residual = fit_rates(member, [targets.get(d, 0.0) for d in names], total, None if anchor is None else names.index(anchor))
    return member.withColumns({"rate": F.round(rate(F.col("p"), step), 6), "residual": F.lit(residual)})


def drawn(mixed: DataFrame, seed: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The rows that a draw by their rates keeps: all of rate 1 and more, of others a share of `rate`, by a hash of id and seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return mixed.where(uniform < F.col("rate"))
