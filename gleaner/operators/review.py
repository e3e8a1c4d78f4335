"""The review loop: seed, score, judge, retrain, until a rule stops it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import scoring, training


#: Fixed values of the fail-out rules: reviewed documents above which each is asked, share of relevant ones that
#: stops the first, and new relevant ones and share below which the second stops.
MANY_REVIEWED, MANY_SHARE = 300, 0.5
SOME_REVIEWED, FEW_NEW, FEW_SHARE = 150, 3, 0.4


def labelled(found: DataFrame, qrels: DataFrame) -> DataFrame:
    """``found`` with rel from ``qrels`` (doc_id, rel); unjudged documents have 0."""
    return found.join(qrels.select("doc_id", "rel"), "doc_id", "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def seed(pool: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """(doc_id, rel) of the pool's documents (doc_id, rank) down to ``depth``."""
    return labelled(pool.where(F.col("rank") <= depth).select("doc_id"), qrels)


@dataclass(frozen=True)
class Stop:
    """Which rules stop a review; ``reason`` names the first that does."""

    found_all: bool = True
    max_steps: int | None = None
    fail_out: bool = False
    zero_steps: int | None = None

    def reason(self, step: int, reviewed: int, seen: int, relevant: int, new: int, zeros: int) -> str | None:
        share = seen / reviewed if reviewed else 0.0
        if self.found_all and seen >= relevant:
            return "all relevant found"
        if self.max_steps and step >= self.max_steps:
            return "maximum steps"
        if self.fail_out and reviewed > MANY_REVIEWED and share > MANY_SHARE:
            return "many relevant after 300 documents"
        if self.fail_out and reviewed > SOME_REVIEWED and new < FEW_NEW and share < FEW_SHARE:
            return "few relevant after 150 documents"
        if self.zero_steps and zeros > self.zero_steps:
            return "no relevant in recent steps"
        return None


@dataclass
class Review:
    """Outcome of a loop: judgments (step, doc_id, rel), the last model and why it ended."""

    judgments: DataFrame
    model: DataFrame
    reason: str
    steps: int


def sgd_trainer(**options) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def fit(tf: DataFrame, judged: DataFrame) -> DataFrame:
        return training.train_on(tf, judged.select(F.lit("t").alias("topic"), "doc_id", "rel"), **options).select("token", "w")

    return fit


def run(tf: DataFrame, pool: DataFrame, qrels: DataFrame, depth: int = 10, per_step: int = 1, stop: Stop | None = None, trainer: Callable[[DataFrame, DataFrame], DataFrame] | None = None, scan: DataFrame | None = None) -> Review:
    """Reviews one topic.  Each step is one job over ``tf``; judgments are checkpointed, so lineage stays short.

    ``trainer``: (tf, judged) to (token, w); the default is pairwise descent on all judgments so far.
    ``scan``: all documents (doc_id), if those without a weighted token are to be scored as well.
    """
    stop, trainer = stop or Stop(), trainer or sgd_trainer()
    relevant, most = qrels.agg(F.count_if(F.expr("rel > 0")), F.count("*")).first()
    if stop.max_steps is None:
        stop = Stop(stop.found_all, most, stop.fail_out, stop.zero_steps)
    judgments = kept(seed(pool, qrels, depth).select(F.lit(0).alias("step"), "doc_id", "rel"))
    model, step, zeros = kept(trainer(tf, judgments)), 0, 0
    while True:
        step += 1
        scores = scoring.by_index(tf, model, judgments) if scan is None else scoring.by_scan(scan, tf, model, judgments)
        found = scores.orderBy(F.col("score").desc(), "doc_id").limit(per_step)
        new = kept(labelled(found.select("doc_id"), qrels).select(F.lit(step).alias("step"), "doc_id", "rel"))
        judgments = kept(judgments.unionByName(new))
        total = judgments.agg(F.count("*").alias("n"), F.count_if(F.expr("rel > 0")).alias("rel"), F.count_if((F.col("step") == step) & (F.col("rel") > 0)).alias("new"), F.count_if(F.col("step") == step).alias("got")).first()
        zeros = 0 if total.new else zeros + 1
        model = kept(trainer(tf, judgments))
        reason = stop.reason(step, total.n, total.rel, relevant, total.new, zeros) or ("nothing left" if not total.got else None)
        if reason:
            return Review(judgments, model, reason, step)


@dataclass
class Reviews:
    """Outcome of a loop over topics: judgments (topic, step, doc_id, rel), models (topic, token, w), and of each topic why it ended and after how many steps."""

    judgments: DataFrame
    models: DataFrame
    reasons: dict[str, str]
    steps: dict[str, int]


def run_topics(tf: DataFrame, pool: DataFrame, qrels: DataFrame, depth: int = 10, per_step: int = 1, stop: Stop | None = None, trainer: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Reviews:
    """Reviews the topics of ``pool`` (topic, doc_id, rank) together, each by the rules of ``run``.

    A step is one set of jobs over ``tf`` for all topics that are still open, however many there are; the driver holds
    a few numbers a topic.  ``qrels``: topic, doc_id, rel.  ``trainer``: (tf, judged) to (topic, token, w), judged with
    topics; the default is pairwise descent.
    """
    stop, trainer = stop or Stop(), trainer or training.train_on
    both = ["topic", "doc_id"]

    def judge(found: DataFrame, step: int) -> DataFrame:
        rel = F.coalesce("rel", F.lit(0)).alias("rel")
        return found.select(both).join(qrels.select(*both, "rel"), both, "left").select("topic", F.lit(step).alias("step"), "doc_id", rel)

    known = {r.topic: (r.relevant, r.most) for r in qrels.groupBy("topic").agg(F.count_if(F.expr("rel > 0")).alias("relevant"), F.count("*").alias("most")).collect()}
    judgments = kept(judge(pool.where(F.col("rank") <= depth), 0))
    left = {r.topic: 0 for r in judgments.select("topic").distinct().collect()}  # steps since the last relevant one
    models = kept(trainer(tf, judgments))
    ended, reasons, steps, step = models.where("false"), {}, {}, 0
    while left:
        step += 1
        found = scoring.top_by_topic(scoring.by_topic(tf, models, judgments), per_step)
        judgments = kept(judgments.unionByName(judge(found, step)))
        mine = judgments.where(F.col("topic").isin(list(left)))
        now = F.col("step") == step
        totals = mine.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.expr("rel > 0")).alias("rel"), F.count_if(now & (F.col("rel") > 0)).alias("new"), F.count_if(now).alias("got")).collect()
        models = kept(trainer(tf, mine))
        closed = []
        for t in totals:
            relevant, most = known.get(t.topic, (0, 0))
            left[t.topic] = 0 if t.new else left[t.topic] + 1
            rules = stop if stop.max_steps is not None else replace(stop, max_steps=most)
            reason = rules.reason(step, t.n, t.rel, relevant, t.new, left[t.topic]) or ("nothing left" if not t.got else None)
            if reason:
                reasons[t.topic], steps[t.topic] = reason, step
                closed.append(t.topic)
                del left[t.topic]
        if closed:
            ended = kept(ended.unionByName(models.where(F.col("topic").isin(closed))))
            models = models.where(~F.col("topic").isin(closed))
    return Reviews(judgments, ended, reasons, steps)


def curve(judgments: DataFrame) -> DataFrame:
    """(step, new, new_rel, reviewed, rel_seen, step_precision) of each step; precision of what came after the seed."""
    by_step = judgments.groupBy("step").agg(F.count("*").alias("new"), F.count_if(F.expr("rel > 0")).alias("new_rel"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row a step
    after = F.sum(F.when(F.col("step") > 0, F.col("new_rel")).otherwise(0)).over(w)
    return by_step.select("step", "new", "new_rel", F.sum("new").over(w).alias("reviewed"), F.sum("new_rel").over(w).alias("rel_seen"), F.when(F.col("step") > 0, after / F.col("step")).alias("step_precision"))


def average_precision(steps: DataFrame, relevant: int) -> DataFrame:
    """(ap): rel_seen / reviewed summed over the seed and the steps with new relevant, over all relevant; null without any."""
    counted = F.when((F.col("step") == 0) | (F.col("new_rel") > 0), F.col("rel_seen") / F.col("reviewed"))
    return steps.agg((F.sum(counted) / F.nullif(F.lit(relevant), F.lit(0))).alias("ap"))


def already_judged(found: DataFrame, judgments: DataFrame) -> DataFrame:
    """Rows of ``found`` that were judged before; an invariant of the loop is that there are none."""
    return found.join(judgments.select("doc_id"), "doc_id", "left_semi")
