"""Live probes: the four of them, asked batch after batch, resumable at every batch.

A probe asks rows in their order, 50 to a batch. The examples of a batch are the last three
rows answered correctly before it; inside a batch every prompt carries the true answers
of the rows before, so its prompts do not depend on each other's outcome. The per-user
probe keeps that order inside each user. Live runs therefore go in waves: wave w asks
batch w of *every* user in one job, scores the answers, publishes them in the ledger, and
renews a table (user, last three correct) which opens the next wave. The work of a wave is
spread over all users' rows, and no user's history is ever in one task: a task sees prompts
of at most one batch each.

Each wave is one committed run of the ledger (:mod:`mnemo.sources.commits`). A run that
stopped anywhere goes on with the rows that the ledger lacks; batches are always those of
the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions.names import output_name
from mnemo.functions.text import record_string
from mnemo.operators import generate, prompts, scoring
from mnemo.operators.positions import batch_ids, index_within_group
from mnemo.session import materialize
from mnemo.sources.commits import RunLog


@dataclass(frozen=True)
class Probe:
    """What tells the probes apart. ``rows`` makes (group..., key, pos, user_msg, asst_msg) of
    the probed table; ``score`` makes ledger rows of table rows and answers."""
    name: str
    key: str                                     # of the table and of the ledger
    system: str
    rows: Callable[[DataFrame], DataFrame]
    score: Callable[[DataFrame, DataFrame], DataFrame]
    schema: str                                  # of the ledger
    real: str                                    # the ledger's column of the true answer
    groups: tuple[str, ...] = ()                 # asked independently of each other
    fallback: tuple[str, ...] = ()               # whose first rows open a group's first batch
    seeded: bool = True                          # a resumed run begins with the ledger's last three rows


def _title_rows(items: DataFrame) -> DataFrame:
    return prompts.title_rows(items.withColumn("ErrorFlag", F.lit(1)).withColumn("RealTitle", F.col("Title"))).drop("flag")


def _record_rows(fields: Sequence[str], *extra: str) -> Callable[[DataFrame], DataFrame]:
    def rows(table: DataFrame) -> DataFrame:
        made = table.withColumn("_real", record_string(*fields)).withColumn("ErrorFlag", F.lit(1))
        return prompts.record_rows(made, "_real", extra=extra).drop("flag")
    return rows


def _user_rows(table: DataFrame) -> DataFrame:
    """Positions are counted inside a user; the order inside a tier is the table's."""
    made = index_within_group(table, ["UserID"], "RowIndex", "_pos")
    rows = _record_rows(("UserID", "MovieID"), "UserID", "tier", "_pos")(made)
    return rows.withColumn("_order", F.col("key")).withColumn("pos", F.col("_pos")).drop("_pos")


_INTERACTIONS = "RowIndex long, GeneratedInteraction string, RealInteraction string, ErrorFlag int, UserID long"
TITLES = Probe("titles", "MovieID", prompts.TITLE_SYSTEM, _title_rows, scoring.score_titles,
               "MovieID long, GeneratedTitle string, RealTitle string, ErrorFlag int, ItemPos long", "RealTitle")
INTERACTIONS = Probe("interactions", "RowIndex", prompts.INTERACTION_SYSTEM, _record_rows(("UserID", "MovieID")),
                     scoring.score_interactions, _INTERACTIONS, "RealInteraction")
USERS = Probe("users", "RowIndex", prompts.USER_ATTRIBUTE_SYSTEM,
              _record_rows(("UserID", "Gender", "Age", "Occupation", "Zip_code")), scoring.score_users,
              "RowIndex long, GeneratedUser string, RealUser string, ErrorFlag int", "RealUser")
#: Over (UserID, MovieID, RowIndex, tier); every run begins a user's examples anew.
USER_INTERACTIONS = Probe("user_interactions", "RowIndex", prompts.USER_INTERACTION_SYSTEM, _user_rows,
                          lambda rows, answers: scoring.score_interactions(rows, answers, scoring.USER_INTERACTION_RULE),
                          _INTERACTIONS, "RealInteraction", ("UserID",), ("tier",), False)


def ledger(spark, out_dir: str, probe: Probe, model: str) -> RunLog:
    """The committed runs of a probe of a model; the folder bears the model's name."""
    return RunLog(spark, f"{out_dir}/{output_name(model)}/{probe.name}")


#: The table of ``keep_prompts``.
PROMPTS = "key long, messages array<struct<role:string,content:string>>"


def stored(spark, out_dir: str, probe: Probe, model: str) -> DataFrame:
    """The ledger's rows; none before the first run."""
    return ledger(spark, out_dir, probe, model).read("ledger", probe.schema)


def pending_rows(table: DataFrame, probe: Probe, done: DataFrame) -> DataFrame:
    """Prompt rows of the table that the ledger lacks, positioned in the whole table."""
    return probe.rows(table).join(done.select(F.col(probe.key).alias("key")).distinct(), "key", "left_anti")


def seed_rows(probe: Probe, done: DataFrame) -> DataFrame | None:
    """(pos, user_msg, asst_msg) of the ledger's last three rows, correct or not; None where
    the probe takes none."""
    if not probe.seeded:
        return None
    if probe.real == "RealTitle":
        made = prompts.title_rows(done)
    else:
        made = prompts.record_rows(done, probe.real)
    return prompts.last_three(made, "pos")


def resumed_prompts(table: DataFrame, probe: Probe, done: DataFrame, flags: DataFrame, batch_size: int = prompts.BATCH_SIZE) -> DataFrame:
    """(group..., key, pos, batch, messages) of a second run in replay: of the rows that
    ``done`` lacks, with the outcomes ``flags`` (key, flag) that the run will have."""
    rows = pending_rows(table, probe, done).join(flags, "key")
    return prompts.build_prompts(rows, probe.system, batch_size, group_cols=probe.groups, fallback_cols=probe.fallback,
                                 seed=seed_rows(probe, done))


class _Examples:
    """The examples that open the next wave: the last three correct rows of each group. They
    are three rows for a probe without groups and a table of three rows a group otherwise."""

    def __init__(self, probe: Probe, rows: DataFrame, done: DataFrame):
        self.probe = probe
        order = "_order" if "_order" in rows.columns else "pos"
        first = prompts.initial_examples(rows, group_cols=probe.fallback, order_col=order)
        seed = seed_rows(probe, done)
        if probe.groups:
            self.first = materialize(first.groupBy(*probe.fallback).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("slot", "user_msg", "asst_msg"))),
                            lambda x: F.struct(x["user_msg"], x["asst_msg"])).alias("_first")))
            self.last: DataFrame | None = None
        else:
            self.first = [(r.user_msg, r.asst_msg) for r in first.orderBy("slot").collect()]
            self.own = [(r.user_msg, r.asst_msg) for r in seed.orderBy("pos").collect()] if seed is not None else []

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``ex``, an array of (user_msg, asst_msg)."""
        if not self.probe.groups:
            pairs = self.own or self.first
            form = "array<struct<user_msg:string,asst_msg:string>>"
            return rows.withColumn("ex", F.array(*[F.struct(F.lit(u).alias("user_msg"), F.lit(a).alias("asst_msg")) for u, a in pairs]).cast(form))
        out = rows.join(self.first, list(self.probe.fallback))
        if self.last is None:
            return out.withColumn("ex", F.col("_first")).drop("_first")
        return (out.join(self.last, list(self.probe.groups), "left").withColumn("ex", F.coalesce("_last", "_first"))
                .drop("_first", "_last"))

    def renew(self, correct: DataFrame) -> None:
        """Take in the correct rows (group..., pos, user_msg, asst_msg) of a wave."""
        k, g = prompts.N_EXAMPLES, list(self.probe.groups)
        if not g:
            new = correct.orderBy(F.col("pos").desc()).limit(k).collect()[::-1]
            self.own = (self.own + [(r.user_msg, r.asst_msg) for r in new])[-k:]
            return
        w = Window.partitionBy(*g).orderBy(F.col("pos").desc())
        pair = F.struct("pos", "user_msg", "asst_msg")
        new = (correct.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).groupBy(*g)
               .agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.struct(x["user_msg"], x["asst_msg"])).alias("_new")))
        if self.last is None:
            self.last = materialize(new.withColumnRenamed("_new", "_last"))
        else:
            none = F.array().cast("array<struct<user_msg:string,asst_msg:string>>")
            both = F.concat(F.coalesce("_last", none), F.coalesce("_new", none))
            at = F.greatest(F.size(both) - (k - 1), F.lit(1))
            self.last = materialize(self.last.join(new, g, "full").select(*g, F.slice(both, at, F.lit(k)).alias("_last")))


def probe_live(table: DataFrame, probe: Probe, responder, out_dir: str, model: str, batch_size: int = prompts.BATCH_SIZE,
               renew: int | None = 1, keep_prompts: bool = False, **calls) -> DataFrame:
    """Ask all rows of ``table`` that the ledger lacks, and return the ledger's rows.

    A wave is ``renew`` batches of every group (None: all batches in one wave, whose
    examples are those of its start). If a wave leaves prompts unasked (the responder's
    breaker opened), its answers are published and the run ends there; the next goes on.
    With ``keep_prompts`` a run also has a table ``prompts`` (key, messages) of what was asked.
    ``calls`` are arguments of :func:`generate.generate`. A failed call is in the ledger as
    the reference's error text; a second run over the same table appends nothing.
    """
    spark = table.sparkSession
    log = ledger(spark, out_dir, probe, model)
    done = log.read("ledger", probe.schema)
    rows = batch_ids(pending_rows(table, probe, done), "pos", batch_size)
    rows = rows.withColumn("wave", F.floor(F.col("batch") / renew).cast("long") if renew else F.lit(0).cast("long"))
    # sorted by wave, so that a wave reads the parts it is in
    rows = materialize(rows.repartitionByRange("wave", "key").sortWithinPartitions("wave"))
    waves = [r.wave for r in rows.select("wave").distinct().orderBy("wave").collect()]  # one number a wave
    if not waves:
        return done
    examples = _Examples(probe, probe.rows(table), done)
    for wave in waves:
        now = rows.filter(F.col("wave") == wave)
        asked = prompts.with_messages(examples.attach(now), probe.system, [*probe.groups, "batch"])
        answers = materialize(generate.generate(asked, responder, **calls))  # the back end is asked once
        whole = answers.filter(F.col("status") == "pending").isEmpty()
        answers = generate.answered(answers).withColumnRenamed("key", probe.key)
        run = log.begin()
        run.write(probe.score(table.join(answers.select(probe.key), probe.key, "left_semi"), answers), "ledger")
        if keep_prompts:
            run.write(asked.join(answers.select(F.col(probe.key).alias("key")), "key", "left_semi"), "prompts")
        run.commit()
        if not whole:
            break
        if wave != waves[-1]:
            right = run.read("ledger", probe.schema).filter("ErrorFlag = 0").select(F.col(probe.key).alias("key"))
            examples.renew(now.join(right, "key", "left_semi"))
    return log.read("ledger", probe.schema)
