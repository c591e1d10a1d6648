"""Live probes against a sequential run, committed runs, and responders that fail."""
import pytest
from pyspark.sql import functions as F

from mnemo.functions.similarity import indel_ratio_py
from mnemo.operators import generate as G
from mnemo.operators import prompts
from mnemo.plans import flows, probing
from mnemo.session import scratch_path
from mnemo.sources import ledger
from mnemo.sources.commits import Conflict, RunLog
from mnemo.streaming.ledger_stream import score_stream


# ------------------------------------------------------------------ a sequential run, as the reference's loop

def sequential(rows, system, ask, threshold, size, first, last, per_group, done=()):
    """rows: [(group, key, question, truth)] in order; what is asked and how it is scored."""
    out = {}
    groups = list(dict.fromkeys(g for g, *_ in rows)) if per_group else [None]
    for group in groups:
        own = [r for r in rows if group is None or r[0] == group]
        examples = list(last)
        for at in range(0, len(own), size):
            now = [r for r in own[at:at + size] if r[1] not in done]
            messages = [("system", system)]
            for q, a in examples or first(group):
                messages += [("user", q), ("assistant", a)]
            for _, key, question, truth in now:
                messages.append(("user", question))
                answer = ask(messages)
                score = indel_ratio_py(answer, truth)
                out[key] = (list(messages), answer, 0 if round(score, 2) > threshold else 1)
                if out[key][2] == 0:
                    examples = (examples + [(question, truth)])[-3:]
                messages.append(("assistant", truth))
    return out


def stub(seed):
    """Answers by the question and the length of the talk, so examples matter: often the
    last answer it saw, sometimes one that is right."""
    def ask(batch):
        out = []
        for m in batch:
            said = [x["content"] for x in m if x["role"] == "assistant"]
            out.append(said[-1] if (len(m) + seed) % 3 else said[len(said) // 2])
        return out
    return ask


def as_stub(ask):
    return lambda messages: ask([[{"role": r, "content": c} for r, c in messages]])[0]


def interactions(spark):
    """Users of 1 to 17 rows, among few items, in mixed order."""
    rows, k = [], 0
    for turn in range(17):
        for user in range(8):
            if turn <= user * 2 + (user == 7) * 2:
                rows.append((1000 + user, 5000 + (turn * user) % 2, k, "top" if user % 2 else "bottom"))
                k += 1
    return rows, spark.createDataFrame(rows, "UserID long, MovieID long, RowIndex long, tier string").repartition(3)


def asked(log):
    return {r.key: [(m.role, m.content) for m in r.messages] for r in log.read("prompts", probing.PROMPTS).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_users_live_equal_a_sequential_run(spark, seed):
    rows, table = interactions(spark)
    out = scratch_path(spark, "live")
    done = probing.probe_live(table, probing.USER_INTERACTIONS, stub(seed), out, "a/b", batch_size=5, keep_prompts=True, max_attempts=1)
    tier = {u: t for u, _, _, t in rows}
    first = {t: [(f"{u}::", f"{u}::{m}") for u, m, _, x in rows if x == t][:3] for t in ("top", "bottom")}
    want = sequential([(u, k, f"{u}::", f"{u}::{m}") for u, m, k, _ in rows], prompts.USER_INTERACTION_SYSTEM.format(dataset=prompts.DATASET_NAME),
                      as_stub(stub(seed)), 90, 5, lambda u: first[tier[u]], [], True)
    got = {r.RowIndex: (r.GeneratedInteraction, r.ErrorFlag) for r in done.collect()}
    assert got == {k: v[1:] for k, v in want.items()} and {f for _, f in got.values()} == {0, 1}
    assert asked(probing.ledger(spark, out, probing.USER_INTERACTIONS, "a/b")) == {k: v[0] for k, v in want.items()}
    log = probing.ledger(spark, out, probing.USER_INTERACTIONS, "a/b")
    assert len(log.committed()) == 4  # one run a wave: 17 rows of the longest user
    again = probing.probe_live(table, probing.USER_INTERACTIONS, stub(seed), out, "a/b", batch_size=5, max_attempts=1)
    assert again.count() == len(rows) and len(log.committed()) == 4


def test_interactions_live_with_renewed_examples_and_resume(spark):
    rows, table = interactions(spark)
    system = prompts.INTERACTION_SYSTEM.format(dataset=prompts.DATASET_NAME)
    flat = [(None, k, f"{u}::", f"{u}::{m}") for u, m, k, _ in rows]
    first = [(q, a) for _, _, q, a in flat[:3]]
    out = scratch_path(spark, "live")
    run = lambda t: probing.probe_live(t, probing.INTERACTIONS, stub(0), out, "m", batch_size=20, keep_prompts=True, max_attempts=1)
    run(table.where("RowIndex < 30"))
    before = sequential(flat[:30], system, as_stub(stub(0)), 80, 20, lambda _: first, [], False)
    run(table)
    # the second run opens with the ledger's last three rows, and its batches are the whole table's
    after = sequential(flat, system, as_stub(stub(0)), 80, 20, lambda _: first, [(q, a) for _, _, q, a in flat[27:30]], False, set(range(30)))
    assert asked(probing.ledger(spark, out, probing.INTERACTIONS, "m")) == {k: v[0] for k, v in (before | after).items()}
    got = {r.RowIndex: r.ErrorFlag for r in probing.stored(spark, out, probing.INTERACTIONS, "m").collect()}
    assert got == {k: v[2] for k, v in (before | after).items()}


def test_titles_and_users_live(spark):
    items = spark.createDataFrame([(i, f"Title number {i % 4}", i) for i in range(25)], "MovieID long, Title string, ItemPos long")
    out = scratch_path(spark, "live")
    flat = [(None, i, f"Input: {i}::", f"{i}::Title number {i % 4}\n") for i in range(25)]

    def ask(batch):  # the last title it was told
        return [[x["content"] for x in m if x["role"] == "assistant"][-1].split("::")[1].strip() for m in batch]

    flows.probe_titles(items, ask, out, "m", batch_size=10, max_attempts=1, renew=1)
    log = probing.ledger(spark, out, probing.TITLES, "m")
    assert len(log.committed()) == 3 and log.read("ledger", probing.TITLES.schema).count() == 25
    flags = {r.MovieID: r.ErrorFlag for r in log.read("ledger", probing.TITLES.schema).collect()}
    # similarity of two titles of different numbers is 14/14 letters but one: over 80
    assert set(flags.values()) == {0} and len(flat) == 25
    users = spark.createDataFrame([(7 * i, "F", 25, 3, "02115", i) for i in range(12)],
                                  "UserID long, Gender string, Age int, Occupation int, Zip_code string, RowIndex long")
    for _ in range(2):
        done = probing.probe_live(users, probing.USERS, stub(0), out, "m", batch_size=5, max_attempts=1)
        assert done.count() == 12 and len(probing.ledger(spark, out, probing.USERS, "m").committed()) == 3


def test_empty_tables(spark):
    rows, table = interactions(spark)
    out = scratch_path(spark, "live")
    for probe in (probing.USER_INTERACTIONS, probing.INTERACTIONS):
        assert probing.probe_live(table.where("false"), probe, stub(0), out, "m").count() == 0


# ------------------------------------------------------------------ committed runs

def test_a_run_is_whole_or_not_there(spark):
    log = RunLog(spark, scratch_path(spark, "runs"))
    assert log.read("t", "x long").count() == 0
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x long")
    run = log.begin()
    run.write(rows(1, 2), "t")           # stopped between its tables
    assert log.read("t", "x long").count() == 0
    run = log.begin()
    run.write(rows(1, 2), "t")
    run.write(rows(9), "u")              # stopped before it is published
    assert log.read("t", "x long").count() == log.read("u", "x long").count() == 0
    run.commit()
    assert sorted(r.x for r in log.read("t", "x long").collect()) == [1, 2] and log.read("u", "x long").count() == 1
    one, two = log.begin(), log.begin()
    one.write(rows(3), "t")
    two.write(rows(4), "t")
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert sorted(r.x for r in log.read("t", "x long").collect()) == [1, 2, 3]
    three = log.begin()
    three.write(rows(5), "t")
    three.commit()
    assert len(log.committed()) == 3


def test_recommender_stopped_at_every_step(spark, monkeypatch):
    train = spark.createDataFrame([(u, f"t{u}") for u in range(6)], "UserID long, Title string")
    test = spark.createDataFrame([(u, f"x{u}") for u in range(5)], "UserID long, Title string")
    answers = spark.createDataFrame([(u, "1. a\n2. b") for u in range(4)] + [(4, None)], "UserID long, output string")
    from mnemo.sources import commits
    steps = {"write": commits.Run.write, "commit": commits.Run.commit}
    out = scratch_path(spark, "rec")
    for name, at in (("write", 1), ("write", 2), ("commit", 1)):
        calls = {"n": 0}

        def stop(self, *args, name=name, at=at, calls=calls):
            calls["n"] += 1
            if calls["n"] == at:
                raise KeyboardInterrupt
            return steps[name](self, *args)

        monkeypatch.setattr(commits.Run, name, stop)
        with pytest.raises(KeyboardInterrupt):
            flows.recommend_resumable(train, test, answers, out)
        monkeypatch.setattr(commits.Run, name, steps[name])
    for _ in range(2):
        done, recs = flows.recommend_resumable(train, test, answers, out)
        assert sorted(map(tuple, done.collect())) == [(0, "done"), (1, "done"), (2, "done"), (3, "done"), (5, "skipped")]
        assert recs.count() == 8


def test_stream_with_a_slash_in_the_model(spark):
    src, path = scratch_path(spark, "in"), scratch_path(spark, "ledger")
    spark.createDataFrame([(1, "b"), (2, "c")], "k long, output string").write.parquet(src)
    for run in ("c1", "c2"):
        score_stream(spark, src, "k long, output string", lambda df: df, path, scratch_path(spark, run), "k", "org/m")
    rows = ledger.of_model(ledger.read(spark, path), "org/m").collect()
    assert sorted((r.k, r.model) for r in rows) == [(1, "org_m"), (2, "org_m")]


# ------------------------------------------------------------------ responders that fail

def questions(n):
    return [[{"role": "user", "content": str(i)}] for i in range(n)]


class Counting:
    def __init__(self, bad=(), dead=False):
        self.calls, self.asked, self.bad, self.dead = 0, 0, set(bad), dead

    def __call__(self, batch):
        self.calls += 1
        self.asked += len(batch)
        numbers = [int(m[-1]["content"]) for m in batch]
        if self.dead or self.bad & set(numbers):
            raise RuntimeError
        return [str(n) for n in numbers]


def test_bisection_costs_few_calls():
    back = Counting(bad=[37])
    caller = G.Caller(back, 3, 0.0, 0.0, 100)
    got = caller.ask(questions(64))
    assert got == [(None, "failed") if i == 37 else (str(i), "ok") for i in range(64)]
    assert back.calls <= 2 * 6 + 1 + 3 and back.asked < 64 * 4


def test_dead_back_end_costs_a_bounded_number_of_calls():
    back = Counting(dead=True)
    caller = G.Caller(back, 50, 0.0, 0.0, 20)
    got = [x for at in range(0, 10_000, 64) for x in caller.ask(questions(10_000)[at:at + 64])]
    assert back.calls <= 20 + 7 and {s for _, s in got} == {"pending"} and len(got) == 10_000


def test_next_run_goes_on_after_a_dead_back_end(spark):
    items = spark.createDataFrame([(i, f"Title {i}", i) for i in range(40)], "MovieID long, Title string, ItemPos long").coalesce(1)
    out = scratch_path(spark, "dead")

    def dies(batch):
        if any("Input: 2" in m[-1]["content"] for m in batch):
            raise RuntimeError
        return G.echo_responder(batch)

    run = lambda ask, **more: probing.probe_live(items, probing.TITLES, ask, out, "m", batch_size=10, max_attempts=3,
                                                 backoff_min=0.0, backoff_max=0.0, **more)
    first = run(dies, call_size=4, breaker=4)
    keys = {r.MovieID for r in first.collect()}
    assert keys < set(range(40)) and keys  # what was answered is kept, the rest is open
    assert {r.MovieID for r in run(G.echo_responder).collect()} == set(range(40))
    assert run(dies).count() == 40


def test_call_size_is_its_own(spark):
    rows = spark.range(100).select(F.col("id").alias("key"), F.array(F.struct(
        F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages")).coalesce(1)

    def sizes(batch):
        return [str(len(batch))] * len(batch)

    assert {r.output for r in G.generate(rows, sizes, call_size=30).collect()} == {"30", "10"}
