"""Few-shot, teacher-forced chat prompts for the probes (replay mode).

Given a table of probe rows with their correctness, every prompt is exact and
independent, so all of them are built in parallel:

* batch b holds rows with ``floor(pos / batch_size) = b`` (pos counted over the
  whole table, or inside a user for the per-user probe);
* its examples are the last <= k correct rows before the batch starts: number
  correct rows by a prefix count, take C0 = correct rows before the batch (an
  exclusive prefix sum over per-batch counts) and equi-join numbers C0-k+1..C0;
  with C0 = 0 the first k rows of the table (per fallback group) are used;
* the transcript of a row is every earlier row of its batch with the true
  answer, a window bounded by the batch size.

A message is ``struct(role, content)``; a prompt is an array of messages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.operators.positions import batch_ids, index_within_group, prefix_sum

DATASET_NAME = "MovieLens 1M"
BATCH_SIZE = 50
N_EXAMPLES = 3

# System prompts of the reference probes ({dataset} is the dataset name).
TITLE_SYSTEM = (
    "You are the {dataset} dataset. "
    "When given a lookup key (e.g., a MovieID), you will respond with the exact corresponding value from the dataset. "
    "Only respond with the value itself. If the key is unknown, respond with 'Unknown'. "
    "Below are examples of queries and their correct responses:\n\n"
    "Follow this pattern strictly. Let's think step by step."
)
INTERACTION_SYSTEM = (
    "You are a Recommender Systems. "
    "Continue user-item interactions list providing the next interaction "
    "based on the {dataset} dataset. "
    "When given 'UserID, CurrentInteraction', respond with 'UserID, NextInteraction'. "
    "If the next interaction is unknown, respond with 'Unknown'. "
    "\nBelow are examples of queries and their correct responses:\n\n"
    "Follow this pattern strictly. Let's think step by step."
)
USER_INTERACTION_SYSTEM = (
    "You are a Recommender Systems. "
    "Continue user-item interactions list providing the next interaction "
    "based on the {dataset} dataset. "
    "When given 'UserID::CurrentInteraction', respond with 'UserID::NextInteraction'. "
    "\nBelow are examples of queries and their correct responses:\n\n"
    "Follow this pattern strictly. Let's think step by step."
)
USER_ATTRIBUTE_SYSTEM = (
    "You are the {dataset} dataset."
    "When given a lookup key (e.g., a UserID), you will respond with the exact corresponding "
    "Gender,Age,Occupation,Zip-code value from the dataset."
    "Only respond with the values itself. If the key is unknown, respond with 'Unknown'."
    "Below are examples of queries and their correct responses:"
    "Follow this pattern strictly. Let's think step by step.\n\n"
)
RECOMMEND_SYSTEM = (
    "You are a movie recommendation system for the {dataset} dataset. "
    "Based on the user's past interactions, generate a ranked list of exactly 50 new movie recommendations. "
    "Your output must contain only the list in the following format: one line per recommendation in the exact "
    "format 'Rank. Title' (e.g., '1. Harry Potter'). "
    "Do not include any additional text, commentary, or explanation."
)
RECOMMEND_USER = (
    "User {user} has interacted with the following movies: {history}. "
    "Based solely on these interactions, please generate a ranked list of exactly 50 movie recommendations. "
    "Output only the list with no additional commentary or explanation. "
    "Each recommendation must be on a new line in the exact format: 'Rank. Title' (for example: '1. Harry Potter')."
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


# --------------------------------------------------------------------------- probe rows

def title_rows(results: DataFrame) -> DataFrame:
    """(key, pos, flag, user_msg, asst_msg) from scored titles in table order."""
    mid = F.col("MovieID").cast("string")
    return results.select(F.col("MovieID").alias("key"), F.col("ItemPos").alias("pos"), F.col("ErrorFlag").alias("flag"),
                          F.concat(F.lit("Input: "), mid, F.lit("::")).alias("user_msg"),
                          F.concat(mid, F.lit("::"), F.col("RealTitle"), F.lit("\n")).alias("asst_msg"))


def record_rows(results: DataFrame, real_col: str, extra: Sequence[str] = ()) -> DataFrame:
    """(key, pos, flag, user_msg, asst_msg) for interaction / user records 'U::...'."""
    real = F.col(real_col)
    return results.select(F.col("RowIndex").alias("key"), F.col("RowIndex").alias("pos"), F.col("ErrorFlag").alias("flag"),
                          F.concat(F.split_part(real, F.lit("::"), F.lit(1)), F.lit("::")).alias("user_msg"),
                          real.alias("asst_msg"), *extra)


# --------------------------------------------------------------------------- examples

def initial_examples(rows: DataFrame, k: int = N_EXAMPLES, group_cols: Sequence[str] = (),
                     order_col: str = "key") -> DataFrame:
    """First k rows of the table (per fallback group): (group..., slot, user_msg, asst_msg).
    row_number() <= k keeps k rows per group in each partition before the shuffle."""
    g = list(group_cols)
    w = Window.partitionBy(*g).orderBy(order_col) if g else Window.orderBy("pos")
    first = rows if g else rows.orderBy("pos").limit(k)  # k rows, whatever their positions
    return (first.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= k)
            .select(*g, F.col("slot").cast("long").alias("slot"), "user_msg", "asst_msg"))


def last_three(ledger: DataFrame, order_col: str, k: int = N_EXAMPLES) -> DataFrame:
    """The last k ledger rows in append order, whatever their correctness (resume seed)."""
    return ledger.orderBy(F.col(order_col).desc()).limit(k)


def fewshot_examples(rows: DataFrame, batch_size: int = BATCH_SIZE, k: int = N_EXAMPLES,
                     group_cols: Sequence[str] = (), fallback_cols: Sequence[str] = (),
                     seed: DataFrame | None = None) -> DataFrame:
    """(group..., batch, slot, ex_pos, user_msg, asst_msg): the examples of every batch.

    ``seed`` resumes an earlier run: its (pos, user_msg, asst_msg), at most ``k`` rows in
    ``pos`` order (see ``last_three``), stand before all of ``rows`` as if they were correct.
    Without groups only.

    ``rows`` has (group..., pos, flag, user_msg, asst_msg, fallback...); pos is 0-based
    within the group. Slots are oldest first.
    """
    g, fb = list(group_cols), list(fallback_cols)
    rows = batch_ids(rows, "pos", batch_size)
    old = seed.orderBy("pos").select("user_msg", "asst_msg").limit(k).collect() if seed is not None else []  # k rows
    correct = (index_within_group(rows.filter(F.col("flag") == 0), g, "pos", "cnum", start=1 + len(old))
               .select(*g, "cnum", F.col("pos").alias("ex_pos"), "user_msg", "asst_msg"))
    if old:
        first = rows.sparkSession.createDataFrame([(i + 1, None, *r) for i, r in enumerate(old)],
                                                  "cnum long, ex_pos long, user_msg string, asst_msg string")
        correct = correct.unionByName(first)
    per_batch = rows.groupBy(*g, *[c for c in fb if c not in g], "batch").agg(
        F.sum(F.when(F.col("flag") == 0, 1).otherwise(0)).alias("nc"))
    c0 = prefix_sum(per_batch, "nc", "batch", "C0", group_cols=g, inclusive=False).withColumn("C0", F.col("C0") + len(old))
    lo = F.greatest(F.col("C0") - (k - 1), F.lit(1))
    wanted = (c0.filter(F.col("C0") > 0)
              .select(*g, "batch", lo.alias("lo"), F.explode(F.sequence(lo, F.col("C0"))).alias("cnum")))
    found = (wanted.join(correct, [*g, "cnum"])
             .select(*g, "batch", (F.col("cnum") - F.col("lo") + 1).alias("slot"), "ex_pos", "user_msg", "asst_msg"))
    init = initial_examples(rows, k, fb, order_col="_order" if "_order" in rows.columns else "key")
    empty = c0.filter(F.col("C0") == 0).select(*g, *[c for c in fb if c not in g], "batch")
    if fb:   # first k rows per fallback group: an equi join on the group
        fallback = empty.join(init.withColumnRenamed("slot", "s"), fb).select(
            *g, "batch", F.col("s").alias("slot"), "user_msg", "asst_msg")
    else:    # the table's first k rows (k <= 3) become a literal array attached to each batch
        first = init.orderBy("slot").collect()
        if not first:
            return found
        lits = F.array(*[F.struct(F.lit(r.slot).cast("long").alias("slot"), F.lit(r.user_msg).alias("user_msg"),
                                  F.lit(r.asst_msg).alias("asst_msg")) for r in first])
        fallback = empty.select(*g, "batch", F.inline(lits))
    return found.unionByName(fallback.withColumn("ex_pos", F.lit(None).cast("long")))


# --------------------------------------------------------------------------- prompts

def build_prompts(rows: DataFrame, system: str, batch_size: int = BATCH_SIZE, k: int = N_EXAMPLES,
                  group_cols: Sequence[str] = (), fallback_cols: Sequence[str] = (),
                  dataset: str = DATASET_NAME, seed: DataFrame | None = None) -> DataFrame:
    """(group..., key, pos, batch, messages) for every probe row; ``seed`` as in
    :func:`fewshot_examples`. Rows that an earlier run has done are not in ``rows``: they
    are in no transcript, and positions (so batches) are those of the whole table."""
    g = list(group_cols)
    ex = fewshot_examples(rows, batch_size, k, g, fallback_cols, seed)
    ex_arr = ex.groupBy(*g, "batch").agg(F.array_sort(F.collect_list(F.struct("slot", "user_msg", "asst_msg"))).alias("ex"))
    b = batch_ids(rows, "pos", batch_size)
    w = Window.partitionBy(*g, "batch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pair = lambda s: F.array(message("user", s["user_msg"]), message("assistant", s["asst_msg"]))
    # messages are made once a row, before the rows after it collect them
    b = b.withColumn("_pair", pair({"user_msg": F.col("user_msg"), "asst_msg": F.col("asst_msg")}))
    b = b.withColumn("tr", F.collect_list("_pair").over(w)).drop("_pair")
    j = b.join(ex_arr, [*g, "batch"], "left")
    msgs = F.concat(F.array(message("system", F.lit(system.format(dataset=dataset)))),
                    F.flatten(F.transform(F.coalesce(F.col("ex"), F.array().cast("array<struct<slot:long,user_msg:string,asst_msg:string>>")), pair)),
                    F.flatten("tr"),
                    F.array(message("user", F.col("user_msg"))))
    return j.select(*g, "key", "pos", "batch", msgs.alias("messages"))


def with_messages(rows: DataFrame, system: str, batch_cols: Sequence[str], dataset: str = DATASET_NAME) -> DataFrame:
    """(key, messages) of rows (batch_cols..., key, pos, user_msg, asst_msg, ex): the system
    prompt, the examples ``ex`` (an array of (user_msg, asst_msg)), the rows of the batch
    before with their true answers, and the row's own question."""
    w = Window.partitionBy(*batch_cols).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pair = lambda s: F.array(message("user", s["user_msg"]), message("assistant", s["asst_msg"]))
    before = F.collect_list(F.struct("user_msg", "asst_msg")).over(w)
    return rows.withColumn("tr", before).select("key", F.concat(
        F.array(message("system", F.lit(system.format(dataset=dataset)))), F.flatten(F.transform("ex", pair)),
        F.flatten(F.transform("tr", pair)), F.array(message("user", F.col("user_msg")))).alias("messages"))


def prompt_texts(rows: DataFrame, system: str, batch_size: int = BATCH_SIZE, k: int = N_EXAMPLES,
                 group_cols: Sequence[str] = (), fallback_cols: Sequence[str] = (),
                 dataset: str = DATASET_NAME) -> DataFrame:
    """(group..., key, pos, batch, n_messages, prompt): the rendered text of
    :func:`build_prompts` built from per-row pair strings instead of message structs
    (same text as ``render(messages)``, far less array work for long batches)."""
    g = list(group_cols)
    pair_txt = lambda u, a: F.concat(F.lit("user: "), u, F.lit("\nassistant: "), a)
    ex = fewshot_examples(rows, batch_size, k, g, fallback_cols)
    ex_txt = ex.groupBy(*g, "batch").agg(
        F.count(F.lit(1)).alias("n_ex"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", pair_txt(F.col("user_msg"), F.col("asst_msg")).alias("t")))),
                                 lambda s: s["t"]), "\n").alias("ex_text"))
    b = batch_ids(rows, "pos", batch_size)
    w = Window.partitionBy(*g, "batch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("tr", F.collect_list(pair_txt(F.col("user_msg"), F.col("asst_msg"))).over(w))
    j = b.join(ex_txt, [*g, "batch"], "left")
    n_ex = F.coalesce(F.col("n_ex"), F.lit(0))
    text = F.concat_ws("\n", F.lit("system: " + system.format(dataset=dataset)), F.col("ex_text"),
                       F.when(F.size("tr") > 0, F.array_join("tr", "\n")),
                       F.concat(F.lit("user: "), F.col("user_msg")))
    return j.select(*g, "key", "pos", "batch", (2 + 2 * n_ex + 2 * F.size("tr")).cast("long").alias("n_messages"),
                    text.alias("prompt"))


def render(messages) -> Column:
    """One text per prompt: 'role: content' lines."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")


def recommend_prompts(histories: DataFrame, dataset: str = DATASET_NAME) -> DataFrame:
    """(UserID, messages): system message + the user's training history."""
    # one template: its places are filled as arguments, so a history is never read as a format
    form = RECOMMEND_USER.replace("%", "%%").replace("{user}", "%1$s").replace("{history}", "%2$s")
    user = F.format_string(form, F.col("UserID").cast("string"), F.col("history"))
    msgs = F.array(message("system", F.lit(RECOMMEND_SYSTEM.format(dataset=dataset))), message("user", user))
    return histories.select("UserID", msgs.alias("messages"))


def user_probe_rows(results: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per-user probe rows: position inside the user, fallback group = sampling tier."""
    r = results.join(tiers.select("UserID", "tier"), "UserID")
    r = index_within_group(r, ["UserID"], "RowIndex", "UserPos")
    base = record_rows(r, "RealInteraction", extra=["UserID", "tier", "UserPos"])
    return base.withColumn("_order", F.col("key")).withColumn("pos", F.col("UserPos")).drop("UserPos")
