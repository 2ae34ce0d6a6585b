"""Pass rates, failure reasons and usage from run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import as_col, contains_any, first_line_with, truncate


def with_missing_trials(rewards: DataFrame, trials: DataFrame, keys: Sequence[str] = ("task", "trial")) -> DataFrame:
    """Every known trial with its reward; a trial that left none scores 0."""
    scored = rewards.select(*keys, F.col("reward").try_cast("double").alias("reward"))
    return trials.select(*keys).join(scored, list(keys), "left").withColumn("reward", F.coalesce("reward", F.lit(0.0)))


def pass_rates(rewards: DataFrame, k: int = 3, task: str = "task", trial: str = "trial") -> DataFrame:
    """(task, trials, pass_at_1, pass_at_k): mean reward and whether any of the first k trials passed.

    Both sides are reduced before the shuffle, the means to one row and the first trials to k rows per task and map task, so a
    task with most of the trials is no burden.
    """
    means = rewards.groupBy(task).agg(F.count("*").alias("trials"), F.avg("reward").alias("pass_at_1"))
    nth = F.row_number().over(Window.partitionBy(task).orderBy(trial))
    first = rewards.select(task, trial, "reward").withColumn("_nth", nth).filter(F.col("_nth") <= k)
    tries = first.groupBy(F.col(task).alias("_task")).agg(F.max((F.col("reward") >= 1).cast("int")).alias("pass_at_k"))
    return means.join(tries, F.col(task).eqNullSafe(F.col("_task")), "left").drop("_task")


def macro_average(rates: DataFrame) -> DataFrame:
    """Unweighted mean over tasks."""
    return rates.agg(
        F.count("*").alias("tasks"), F.avg("pass_at_1").alias("pass_at_1"), F.avg(F.col("pass_at_k").cast("double")).alias("pass_at_k")
    )


def pass_at_k_estimate(p: Column | str, k: int = 3) -> Column:
    """Chance of at least one pass in k independent tries."""
    return 1 - F.pow(1 - as_col(p), F.lit(k))


def by_difficulty(rates: DataFrame, task: str = "task") -> DataFrame:
    """Hardest first, with a position."""
    # one row per task
    return rates.withColumn("difficulty", F.row_number().over(Window.orderBy("pass_at_1", task)))


def failure_reason(*texts: Column | str, marker: str = "reason=") -> Column:
    """Text after the marker in the first file that has it; files are tried in order."""
    lines = F.coalesce(*[first_line_with(t, marker) for t in texts])
    after = F.regexp_extract(F.trim(lines), f"{marker}(.+)$", 1)
    return F.when(lines.isNull(), F.lit(None).cast("string")).when(after != "", after).otherwise(F.trim(lines))


def last_message(steps: DataFrame, key: Sequence[str], order: str, role: str, text: str, speaker: str, width: int = 400) -> DataFrame:
    """Last non-empty message of one speaker per key, cut for display; one row per key and task is shuffled."""
    said = steps.filter((F.col(role) == speaker) & F.col(text).isNotNull() & (F.col(text) != ""))
    best = said.groupBy(*key).agg(F.max_by(text, order).alias("message"), F.count("*").alias("messages"))
    return best.withColumn("message", truncate("message", width))


def last_message_of(steps: Column | str, speaker: str, width: int = 400) -> Column:
    """The same for a trajectory kept as an array of step structs (source, message)."""
    said = F.filter(as_col(steps), lambda s: (s["source"] == speaker) & s["message"].isNotNull() & (s["message"] != ""))
    return truncate(F.try_element_at(said, F.lit(-1))["message"], width)


def classify(text: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first rule one of whose keywords appears; rules are an ordered table."""
    out: Column | None = None
    for label, keywords in rules:
        hit = contains_any(text, keywords)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def step_counts(trajectories: DataFrame, key: Sequence[str], steps: str = "steps") -> DataFrame:
    """(key..., steps, agent_steps, tool_calls) from nested trajectories, without exploding them."""
    s = F.col(steps)
    calls = F.aggregate(s, F.lit(0), lambda acc, x: acc + F.coalesce(F.greatest(F.size(x["tool_calls"]), F.lit(0)), F.lit(0)))
    return trajectories.select(
        *key, F.size(s).alias("steps"), F.size(F.filter(s, lambda x: x["source"] == "agent")).alias("agent_steps"), calls.alias("tool_calls")
    )


def tool_usage(trajectories: DataFrame, key: Sequence[str], steps: str = "steps") -> DataFrame:
    """(function_name, calls, trajectories)."""
    flat = trajectories.select(*key, F.explode(steps).alias("s"))
    calls = flat.select(*key, F.explode("s.tool_calls").alias("c"))
    per = calls.groupBy(F.col("c.function_name").alias("function_name"), *key).agg(F.count("*").alias("n"))
    return per.groupBy("function_name").agg(F.sum("n").alias("calls"), F.count("*").alias("trajectories"))


def usage(results: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Tokens, cost and duration totals of trial results (input_tokens, output_tokens, cost, started, finished)."""
    seconds = F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return results.groupBy(*by).agg(
        F.count("*").alias("trials"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").alias("cost"), F.sum(seconds / 1e6).alias("seconds"),
    )


def reward_distribution(jobs: DataFrame, rewards: str = "reward") -> DataFrame:
    """(job, reward, trials) from a map reward -> list of trial names."""
    return jobs.select("job", F.explode(rewards).alias("reward", "names")).groupBy(
        "job", F.col("reward").cast("double").alias("reward")
    ).agg(F.sum(F.size("names")).cast("bigint").alias("trials"))
