"""Debate rounds: majorities, transitions of agents between rounds, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselattice.functions.scalar import LABELS, ratio, valid_answer

GAME = ["item_id", "family"]


def majorities(calls: DataFrame) -> DataFrame:
    """A row for each item, family and round: the label that alone has the most votes (a tie has none), the most votes,
    and whether all agree on one valid answer."""
    answer = valid_answer(F.col("answer"))
    votes = [F.count_if(answer == x) for x in LABELS]
    most = F.greatest(*votes)
    leaders = F.array_compact(F.array(*[F.when((v == most) & (most > 0), F.lit(x)) for x, v in zip(LABELS, votes, strict=True)]))
    return calls.groupBy(*GAME, "round").agg(
        F.when(F.size(leaders) == 1, leaders[0]).alias("majority"),
        most.alias("majority_size"),
        ((F.count(answer) == F.count("*")) & (F.size(leaders) == 1) & (most == F.count("*"))).alias("consensus"),
        F.count_if(answer.isNull()).alias("n_invalid"),
    )


def _event(kind: Column, changed: Column) -> Column:
    return (
        F.when(kind == "unparsed_transition", "format_failure_transition")
        .when(kind == "correct_to_wrong", "harmful_revision")
        .when(kind == "wrong_to_correct", "successful_correction")
        .when((kind == "wrong_to_wrong") & changed, "wrong_to_wrong_migration")
        .when((kind == "correct_to_correct") & ~changed, "stable_correct")
        .otherwise("stable_wrong")
    )


def transitions(calls: DataFrame) -> DataFrame:
    """A row for each agent and pair of rounds that follow each other. The peers' answers of a round come from a window
    over the round, the next answer from one over the agent: games are small, so windows stay so."""
    peers = W.partitionBy(*GAME, "round")
    agent = W.partitionBy(*GAME, "agent_id").orderBy("round")
    seen = calls.withColumn("peers", F.collect_list(F.struct("agent_id", "answer")).over(peers))
    then = F.lead(F.struct("round", "answer", "correct", "violations")).over(agent)
    moved = seen.withColumn("then", then).filter(F.col("then.round") == F.col("round") + 1)
    before, after = valid_answer(F.col("answer")), valid_answer(F.col("then.answer"))
    both = before.isNotNull() & after.isNotNull()
    side = lambda c: F.when(c, "correct").otherwise("wrong")
    changed = both & ~(F.col("answer").eqNullSafe(F.col("then.answer")))
    shaped = moved.withColumns({
        "valid": both,
        "changed": changed,
        "kind": F.when(both, F.concat(side(F.col("correct")), F.lit("_to_"), side(F.col("then.correct")))).otherwise("unparsed_transition"),
        "introduced": F.when(both, F.array_sort(F.array_except("then.violations", "violations"))).otherwise(F.expr("cast(array() as array<string>)")),
        "resolved": F.when(both, F.array_sort(F.array_except("violations", "then.violations"))).otherwise(F.expr("cast(array() as array<string>)")),
        "sources": F.array_sort(F.transform(F.filter("peers", lambda p: (p["agent_id"] != F.col("agent_id")) & F.coalesce(p["answer"] == after, F.lit(False))), lambda p: p["agent_id"])),
    })
    lead = majorities(calls).select(*GAME, "round", F.col("majority").alias("led"), F.col("consensus").alias("agreed"))
    joined = shaped.join(lead, [*GAME, "round"])
    return joined.select(
        *GAME, "pilot_group", "agent_id", F.col("round").alias("from_round"), F.col("answer").alias("from_answer"), F.col("then.answer").alias("to_answer"), F.col("kind").alias("transition_type"),
        _event(F.col("kind"), F.col("changed")).alias("objective_event"), "valid", "changed", "introduced", "resolved", "sources", (F.col("changed") & (F.size("sources") > 0)).alias("adopted"),
        (F.col("changed") & (F.size("sources") > 0) & ~F.coalesce(F.col("then.correct"), F.lit(False))).alias("adopted_wrong"), F.col("led").alias("previous_majority"), F.col("agreed").alias("previous_consensus"),
        F.coalesce(F.col("changed") & (F.col("then.answer") == F.col("led")), F.lit(False)).alias("toward_majority"),
    )


def transition_statistics(moves: DataFrame) -> DataFrame:
    """Counts and rates by family, pilot group and round pair, in every combination: one cube."""
    event = lambda x: F.count_if(F.col("objective_event") == x)
    valid = F.count_if("valid")
    return moves.cube("family", "pilot_group", "from_round").agg(
        F.count("*").alias("n"),
        valid.alias("n_valid"),
        event("harmful_revision").alias("harmful"),
        event("successful_correction").alias("corrected"),
        event("wrong_to_wrong_migration").alias("migrated"),
        ratio(event("harmful_revision"), valid).alias("harmful_rate"),
        F.sum(F.size("introduced")).alias("introduced"),
        F.sum(F.size("resolved")).alias("resolved"),
        F.count_if("adopted").alias("adopted"),
    )


def open_rounds(calls: DataFrame, agents: int) -> DataFrame:
    """(item_id, family, next_round): the first round, from 0, that not all agents have called. Later whole rounds do not
    close an open one."""
    rounds = calls.groupBy(*GAME, "round").agg((F.countDistinct("agent_id") == agents).alias("whole"))
    whole = F.array_sort(F.collect_list(F.when(F.col("whole"), F.col("round"))))
    # Whole rounds 0, 1, … stand at their own places of the sorted list, up to the first gap.
    return rounds.groupBy(*GAME).agg(whole.alias("whole")).select(*GAME, F.size(F.filter("whole", lambda r, i: r == i)).cast("long").alias("next_round"))
