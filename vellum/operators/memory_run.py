"""A scripted run over memories: each step of a user is recalled for, answered, judged, and remembered from, in order.

A user's steps are one fold, whose state is what is remembered; it holds as many memories as a
user may have, so a run of any length takes bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import keyed_fold

#: What a step's words are taken for: a slot, or none, and the text; None where they say nothing.
Extract = Callable[[str], tuple[str | None, str] | None]
_RESULT = "user long, step long, op string, recalled string, passed boolean, memories_before long, memories_after long"


def whole_text(said: str) -> tuple[None, str] | None:
    """The plain default: what is said is a memory without a slot."""
    return (None, said) if said else None


def _holds(text: str, any_of: list | None, none_of: list | None) -> bool:
    return (not any_of or any(w in text for w in any_of)) and not any(w in text for w in none_of or ())


def run(steps: DataFrame, extract: Extract = whole_text, cap: int = 200) -> DataFrame:
    """user, step, op, recalled, passed, memories_before, memories_after of every step.

    ``steps``: user and step (whole numbers), said, answer, kind, and the words expect_any,
    expect_none, memory_any, memory_none. Before a step the memory that shares most words with
    what is said is recalled, the newest of equals. Then what ``extract`` finds is merged in: a
    text that is there is a NOOP; another text for a slot that is there an UPDATE; else it is an
    ADD, and where there are more than ``cap`` the memory that changed longest ago goes. A step
    of kind "check" passes if its answer holds what is expected, and then, if what is remembered
    does; other kinds pass. Nulls are empty texts. Steps of one number go by what is said.
    """

    def step(memories: dict, row: tuple) -> tuple[dict, tuple]:
        user, at, said, answer, kind, expect_any, expect_none, memory_any, memory_none = row
        said, answer, before = said or "", answer or "", len(memories)
        words = set(said.split())
        shared = max((len(words & set(text.split())), i) for i, text in enumerate(memories.values())) if memories else (0, 0)
        recalled = list(memories.values())[shared[1]] if shared[0] else None
        found, op = extract(said), None
        if found:
            slot, text = found
            name = ("slot", slot) if slot else ("text", text)
            op = "ADD" if name not in memories else "NOOP" if memories[name] == text else "UPDATE"
            if op != "NOOP":
                memories.pop(name, None)
                memories[name] = text
            if len(memories) > cap:
                del memories[next(iter(memories))]
        passed = kind != "check" or (_holds(answer, expect_any, expect_none) and _holds("\n".join(memories.values()), memory_any, memory_none))
        return memories, (user, at, op, recalled, passed, before, len(memories))

    rows = steps.select("user", "step", "said", "answer", "kind", "expect_any", "expect_none", "memory_any", "memory_none")
    return keyed_fold(rows, "user", ["step", "said"], dict, step, _RESULT)


def rates(steps: DataFrame, results: DataFrame) -> DataFrame:
    """dimension, n, rate of passed checks, and how often a step that is no memory made one; null where nothing was measured."""
    joined = results.join(steps.select("user", "step", "kind", "dimension"), ["user", "step"])
    check, plain = F.col("kind") == "check", F.col("kind") == "no_memory"
    grown = (F.col("memories_after") > F.col("memories_before")).cast("int")
    return joined.groupBy("dimension").agg(
        F.count_if(check).alias("n"), F.round(F.avg(F.when(check, F.col("passed").cast("int"))), 6).alias("rate"), F.round(F.avg(F.when(plain, grown)), 6).alias("false_memory_rate")
    )
