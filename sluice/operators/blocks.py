"""Nested Start and End marks of build logs as timed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "task long, name string, level int, start long, finish long, closed boolean"


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by task and place; a stack of the open blocks of one task is all that is held."""
    task, stack, now = None, [], 0
    for part in parts:
        out = []

        def unclosed(owner: int, at: int, open_blocks: list, made: list = out) -> None:
            made += [(owner, name, level, start, at, False) for level, (name, start) in enumerate(open_blocks)]

        for own, mark, name, sec in zip(part["task"], part["mark"], part["name"], part["sec"], strict=True):
            if own != task:
                unclosed(task, now, stack)
                task, stack = own, []
            now = sec
            if mark == "start":
                stack.append((name, sec))
            elif any(n == name for n, _ in stack):
                while stack:  # what was left open inside ends with its outer block
                    last, began = stack.pop()
                    out.append((task, last, len(stack), began, sec, last == name))
                    if last == name:
                        break
        yield pd.DataFrame(out, columns=["task", "name", "level", "start", "finish", "closed"])
    if stack:
        yield pd.DataFrame([(task, name, level, start, now, False) for level, (name, start) in enumerate(stack)], columns=["task", "name", "level", "start", "finish", "closed"])


def blocks(lines: DataFrame) -> DataFrame:
    """(task, name, level, start, finish, closed) from lines (task, place, mark, name, sec).

    An end without a start is ignored; a block without an end ends with the block around it, or with
    the task's last line, and isn't closed. A task's lines stream through one task in order.
    """
    dealt = lines.select("task", "place", "mark", "name", "sec").repartition("task").sortWithinPartitions("task", "place")
    return dealt.mapInPandas(_fold, SCHEMA)
