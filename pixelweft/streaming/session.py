"""Interactive sessions as keyed state over a stream of actions.

An action is (img, seq, action, class_id, cells): ``stroke`` writes a class on cells (0 changes nothing, a later stroke overwrites),
``segment`` starts all classes anew, with seed growth, ``refine`` goes on from the models, without it, and ``reset`` empties the
session. Order is by ``seq``, not by arrival. State holds annotations and iteration counts by image; masks don't belong in it.

Each segment or refine gives one row for each class: whether its models start from the seeds (``init``) or are applied again (``eval``), if seeds are
grown, how many cells it has, and its iteration count. The rows of a batch tell which cuts to run; with their cells, and a row of class 0
for each reset, they are what ``streaming.cuts`` runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "img long, seq long, action string, class_id int, mode string, grow boolean, n_cells int, iterations int"
CELLS = f"{OUTPUT}, cells array<int>, against array<int>"
STATE = "annotations string, iterations string, last_seq long"


def step(annotations: dict[int, int], iterations: dict[int, int], row) -> list[tuple]:
    """Apply one action to a session; returns the rows it gives, each with its class's cells and those of other classes and the background at its end."""
    if row.action == "stroke":
        if row.class_id > 0:
            annotations.update({int(c): int(row.class_id) for c in row.cells})
        return []
    if row.action == "reset":
        annotations.clear()
        iterations.clear()
        return [(row.img, row.seq, row.action, 0, "reset", False, 0, 0, [], [])]
    fresh = row.action == "segment"
    out = []
    for k in sorted({c for c in annotations.values() if c > 1}):
        again = not fresh and iterations.get(k, 0) > 0
        iterations[k] = iterations.get(k, 0) + 1 if again else 1
        mine = sorted(i for i, c in annotations.items() if c == k)
        against = sorted(i for i, c in annotations.items() if c not in (0, k))
        out.append((row.img, row.seq, row.action, k, "eval" if again else "init", fresh, len(mine), iterations[k], mine, against))
    return out


def _frame(rows: list[tuple], cells: bool) -> pd.DataFrame:
    """The rows with all they have, or without cells and resets."""
    names = [f.split()[0] for f in CELLS.split(", ")]
    out = pd.DataFrame(rows if cells else [r[:-2] for r in rows if r[3]], columns=names if cells else names[:-2])
    return out


def session_stream(actions: DataFrame, cells: bool = False) -> DataFrame:
    """The plan rows of a stream of actions, by image."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get if state.exists else ("{}", "{}", -1)
        annotations, iterations = ({int(k): v for k, v in json.loads(x).items()} for x in stored[:2])
        rows = pd.concat(list(frames)).sort_values("seq")
        out, last = [], stored[2]
        for row in rows.itertuples(index=False):
            if row.seq > last:  # an action that came again after a restart is applied once
                out += step(annotations, iterations, row)
                last = int(row.seq)
        state.update((json.dumps(annotations), json.dumps(iterations), last))
        yield _frame(out, cells)

    return actions.groupBy("img").applyInPandasWithState(fold, CELLS if cells else OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def session_batch(actions: DataFrame, cells: bool = False) -> DataFrame:
    """The same over a finished log."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        annotations: dict[int, int] = {}
        iterations: dict[int, int] = {}
        return _frame([r for row in frame.sort_values("seq").itertuples(index=False) for r in step(annotations, iterations, row)], cells)

    return actions.groupBy("img").applyInPandas(run, CELLS if cells else OUTPUT)
