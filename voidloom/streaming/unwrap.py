"""Unwrapping as a stream: frames arrive in batches, each atom's last raw position and crossings are its state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unwrap_stream(frames: DataFrame, box: Sequence[float], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """``unwrap`` over a stream of (atom LONG, frame INT, axes). Frames of an atom have to arrive in order across batches;
    within a batch they are sorted. The result equals the batch operator's."""
    lengths = np.array(box, float)
    names = list(axes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(batches)).sort_values("frame")
        raw = data[names].to_numpy(float)
        if state.exists:
            kept = np.array(state.get, float)
            before, crossed = kept[: len(names)], kept[len(names) :]
        else:
            before, crossed = raw[0], np.zeros(len(names))
        jumps = np.floor((np.diff(np.vstack([before, raw]), axis=0) + lengths / 2) / lengths)
        total = crossed + np.cumsum(jumps, axis=0)
        state.update(tuple(float(x) for x in [*raw[-1], *total[-1]]))
        out = data.copy()
        out[names] = raw - lengths * total
        yield out[["atom", "frame", *names]]

    kinds = ", ".join(f"{a} double" for a in names)
    kept = ", ".join([*[f"p_{a} double" for a in names], *[f"c_{a} double" for a in names]])
    return frames.select("atom", "frame", *names).groupBy("atom").applyInPandasWithState(step, f"atom long, frame int, {kinds}", kept, "append", GroupStateTimeout.NoTimeout)


def unwrap_frames(atoms: DataFrame, box: Sequence[float]) -> DataFrame:
    """``unwrap_stream`` of what the structure formats stream: file, frame_id, atom_id, x, y, z of one file."""
    return unwrap_stream(atoms.select(F.col("atom_id").cast("long").alias("atom"), F.col("frame_id").alias("frame"), "x", "y", "z"), box)
