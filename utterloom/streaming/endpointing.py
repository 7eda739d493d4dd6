"""Live endpointing: samples arrive in chunks, and a detector says when the talker has finished.

The first units of 20 ms set the noise floor and freeze it. Three loud units in a row
start speech; twenty quiet ones in a row end it, if enough of it was speech, and else wait
for the next. Frames are analysed whole, and muted ones are skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME, PER_UNIT = 160, 2
CALIBRATION, SHIFT, LOW, HIGH = 15, 5, FRAME * PER_UNIT * 32, FRAME * PER_UNIT * 2000
START, END, START_UNITS, HANGOVER, SPEECH = 4, 2, 3, 20, 7
IDLE, SPEAKING, DONE = "idle", "speaking", "done"


class Live:
    """The detector of one capture; its fields are its state."""

    def __init__(self, frame: int = FRAME, max_frames: int = 1 << 30):
        self.frame, self.max_frames = frame, max_frames
        self.state, self.floor, self.units, self.frames = IDLE, 0, 0, 0
        self.loud = self.quiet = self.speech = self.energy = 0
        self.rest: list[int] = []

    def feed(self, samples: Sequence[int], muted: bool = False) -> int:
        """Whole frames analysed of what has come so far; none after the end."""
        data, analysed = np.concatenate([np.array(self.rest, np.int64), np.asarray(samples, np.int64)]), 0
        used = 0
        while used + self.frame <= len(data) and self.frames < self.max_frames and self.state != DONE:
            if not muted:
                self.push(int(np.abs(data[used : used + self.frame]).sum()))
                analysed += 1
            used += self.frame
        self.rest = data[used:].tolist()
        return analysed

    def push(self, energy: int) -> None:
        self.frames, self.energy = self.frames + 1, self.energy + energy
        if self.frames % PER_UNIT:
            return
        unit, self.energy, self.units = self.energy, 0, self.units + 1
        if self.units <= CALIBRATION:
            floor = unit if self.units == 1 else self.floor + (unit - self.floor >> SHIFT)
            self.floor = min(HIGH, max(LOW, floor))
        elif self.state == IDLE:
            self.loud = self.loud + 1 if unit > START * self.floor else 0
            if self.loud >= START_UNITS:
                self.state, self.speech, self.quiet = SPEAKING, self.loud, 0
        elif unit >= END * self.floor:
            self.speech, self.quiet = self.speech + 1, 0
        else:
            self.quiet += 1
            if self.quiet >= HANGOVER:
                self.state = DONE if self.speech >= SPEECH else IDLE
                self.loud = self.quiet = 0


def captures(chunks: DataFrame, frame: int = FRAME) -> DataFrame:
    """key, state, frames, floor at the end of each whole capture of chunks (key, seq, samples, muted); a capture in memory at a time."""
    kind = dict(chunks.dtypes)["key"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        live, rows = Live(frame), rows.sort_values("seq")
        for samples, muted in zip(rows["samples"], rows["muted"]):
            live.feed(samples, bool(muted))
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "state": [live.state], "frames": [live.frames], "floor": [live.floor]})

    return chunks.select("key", "seq", "samples", "muted").groupBy("key").applyInPandas(run, f"key {kind}, state string, frames long, floor long")


def capture_stream(chunks: DataFrame, frame: int = FRAME) -> DataFrame:
    """key, state, frames, floor after each batch of a stream of chunks (key, seq, samples, muted), fed in order of seq."""
    kind = dict(chunks.dtypes)["key"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = Live(frame)
        if state.exists:
            live.__dict__.update(json.loads(state.get[0]))
        rows = pd.concat(list(batches)).sort_values("seq")
        for samples, muted in zip(rows["samples"], rows["muted"]):
            live.feed(samples, bool(muted))
        state.update((json.dumps(live.__dict__),))
        yield pd.DataFrame({"key": [key[0]], "state": [live.state], "frames": [live.frames], "floor": [live.floor]})

    out = f"key {kind}, state string, frames long, floor long"
    return chunks.select("key", "seq", "samples", "muted").groupBy("key").applyInPandasWithState(run, out, "state string", "update", GroupStateTimeout.NoTimeout)
