"""Conversations as keyed state of a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from utterloom.operators.rules import Doctor, Script, answered

STATE = "state string"


def reply_stream(turns: DataFrame, script: Script, patience: int = 0) -> DataFrame:
    """conv_id, turn, reply of a stream (conv_id, turn, text); a batch's turns are answered in order, and the state goes on with the next."""
    kinds = dict(turns.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        doctor = Doctor(script, key[0], patience=patience)
        if state.exists:
            doctor.restore(json.loads(state.get[0]))
        rows = answered([pd.concat(list(batches))], doctor)
        state.update((json.dumps(doctor.state()),))
        yield pd.DataFrame({"conv_id": [key[0]] * len(rows), "turn": [t for t, _ in rows], "reply": [r for _, r in rows]})

    out = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, reply string"
    return turns.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout)
