"""Conversation history as keyed state: the last messages per conversation, with a time to live.

The batch form is the ``conversation_append`` query; here the same rule runs on a stream, where each micro-batch appends to
a list kept per conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Messages kept, characters of one, seconds to live.
KEEP = 12
CHARS = 8000
TTL_SECONDS = 86_400
STATE = "turns array<bigint>, roles array<string>, texts array<string>"
OUTPUT = "conv_id bigint, turn bigint, role string, content string, place int"


def _append(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = list(zip(*state.get, strict=True)) if state.exists else []
    for frame in frames:
        for turn, role, text in zip(frame["turn"], frame["role"], frame["text"], strict=True):
            if role in ("user", "assistant") and isinstance(text, str):
                held.append((int(turn), role, text[:CHARS]))
    held = sorted(held)[-KEEP:]
    state.update(tuple(list(x) for x in zip(*held, strict=True)) if held else ([], [], []))
    state.setTimeoutDuration(TTL_SECONDS * 1000)
    yield pd.DataFrame([(key[0], *row, i) for i, row in enumerate(held)], columns=["conv_id", "turn", "role", "content", "place"])


def history(messages: DataFrame) -> DataFrame:
    """Stream of ``conv_id, turn, role, content, place``: the kept history after every batch that touched a conversation."""
    return messages.groupBy("conv_id").applyInPandasWithState(_append, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
