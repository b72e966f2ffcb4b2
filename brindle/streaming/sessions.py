"""Keyed session state over a stream of messages: the last turns and whether a confirmation is pending."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.config import DEFAULT, Config

OUTPUT = "conversation_id string, n_seen long, n_kept int, last_role string, pending boolean"
STATE = "n_seen long, roles array<string>, contents array<string>, pending boolean"


def session_memory(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """After each batch one row per session that got messages: how many were seen, how many are remembered, the last role, and whether an offer waits for a yes or no.

    The state is bounded by memory_messages turns a session.
    """
    most = config.memory_messages

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, roles, contents, pending = state.get if state.exists else (0, [], [], False)
        roles, contents = list(roles), list(contents)
        rows: pd.DataFrame | None = None  # the last turns of the trigger; the rest is only counted
        for pdf in batches:
            seen += len(pdf)
            rows = (pdf if rows is None else pd.concat([rows, pdf])).nlargest(most, "id")
        for role, content, status in rows.sort_values("id")[["role", "content", "status"]].itertuples(index=False):
            roles = [*roles, role or ""][-most:]
            contents = [*contents, content or ""][-most:]
            kind = (role or "").strip().lower()
            pending = status == "escalate" if kind != "user" else False
        state.update((seen, roles, contents, bool(pending)))
        yield pd.DataFrame([(key[0], seen, len(roles), roles[-1] if roles else None, bool(pending))], columns=["conversation_id", "n_seen", "n_kept", "last_role", "pending"])

    return messages.groupBy("conversation_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def rehydrated(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """What sessions remember, from the stored messages: the start of a stream after a loss of its state."""
    from brindle.operators.store import recent_messages

    return recent_messages(messages, config.memory_messages)
