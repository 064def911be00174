"""Feedback: a rate limit whose decisions depend on earlier decisions, and what a report sets in motion."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


class Limit:
    """STR5: decides on the reports of one entry, which come in order of time; holds what was accepted within the window."""

    def __init__(self, per_agent: int = 1, per_entry: int = 10, window_s: int = 3600, kept=()):
        self.per_agent, self.per_entry, self.window, self.kept = per_agent, per_entry, window_s, [tuple(k) for k in kept]

    def accepts(self, agent: int, ts: int) -> bool:
        self.kept = [(t, a) for t, a in self.kept if t > ts - self.window]
        ok = len(self.kept) < self.per_entry and sum(a == agent for _, a in self.kept) < self.per_agent
        if ok:
            self.kept.append((ts, agent))
        return ok


def rate_limit(reports: DataFrame, per_agent: int = 1, per_entry: int = 10, window_s: int = 3600) -> DataFrame:
    """(id, accepted): STR5, in order of (ts_s, id) within an entry.

    A report is accepted unless, within the hour before, ``per_agent`` accepted ones of its agent or
    ``per_entry`` of anyone stand on the entry. Only accepted reports count. Rows come sorted and
    are passed on batch by batch; of an entry at most per_entry accepted reports are held, however
    many it has.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entry, limit = None, Limit()
        for b in batches:
            ok = []
            for e, agent, ts in zip(b["entry_id"], b["agent_id"], b["ts_s"], strict=True):
                if e != entry:
                    entry, limit = e, Limit(per_agent, per_entry, window_s)
                ok.append(limit.accepts(agent, ts))
            yield pd.DataFrame({"id": b["id"], "accepted": ok})

    rows = reports.where(F.col("entry_id").isNotNull()).select("id", "agent_id", "entry_id", "ts_s")
    return rows.repartition("entry_id").sortWithinPartitions("entry_id", "ts_s", "id").mapInPandas(fold, "id long, accepted boolean")


def rate_limit_stream(reports: DataFrame, per_agent: int = 1, per_entry: int = 10, window_s: int = 3600) -> DataFrame:
    """STR5 over a stream of reports(id, agent_id, entry_id, ts_s): the state of an entry is what was accepted within the window."""

    def decide(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(["ts_s", "id"])
        limit = Limit(per_agent, per_entry, window_s, json.loads(state.get[0]) if state.exists else ())
        ok = [limit.accepts(int(a), int(t)) for a, t in zip(rows["agent_id"], rows["ts_s"], strict=True)]
        state.update((json.dumps(limit.kept),))
        yield pd.DataFrame({"id": rows["id"], "accepted": ok})

    return reports.groupBy("entry_id").applyInPandasWithState(decide, "id long, accepted boolean", "kept string", "append", GroupStateTimeout.NoTimeout)


def route(reports: DataFrame, claims: DataFrame, queue: DataFrame, as_of: int) -> dict[str, DataFrame]:
    """API2, SNK2, SNK10, SNK12: feedback_log, verify_queue and entry metadata after reports(entry_id, agent_id, signal, reason, note).

    Reasons wrong and outdated put the entry's claims at the head of the queue, priority 100
    or more with no attempts; outdated marks the entry too. Other reasons are only logged.
    """
    log = reports.select("entry_id", "agent_id", "signal", F.concat_ws(":", "reason", "note").alias("reason"), F.lit(as_of).cast("long").alias("at_s"))
    urgent = claims.join(reports.where(F.col("reason").isin("wrong", "outdated")).select("entry_id").distinct(), "entry_id", "left_semi").select(F.col("id").alias("claim_id"))
    met = queue.join(urgent.withColumn("_u", F.lit(True)), "claim_id", "full_outer")
    new = met.select(
        "claim_id", F.when(F.col("_u"), F.greatest(F.coalesce("priority", F.lit(0)), F.lit(100))).otherwise(F.col("priority")).cast("long").alias("priority"),
        F.when(F.col("_u"), F.lit(0)).otherwise(F.col("attempts")).cast("long").alias("attempts"),
    )
    outdated = reports.where("reason = 'outdated'").select("entry_id").distinct().withColumn("outdated_at", F.lit(as_of).cast("long"))
    return {"feedback_log": log, "verify_queue": new, "outdated": outdated}
