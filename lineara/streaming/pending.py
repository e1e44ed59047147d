"""Stateful models of single keys: transactions that wait for acceptance, and images that are adopted after two equal checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds that a resolved transaction stays in view, by resolution, and that its tombstone is kept.
CONFIRMED_MS, DROPPED_MS, TOMBSTONE_MS = 900, 700, 60_000

NEWS = "txid string, kind string, covenant_id string, tx_kind string, resolution string, version bigint"
VIEW = "txid string, state string, covenants string, tx_kind string, resolution string, version bigint, generation int"
_MODEL = "state string, events string, tx_kind string, resolution string, version bigint, generation int"


def pending_model(news: DataFrame, confirmed_ms: int = CONFIRMED_MS, dropped_ms: int = DROPPED_MS, tombstone_ms: int = TOMBSTONE_MS) -> DataFrame:
    """A row for each change of a waiting transaction: pending, resolved, gone or tombstone.

    ``news``: txid, kind (pending or resolve), covenant_id, tx_kind, resolution (confirmed or dropped), version (grows with each
    message of the source). Messages of one transaction are taken by version, and one that isn't newer than what is known is late and
    changes nothing. A second sighting adds its covenants; a sighting after a resolution begins a new generation. A resolved
    transaction stays in view for a while (a timer), then leaves a tombstone, which keeps late sightings out until its own timer ends.
    A resolution of a transaction that was never seen leaves a tombstone at once. Timers need a trigger by time: with ``availableNow`` they
    keep the query from ending.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        out = []

        def say() -> None:
            kind, events, tx_kind, resolution, version, generation = now
            covenants = ",".join(sorted({e.split("|")[0] for e in events.split(";") if e}))
            out.append((key[0], kind, covenants, tx_kind, resolution or None, version, generation))

        if state.hasTimedOut:
            if now[0] == "resolved":
                now[0] = "tombstone"
                out.append((key[0], "gone", "", now[2], now[3] or None, now[4], now[5]))
                state.update(tuple(now))
                state.setTimeoutDuration(tombstone_ms)
            else:
                state.remove()
        else:
            timer = None
            for r in pd.concat(parts).sort_values(["version", "kind"], kind="stable").itertuples():
                if now is not None and r.version <= now[4]:
                    continue
                event = f"{r.covenant_id or ''}|{r.tx_kind or 'pending'}"
                if r.kind == "pending":
                    if now is not None and now[0] == "pending":
                        now[1] = ";".join(dict.fromkeys([*now[1].split(";"), event]))
                        now[4] = int(r.version)
                    else:
                        now = ["pending", event, r.tx_kind or "pending", "", int(r.version), (now[5] if now else 0) + 1]
                    timer = 0
                elif now is not None and now[0] != "tombstone":
                    now[0], now[3], now[4] = "resolved", r.resolution or "confirmed", int(r.version)
                    timer = dropped_ms if now[3] == "dropped" else confirmed_ms
                else:
                    now = ["tombstone", "", r.tx_kind or "pending", r.resolution or "confirmed", int(r.version), now[5] if now else 0]
                    timer = tombstone_ms
                say()
            if now is not None:
                state.update(tuple(now))
                if timer is None:
                    timer = {"pending": 0, "resolved": confirmed_ms}.get(now[0], tombstone_ms)
                if timer:
                    state.setTimeoutDuration(timer)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VIEW.split(", ")])

    return news.where("txid is not null").groupBy("txid").applyInPandasWithState(step, VIEW, _MODEL, "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Time between checks of an image that is well, and the first wait after a failure.
RECHECK_MS, BACKOFF_MS = 86_400_000, 3_600_000
CHECKS = "covenant_id string, at_ms bigint, outcome string, sha string, replaced boolean"
RECORD = (
    "covenant_id string, at_ms bigint, state string, observed string, pending string, change_count bigint, fail_count bigint, first_seen_ms bigint, "
    "last_change_ms bigint, next_check_ms bigint, was string, now string"
)
_RECORD = "state string, observed string, pending string, change_count bigint, fail_count bigint, first_seen_ms bigint, last_change_ms bigint"


def checked(record: dict, at_ms: int, outcome: str, sha: str | None, replaced: bool) -> tuple[dict, tuple[str, str] | None, int]:
    """(record, change, next check) after one check.

    The first image is taken at once. Other bytes at the same place are adopted only when a second check in a row finds them; if the old
    ones come back in between nothing was pending. An image that its publisher replaced is adopted at once. A source that fails, or that
    isn't an image any more, never takes back what was witnessed.
    """
    r, change = dict(record), None
    if outcome != "image":
        r["fail_count"] += 1
        if r["observed"] is None:
            r["state"] = "not_an_image" if outcome == "not_an_image" else "unavailable"
        return r, None, at_ms + min(RECHECK_MS, BACKOFF_MS << max(0, min(r["fail_count"], 5) - 1))
    r["fail_count"] = 0
    if r["observed"] is None:
        r |= {"observed": sha, "state": "witnessed", "pending": None, "first_seen_ms": at_ms}
    elif sha == r["observed"]:
        r |= {"pending": None, "state": "witnessed" if replaced else r["state"]}
    elif replaced or r["pending"] == sha:
        change = (r["observed"], sha)
        r |= {"observed": sha, "pending": None, "change_count": r["change_count"] + 1, "last_change_ms": at_ms, "state": "witnessed"}
    else:
        r["pending"] = sha
    return r, change, at_ms + RECHECK_MS


def _new() -> dict:
    return {"state": "unknown", "observed": None, "pending": None, "change_count": 0, "fail_count": 0, "first_seen_ms": None, "last_change_ms": None}


def _after(key: str, rows: pd.DataFrame, record: dict) -> tuple[pd.DataFrame, dict]:
    out = []
    for r in rows.sort_values(["at_ms", "outcome", "sha"], kind="stable").itertuples():
        record, change, due = checked(record, int(r.at_ms), r.outcome, r.sha, bool(r.replaced))
        out.append((key, int(r.at_ms), record["state"], record["observed"], record["pending"], record["change_count"], record["fail_count"], record["first_seen_ms"], record["last_change_ms"], due, *(change or (None, None))))
    return pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"first_seen_ms": "Int64", "last_change_ms": "Int64"}), record


def witness(checks: DataFrame) -> DataFrame:
    """The record of an image after each check, kept in state over restarts; ``was`` and ``now`` tell a change that was adopted."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record = dict(zip(_new(), state.get, strict=True)) if state.exists else _new()
        out, record = _after(key[0], pd.concat(parts), record)
        state.update(tuple(record.values()))
        yield out

    return checks.where("covenant_id is not null").groupBy("covenant_id").applyInPandasWithState(step, RECORD, _RECORD, "append", GroupStateTimeout.NoTimeout)


def witnessed(checks: DataFrame) -> DataFrame:
    """The same over a whole table of checks."""
    return checks.where("covenant_id is not null").groupBy("covenant_id").applyInPandas(lambda key, rows: _after(key[0], rows, _new())[0], RECORD)


def change_log(records: DataFrame, keep: int) -> DataFrame:
    """The newest adopted changes of each image."""
    from ..operators.upkeep import newest

    return newest(records.where("was is not null").select("covenant_id", "at_ms", "was", "now"), "at_ms", keep, "covenant_id")
