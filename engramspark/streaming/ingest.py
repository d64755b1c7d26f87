"""Streaming ingestion: the fold of turns into cells as keyed state, one buffer for each session."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import BUFFER, BufferConfig
from ..functions.text import ISO_TIME

OUT = "cell_seq long, cell_id string, flush_id long, reason string, cell_type string, n_turns long, first_turn long, last_turn long, timestamp_start string, timestamp_end string, raw_text string, token_count long, linked_prev string"
STATE = "idx array<long>, role array<string>, content array<string>, ts array<string>, checked long, cells long, flushes long"


_ISO = re.compile(ISO_TIME)


def moment(raw: str | None) -> tuple[int, bool] | None:
    """Microseconds and whether a zone is given, as the batch fold reads them; None for anything but ISO_TIME."""
    m = _ISO.match(raw) if raw else None
    if not m:
        return None
    date, time, fraction, zone = (x or "" for x in m.groups())
    try:
        at = datetime.strptime(date.replace("-", "") + time.replace(":", "").ljust(6, "0"), "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    except ValueError:
        return None
    digits = zone.replace(":", "").ljust(5, "0") if zone not in ("", "Z") else "+0000"
    minutes = int(digits[0] + "1") * (60 * int(digits[1:3]) + int(digits[3:5]))
    return (int(at.timestamp()) - 60 * minutes) * 1_000_000 + int(fraction[:6].ljust(6, "0")), zone != ""


def is_gap(before: str | None, after: str | None, minutes: int) -> bool:
    a, b = moment(before), moment(after)
    return a is not None and b is not None and a[1] == b[1] and b[0] - a[0] > minutes * 60_000_000


class Buffer:
    """The buffered turns of a session and what to do with the next one."""

    def __init__(self, config: BufferConfig, estimator: Callable[[str], int], detector: Callable[[list[tuple]], list[int]], turns: list[tuple] | None = None, checked: int = 0, cells: int = 0, flushes: int = 0):
        self.config, self.estimator, self.detector = config, estimator, detector
        self.turns, self.checked, self.cells, self.flushes = list(turns or []), checked, cells, flushes

    def add(self, turn: tuple) -> Iterator[tuple[int, int, str, list[tuple]]]:
        """(cell number, flush number, reason, turns) of each cell that ends with this turn."""
        self.turns.append(turn)
        n, total = len(self.turns), sum(self.estimator(t[2]) for t in self.turns)
        if n >= 2 and is_gap(self.turns[-2][3], turn[3], self.config.gap_minutes):
            reason, points = "gap", [n]
        elif total >= self.config.hard:
            reason, points = "hard", [n]
        elif total // self.config.soft > self.checked:
            self.checked = total // self.config.soft
            reason, points = "soft", sorted({p for p in self.detector(self.turns) if 0 < p <= n})
        else:
            return
        if not points:
            return
        self.flushes += 1
        start = 0
        for p in points:
            self.cells += 1
            yield self.cells, self.flushes, reason, self.turns[start:p]
            start = p
        self.turns, self.checked = self.turns[start:], 0


def ingest(turns: DataFrame, config: BufferConfig = BUFFER, estimator: Callable[[str], int] = len, detector: Callable[[list[tuple]], list[int]] = lambda turns: [], idle: str | None = None) -> DataFrame:
    """Cells of a stream of turns (session_id, turn_idx, role, content, ts_raw), each put out once as it ends.

    Within a batch a session's turns are taken by ``turn_idx``.  State is one buffer a session, below the
    hard limit; it survives restarts with the stream's checkpoint.  Session ids may be of any type.  With
    ``idle`` (such as ``"7 days"``, of processing time) the state of a session without turns for so long is
    dropped with its unfinished buffer; otherwise it is kept.
    """
    kind = dict(turns.dtypes)["session_id"]
    names = ["session_id", *[x.strip().split(" ")[0] for x in OUT.split(",")]]
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, checked, cells, flushes = [], 0, 0, 0
        if state.exists:
            idx, role, content, ts, checked, cells, flushes = state.get
            held = list(zip(idx, role, content, ts, strict=True))
        buffer = Buffer(config, estimator, detector, held, checked, cells, flushes)
        new = pd.concat(list(frames)).sort_values("turn_idx", kind="stable")
        rows = []
        for t in new[["turn_idx", "role", "content", "ts_raw"]].itertuples(index=False, name=None):
            for number, flush, reason, part in buffer.add((int(t[0]), t[1] if isinstance(t[1], str) else "user", t[2] if isinstance(t[2], str) else "", t[3] if isinstance(t[3], str) else None)):
                text = "\n".join(f"[{x[1]}]: {x[2]}" for x in part)
                rows.append((key[0], number, f"C_{number:03d}", flush, reason, "fragmented" if reason == "hard" else "fact", len(part), part[0][0], part[-1][0], part[0][3], part[-1][3], text, estimator(text), f"C_{number - 1:03d}" if number > 1 else None))
        columns = list(zip(*buffer.turns, strict=True)) if buffer.turns else [(), (), (), ()]
        state.update((*[list(c) for c in columns], buffer.checked, buffer.cells, buffer.flushes))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.groupBy("session_id").applyInPandasWithState(update, f"session_id {kind}, {OUT}", STATE, "append", timeout)
