"""Speech segmentation of frame streams, per lane (STM-01..04, SCL-05, SCL-06).

One state machine serves the stream (keyed state, one small record a lane) and its batch twin (frames
sorted by lane and time, read in batches). Constants are those of the engine whose results these equal.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- fixed values ---------------------------------------------------------------------------------------
FLOOR_FACTOR, FLOOR_CREEP, FLOOR_STEP = 1.8, 1.02, 0.00002
PRE_ROLL_MS, HANGOVER_MS, MAX_MS = 500.0, 900.0, 7000.0
MIN_VOICED_MS, MERGE_FLOOR_MS, MERGE_GAP_MS = 400.0, 150.0, 1200.0
SPEECH_PROB, ENERGY_FACTOR, ENERGY_MS = 0.5, 2.5, 1000.0
# ---------------------------------------------------------------------------------------------------------
SEGMENT_SCHEMA = (
    "lane string, seq int, start_ms double, end_ms double, frames int, buffered_ms double, voiced_ms double, energy double, "
    "mean_prob double, forced boolean, outcome string"
)


@dataclass
class Lane:
    """State of one lane; frames are [at_ms, level, ms, samples]."""

    vad: float = 0.01
    floor: float = 0.0
    active: bool = False
    roll: list = field(default_factory=list)
    pending: list = field(default_factory=list)
    carry: list = field(default_factory=list)
    carry_ms: float = 0.0
    carry_at: float = 0.0
    started: float = 0.0
    silence: float = 0.0
    prob_sum: float = 0.0
    prob_n: int = 0
    seq: int = 0

    def gate(self) -> float:
        return max(self.vad, self.floor * FLOOR_FACTOR)

    def push(self, at: float, level: float, ms: float, samples: int, prob: float | None) -> tuple | None:
        """Take one frame; the segment it closes, if it closes one."""
        voiced = level >= self.gate()
        if not voiced and not self.active:
            self.floor = level if self.floor <= 0 else min(level, self.floor * FLOOR_CREEP + FLOOR_STEP)
        if prob is not None:
            voiced = prob >= SPEECH_PROB
        frame = [at, level, ms, samples]
        self.roll.append(frame)
        # the oldest goes only while what stays still covers the pre-roll
        while len(self.roll) > 1 and sum(f[2] for f in self.roll[1:]) >= PRE_ROLL_MS:
            self.roll.pop(0)
        if not self.active:
            if voiced:
                self._open(at)
            return None
        self.pending.append(frame)
        if prob is not None:
            self.prob_sum, self.prob_n = self.prob_sum + prob, self.prob_n + 1
        if voiced:
            self.silence = at
        if at - self.started >= MAX_MS:
            return self._close(at, True)
        return self._close(at, False) if at - self.silence >= HANGOVER_MS else None

    def _open(self, at: float) -> None:
        merged = self.carry_ms if self.carry and at - self.carry_at <= MERGE_GAP_MS else 0.0
        self.pending = (self.carry if merged else []) + self.roll
        self.carry, self.carry_ms = [], 0.0
        self.prob_sum, self.prob_n = 0.0, 0
        self.active, self.started, self.silence = True, at - merged, at

    def _close(self, at: float, forced: bool) -> tuple:
        frames, gate = self.pending, self.gate()
        voiced = sum(f[2] for f in frames if f[1] >= gate)
        buffered = sum(f[2] for f in frames)
        energy = (sum(f[1] ** 2 * f[3] for f in frames) / max(1, sum(f[3] for f in frames))) ** 0.5
        prob = self.prob_sum / self.prob_n if self.prob_n else None
        self.pending, self.roll = [], []
        if forced:
            self.started = self.silence = at
        else:
            self.active = False
        if voiced < MIN_VOICED_MS:
            held = voiced >= MERGE_FLOOR_MS and bool(frames)
            self.carry, self.carry_ms = (frames, voiced) if held else ([], 0.0)
            self.carry_at = at if held else self.carry_at
            outcome = "held" if held else "dropped:energy"
        elif prob is not None:
            outcome = "speech" if prob >= SPEECH_PROB else "dropped:low-prob"
        else:
            outcome = "high-energy" if energy >= gate * ENERGY_FACTOR and buffered >= ENERGY_MS else "dropped:low-prob"
        self.seq += 1
        return (self.seq, frames[0][0] if frames else at, at, len(frames), buffered, voiced, energy, prob, forced, outcome)


def _feed(lane: Lane, name: str, frames: pd.DataFrame) -> list[tuple]:
    out = []
    for at, level, ms, n, prob in frames[["at_ms", "level", "ms", "samples", "prob"]].itertuples(index=False):
        done = lane.push(float(at), float(level), float(ms), int(n), None if pd.isna(prob) else float(prob))
        if done:
            out.append((name, *done))
    return out


_COLUMNS = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]


def segment_batch(frames: DataFrame, vad: float = 0.01) -> DataFrame:
    """Segments of (lane, at_ms, level, ms, samples, prob). Lanes are dealt by key and read in order of time,
    batch by batch, so memory holds one lane's open segment and not the lane."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, lane, first = None, Lane(vad), True
        for b in batches:
            out = []
            # frames without a lane are a lane of their own
            for key, part in b.groupby("lane", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                if first or key != name:
                    name, lane, first = key, Lane(vad), False
                out += _feed(lane, name, part)
            yield pd.DataFrame(out, columns=_COLUMNS)

    return frames.repartition("lane").sortWithinPartitions("lane", "at_ms").mapInPandas(run, SEGMENT_SCHEMA)


def segment_stream(frames: DataFrame, vad: float = 0.01) -> DataFrame:
    """The same as a stream: append mode, frames of a lane in order of time within each trigger."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lane = Lane(**json.loads(state.get[0])) if state.exists else Lane(vad)
        rows = pd.concat(list(batches)).sort_values("at_ms")
        out = _feed(lane, key[0], rows)
        state.update((json.dumps(asdict(lane)),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return frames.groupBy("lane").applyInPandasWithState(run, SEGMENT_SCHEMA, "lane_state string", "append", GroupStateTimeout.NoTimeout)
