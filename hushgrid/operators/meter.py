"""From samples to level frames, and from frames to sessions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import acoustics as ac
from ..plans.shared import stored

# The poles of A-weighting in hertz (IEC 61672-1), the first and the last double.
POLES = (20.598997, 107.65265, 737.86223, 12194.217)
#: Frames of a session, and seconds without one that end it.
SESSION_FRAMES, STALL_SECONDS = 240, 3.0


def frame_length(rate: int) -> int:
    """Samples of a frame; halves go up."""
    return math.floor(rate * ac.FRAME_SECONDS + 0.5)


#: Samples that are filtered by one matrix product, chunks whose states are composed by one task, and frames' floor.
STRIDE, RUN, QUIETEST = 256, 512, 1e-9


@dataclass(frozen=True)
class Filter:
    """A linear filter of any order as matrices for STRIDE samples x and the state s before them:
    output = x @ direct + s @ free, next state = x @ enter + s @ keep."""

    step: np.ndarray
    direct: np.ndarray
    free: np.ndarray
    enter: np.ndarray
    keep: np.ndarray

    @classmethod
    def of(cls, zeros: list[float], poles: list[float], gain: float) -> Filter:
        """A chain of stages, one for each pair of a zero and a pole: out = in + s, s = pole * out - zero * in."""
        n = len(poles)
        # Each line holds the coefficients of a value in the n states and the input (last).
        signal, step = np.eye(n + 1)[n] * gain, np.zeros((n + 1, n + 1))
        for k, (zero, pole) in enumerate(zip(zeros, poles, strict=True)):
            out = signal + np.eye(n + 1)[k]
            step[k], signal = pole * out - zero * signal, out
        a, b, c, d = step[:n, :n], step[:n, n], signal[:n], signal[n]
        power, free, impulse = np.eye(n), [], [d]
        enter = []
        for _ in range(STRIDE):
            free.append(c @ power)
            enter.append(power @ b)
            impulse.append(c @ power @ b)
            power = a @ power
        i = np.arange(STRIDE)
        lag = i[None, :] - i[:, None]  # of an output behind an input
        direct = np.where(lag >= 0, np.array(impulse)[np.clip(lag, 0, None)], 0.0)
        return cls(a, direct, np.array(free).T, np.array(enter[::-1]), power.T)

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The filtered samples, and the state after them. Only states go from stride to stride one after the other."""
        whole = len(x) // STRIDE
        body, rest = x[: whole * STRIDE].reshape(whole, STRIDE), x[whole * STRIDE :]
        s = np.zeros(len(self.step)) if state is None else state
        told, before = body @ self.enter, []
        for k in range(whole):
            before.append(s)
            s = told[k] + s @ self.keep
        out = body @ self.direct + np.array(before).reshape(whole, len(s)) @ self.free
        tail = len(rest)
        last = rest @ self.direct[:tail, :tail] + s @ self.free[:, :tail]
        if tail:
            s = rest @ self.enter[STRIDE - tail :] + s @ self.power(tail)
        return np.concatenate([out.ravel(), last]), s

    def power(self, n: int) -> np.ndarray:
        """What n samples of silence do to a state (a row)."""
        return np.linalg.matrix_power(self.step, n).T


def a_chain(rate: int) -> tuple[list[float], list[float], float]:
    """Zeros, poles and gain of digital A-weighting. The analog filter has four zeros at 0 Hz and two fewer zeros than poles;
    the bilinear transform moves s to (2 * rate + s) / (2 * rate - s), infinity to -1. The gain is one at 1 kHz."""
    move = lambda hz: (2 * rate - 2 * math.pi * hz) / (2 * rate + 2 * math.pi * hz)
    first, second, third, last = POLES
    poles = [move(hz) for hz in (first, first, second, third, last, last)]
    zeros = [1.0] * 4 + [-1.0] * 2
    z = np.exp(2j * math.pi * 1000 / rate)
    return zeros, poles, float(abs(np.prod(z - np.array(poles)) / np.prod(z - np.array(zeros))))


@lru_cache(maxsize=8)
def a_weighting(rate: int) -> Filter:
    return Filter.of(*a_chain(rate))


def decibels(square: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(np.sqrt(square), QUIETEST))


def frames_of(pcm: np.ndarray, rate: int) -> np.ndarray:
    """dBFS of each whole frame of one signal."""
    n = frame_length(rate)
    y = a_weighting(rate).run(np.asarray(pcm, float))[0]
    return decibels((y[: len(y) // n * n].reshape(-1, n) ** 2).mean(axis=1))


#: An entry is what a chunk begins with: the number of samples before it, and the filter's state.
ENTRY = "session_id string, chunk_no long, first long, state array<double>"


def _composed(group: pd.DataFrame, entry: tuple[int, np.ndarray] | None = None) -> tuple[list[tuple[int, np.ndarray]], tuple[int, np.ndarray]]:
    """What each of some consecutive chunks begins with, and what the next one would. Rows: sample_rate, n, state (from
    silence), in order."""
    at, out = entry or (0, np.zeros(len(a_weighting(int(group["sample_rate"].iloc[0])).step))), []
    for r in group.itertuples(index=False):
        out.append(at)
        at = at[0] + int(r.n), np.asarray(r.state) + at[1] @ a_weighting(int(r.sample_rate)).power(int(r.n))
    return out, at


def entries(chunks: DataFrame) -> DataFrame:
    """What each chunk (session_id, chunk_no, sample_rate, n, state) begins with, where state is what its own samples leave
    of silence: filters are linear, so a state before a chunk only adds what silence makes of it.

    Chunks are composed in runs of RUN by their order, the runs of a session one after another, and then the chunks of each
    run from the run's entry. So a task gets RUN chunks, or one row for each run of a session.
    """
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("chunk_no")) - 1
    chunks = stored(chunks.withColumn("run", F.floor(order / RUN)))

    def ends(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk_no", kind="stable")
        n, state = _composed(group)[1]
        return pd.DataFrame([(key[0], key[1], int(group["sample_rate"].iloc[0]), n, state)], columns=["session_id", "run", "sample_rate", "n", "state"])

    def starts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("run", kind="stable")
        return pd.DataFrame([(key[0], int(run), *at) for run, at in zip(group["run"], _composed(group)[0], strict=True)], columns=["session_id", "run", "first", "state"])

    def each(key: tuple, group: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=["session_id", "chunk_no", "first", "state"])
        group = group.sort_values("chunk_no", kind="stable")
        own = _composed(group, (int(run["first"].iloc[0]), np.asarray(run["state"].iloc[0])))[0]
        return pd.DataFrame([(key[0], int(no), *at) for no, at in zip(group["chunk_no"], own, strict=True)], columns=["session_id", "chunk_no", "first", "state"])

    runs = chunks.groupBy("session_id", "run").applyInPandas(ends, "session_id string, run long, sample_rate int, n long, state array<double>")
    begun = runs.groupBy("session_id").applyInPandas(starts, "session_id string, run long, first long, state array<double>")
    return chunks.groupBy("session_id", "run").cogroup(begun.groupBy("session_id", "run")).applyInPandas(each, ENTRY)


def level_frames(samples: DataFrame) -> DataFrame:
    """(session_id, frame_no, dbfs) of samples (session_id, chunk_no, sample_rate, pcm array<float>), A-weighted. The filter
    runs on from chunk to chunk, frames run over chunks, and a last partial frame drops.

    A session may be of any length: chunks are filtered apart, in parallel, first from silence for the state that they
    leave, then from the state that they begin with. chunk_no is unique in a session, which has one sample rate. Null or
    empty chunks are silent for no time, null samples count as zero; rows without a session or a rate are left out.
    """
    rows = samples.where("session_id IS NOT NULL AND chunk_no IS NOT NULL AND sample_rate > 0")
    pcm = F.transform(F.coalesce("pcm", F.array().cast("array<float>")), lambda v: F.coalesce(v, F.lit(0.0).cast("float")))
    rows = rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("chunk_no").cast("long").alias("chunk_no"), F.col("sample_rate").cast("int").alias("sample_rate"), pcm.alias("pcm"))

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states = [a_weighting(rate).run(np.asarray(x, float))[1] for rate, x in zip(b["sample_rate"], b["pcm"], strict=True)]
            yield b[["session_id", "chunk_no", "sample_rate"]].assign(n=[len(x) for x in b["pcm"]], state=states)

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if len(r.pcm):
                    n = frame_length(r.sample_rate)
                    y = a_weighting(r.sample_rate).run(np.asarray(r.pcm, float), np.asarray(r.state))[0]
                    cuts = np.arange(-(r.first % n), len(y), n)
                    at = np.clip(cuts, 0, None)
                    out.append(pd.DataFrame({"session_id": r.session_id, "frame_no": (r.first + at) // n, "square": np.add.reduceat(y * y, at), "n": np.diff(np.append(at, len(y))), "whole": n}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["session_id", "frame_no", "square", "n", "whole"])

    begins = entries(rows.mapInPandas(left, "session_id string, chunk_no long, sample_rate int, n long, state array<double>"))
    # An entry is seven numbers beside thousands of samples: Spark sends them to the samples if they are few.
    parts = rows.join(begins, ["session_id", "chunk_no"]).mapInPandas(squares, "session_id string, frame_no long, square double, n long, whole long")
    frames = parts.groupBy("session_id", "frame_no").agg(F.sum("square").alias("square"), F.sum("n").alias("n"), F.first("whole").alias("whole")).where("n = whole")
    return frames.select("session_id", F.col("frame_no").cast("int").alias("frame_no"), ac.dbfs_of(F.sqrt(F.col("square") / F.col("n"))).alias("dbfs"))


def plain_frames(samples: DataFrame) -> DataFrame:
    """(session_id, frame_no, dbfs) of rows (session_id, sample_no, sample_rate, value), unweighted: built-ins only."""
    n = F.floor(F.col("sample_rate") * ac.FRAME_SECONDS + 0.5)
    g = samples.withColumn("frame_no", F.floor(F.col("sample_no") / n)).groupBy("session_id", "frame_no")
    out = g.agg(F.count("*").alias("k"), F.max(n).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return out.where("k = n").select("session_id", "frame_no", ac.dbfs_of("rms").alias("dbfs"))


def sessions(frames: DataFrame, device: str = "device_id", frames_needed: int = SESSION_FRAMES, stall: float = STALL_SECONDS) -> DataFrame:
    """Complete sessions of frames (device, ts, db_spl): device, session_no, block_no, first_ts and the frames with
    their number. A gap over `stall` seconds ends a capture; a capture is cut into whole sessions, the rest drops."""
    w = Window.partitionBy(device).orderBy("ts")
    gap = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > int(stall * 1e6)).cast("int"), F.lit(0))
    s = frames.withColumn("gap", gap).withColumn("session_no", F.sum("gap").over(w))
    no = F.row_number().over(Window.partitionBy(device, "session_no").orderBy("ts")) - 1
    s = s.withColumn("no", no).withColumn("block_no", F.floor(F.col("no") / frames_needed)).withColumn("frame_no", F.col("no") % frames_needed)
    whole = F.count("*").over(Window.partitionBy(device, "session_no", "block_no")) == frames_needed
    return s.withColumn("whole", whole).where("whole").drop("gap", "no", "whole")
