"""State of one key between micro-batches.

A tracker takes the rows of its key in order (``feed``) and keeps a few
numbers, which ``dump`` gives as a tuple and the constructor takes back. Each
does the same as the batch operator it is named after.

The last two wait for the stream's time: ``feed`` takes rows in any order,
``settled`` gives what can no longer change once all rows up to a time are known,
and ``due`` the next time that settles something, or None if nothing is left.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from functools import cache
from typing import Any

import pandas as pd

from parley.operators import controller as rules


class ModeTracker:
    """``response_mode``: smoothed latency, last latencies, mode, turn."""

    state = "ewma double, last array<double>, mode int, turn long"

    def __init__(
        self, saved: tuple | None, latency: str, target: float, upper: float, lower: float
    ):
        start = rules.MODES.index(rules.START_MODE)
        self.latency, self.target, self.upper, self.lower = latency, target, upper, lower
        ewma, last, self.mode, self.turn = saved or (
            float(target),
            [],
            rules.encode_state(start, start, 0),
            0,
        )
        self.ewma = ewma
        self.last: deque[float] = deque(last, maxlen=rules.WINDOW)

    def asked(self, signal: float) -> int:
        if self.turn <= rules.WARM_UP:
            return len(rules.MODES)
        bounds = [self.target * self.lower, self.target * self.upper]
        return sum(signal >= b for b in bounds)

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        results = []
        for latency in rows[self.latency].tolist():
            self.turn += 1
            self.ewma = self.ewma * rules.KEEP + latency * rules.TAKE
            self.last.append(latency)
            p80 = sorted(self.last)[len(self.last) * 4 // 5]
            self.mode = rules.next_state(self.mode, self.asked(max(self.ewma, p80)))
            name = rules.MODES[self.mode // (len(rules.MODES) * rules.OTHER)]
            results.append((self.turn, self.ewma, p80, name))
        names = ["session_turn", "ewma", "p80", "mode"]
        added = pd.DataFrame(results, columns=names, index=rows.index)
        return pd.concat([rows, added], axis=1)

    def dump(self) -> tuple:
        return (self.ewma, list(self.last), self.mode, self.turn)


class EmotionTracker:
    """``emotion_decay``: the scores and the time of the last observation."""

    state = "scores array<double>, last_us long"

    def __init__(self, saved: tuple | None, observed: str, rate: float, classes: int):
        self.observed, self.rate = observed, rate
        scores, self.last = saved or ([0.0] * classes, None)
        self.scores = [float(s) for s in scores]

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        results = []
        for us, seen in zip(rows["_us"].tolist(), rows[self.observed].tolist(), strict=True):
            seconds = 0.0 if self.last is None else (us - self.last) / 1e6
            self.last = int(us)
            alpha = 1.0 - math.exp(-self.rate * seconds)
            self.scores = [
                (1.0 - alpha) * s + alpha * float(o)
                for s, o in zip(self.scores, seen, strict=True)
            ]
            results.append(self.scores)
        rows["scores"] = results
        return rows

    def dump(self) -> tuple:
        return (self.scores, self.last)


class ThrottleTracker:
    """``throttle_emit``: the time of the last emitted row."""

    state = "last_us long"

    def __init__(self, saved: tuple | None, interval: int):
        self.interval = interval
        self.last = saved[0] if saved else None

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        emitted = []
        for us in rows["_us"].tolist():
            due = self.last is None or us - self.last >= self.interval
            if due:
                self.last = int(us)
            emitted.append(due)
        return rows[emitted]

    def dump(self) -> tuple:
        return (self.last,)


class SegmentTracker:
    """``topic_segments``: counters, and the words of the newest messages.

    ``index`` is the first message not yet used. Only the messages of the
    shortest run with enough words are kept.
    """

    state = "count long, index long, segment long, run array<int>"

    def __init__(self, saved: tuple | None, words: str, min_words: int, advance: str):
        self.words, self.min_words, self.advance = words, min_words, advance
        self.count, self.index, self.segment, run = saved or (0, 0, 0, [])
        self.run = deque(int(w) for w in run)
        self.total = sum(self.run)

    def add(self, words: int) -> int:
        """Length of the segment that ends with this message, or 0."""
        self.count += 1
        self.run.append(words)
        self.total += words
        while self.total - self.run[0] >= self.min_words:
            self.total -= self.run.popleft()
        length = len(self.run)
        if self.total < self.min_words or length > self.count - self.index:
            return 0
        self.index = self.index + length if self.advance == "length" else self.count
        return length

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        results = []
        for place, words in enumerate(rows[self.words]):
            length = self.add(int(words))
            if length:
                end = self.count - 1
                results.append((place, self.segment, end - length + 1, end))
                self.segment += 1
        found = pd.DataFrame(results, columns=["_place", "segment", "start_pos", "end_pos"])
        keys = rows.iloc[found["_place"].tolist()].reset_index(drop=True)
        return pd.concat([keys, found], axis=1)

    def dump(self) -> tuple:
        return (self.count, self.index, self.segment, list(self.run))


class PairTracker:
    """``turn_pairs``: the user turn that waits for an answer."""

    state = "turn long, text string"

    def __init__(self, saved: tuple | None, turn: str, role: str, message: str):
        self.turn, self.role, self.message = turn, role, message
        self.open: tuple[Any, Any] = saved or (None, None)

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        results = []
        columns = zip(rows[self.turn], rows[self.role], rows[self.message], strict=True)
        for place, (turn, role, text) in enumerate(columns):
            if role == "assistant" and self.open[0] is not None:
                results.append((place, *self.open, text))
            self.open = (int(turn), text) if role == "user" else (None, None)
        names = ["_place", "_turn", "user_text", "assistant_text"]
        found = pd.DataFrame(results, columns=names)
        keys = rows.iloc[found["_place"].tolist()].reset_index(drop=True)
        return pd.concat([keys, found], axis=1).assign(**{self.turn: found["_turn"]})

    def dump(self) -> tuple:
        return self.open


@cache
def nothing(columns: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame(columns=list(columns))


def framed(rows: list[tuple], columns: tuple[str, ...]) -> pd.DataFrame:
    """Rows as a table; most keys of a batch settle nothing, and share one without rows."""
    return pd.DataFrame(rows, columns=list(columns)) if rows else nothing(columns)


class InterruptTracker:
    """``interrupted_turns``: turns that are not over, and the interrupts since then.

    A turn with an interrupt settles at once, any other at its end. An interrupt is
    kept until the stream's time has passed it: turns that start by then are known.
    """

    state = "turns array<struct<turn: string, start: long, end: long>>, cuts array<long>"

    def __init__(self, saved: tuple | None):
        turns, cuts = saved or ([], [])
        self.turns: list[tuple[Any, int, int]] = [tuple(t) for t in turns]
        self.cuts = [int(c) for c in cuts]

    def feed(self, rows: pd.DataFrame) -> None:
        columns = [rows[c].tolist() for c in ("_cut", "_turn", "_us", "_end_us")]
        for cut, turn, us, end in zip(*columns, strict=True):
            if cut:
                self.cuts.append(us)
            else:
                self.turns.append((turn, us, end))

    def settled(self, now: int) -> pd.DataFrame:
        self.cuts.sort()
        results, left = [], []
        for turn, start, end in self.turns:
            place = bisect_left(self.cuts, start)
            cut = place < len(self.cuts) and self.cuts[place] <= end
            if cut or end <= now:
                results.append((turn, start, end, cut))
            else:
                left.append((turn, start, end))
        self.turns = left
        self.cuts = self.cuts[bisect_left(self.cuts, now) :]
        return framed(results, ("_turn", "_start", "_stop", "_hit"))

    def due(self) -> int | None:
        times = [end for _, _, end in self.turns] + self.cuts[-1:]
        return min(times, default=None)

    def dump(self) -> tuple:
        return (self.turns, self.cuts)


class UtteranceTracker:
    """``utterance_sessions``: frames the stream's time has not passed, and the open piece.

    ``start`` and ``last`` are the first and last frame of the utterance, ``first`` and
    ``frames`` the first frame and the frames of its piece that is not out yet.
    """

    state = "waiting array<long>, start long, last long, piece long, first long, frames long"

    def __init__(self, saved: tuple | None, gap: int, longest: int):
        self.gap, self.longest = gap, longest
        waiting, self.start, self.last, self.piece, self.first, self.frames = saved or ([], None, None, 0, None, 0)
        self.waiting = [int(us) for us in waiting]
        self.out: list[tuple[int, int, int, int]] = []

    def feed(self, rows: pd.DataFrame) -> None:
        self.waiting.extend(rows["_us"].tolist())

    def close_piece(self) -> None:
        if self.frames:
            self.out.append((self.piece, self.first, self.last, self.frames))
        self.first, self.frames = None, 0

    def add(self, us: int) -> None:
        if self.start is not None and us - self.last >= self.gap:
            self.close_piece()
            self.start = None
        if self.start is None:
            self.start, self.piece = us, 0
        piece = (us - self.start) // self.longest
        if piece != self.piece:
            self.close_piece()
        self.piece, self.last = piece, us
        self.first = us if self.first is None else self.first
        self.frames += 1

    def settled(self, now: int) -> pd.DataFrame:
        self.out = []
        for us in sorted(us for us in self.waiting if us <= now):
            self.add(us)
        self.waiting = [us for us in self.waiting if us > now]
        if self.start is not None and self.last + self.gap <= now:
            self.close_piece()
            self.start = None
        elif self.frames and self.piece_end() <= now:
            self.close_piece()
        return framed(self.out, ("piece", "_start", "_stop", "frames"))

    def piece_end(self) -> int:
        return self.start + (self.piece + 1) * self.longest

    def due(self) -> int | None:
        times = list(self.waiting)
        if self.start is not None:
            times.append(self.last + self.gap)
        if self.frames:
            times.append(self.piece_end())
        return min(times, default=None)

    def dump(self) -> tuple:
        return (self.waiting, self.start, self.last, self.piece, self.first, self.frames)
