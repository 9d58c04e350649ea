"""Scoring functions under a time limit, in processes of their own."""

from __future__ import annotations

import multiprocessing
import multiprocessing.connection
import time
from collections.abc import Callable


def _serve(function: Callable, pipe) -> None:
    while (arguments := pipe.recv()) is not None:
        try:
            pipe.send((function(*arguments), None))
        except Exception as e:  # noqa: BLE001 - a row's failure is its result
            pipe.send((None, f"{type(e).__name__}: {e}"[:200]))


class Pool:
    """Some processes that each evaluate one call at a time; one that is over its time is ended and replaced."""

    def __init__(self, function: Callable, size: int) -> None:
        self.function, self.size = function, size
        self.context = multiprocessing.get_context("fork")
        self.workers: list[tuple] = []

    def __enter__(self) -> Pool:
        self.workers = [self._start() for _ in range(self.size)]
        return self

    def __exit__(self, *_) -> None:
        for process, pipe in self.workers:
            process.kill()
            process.join()
            pipe.close()

    def _start(self) -> tuple:
        here, there = self.context.Pipe()
        process = self.context.Process(target=_serve, args=(self.function, there), daemon=True)
        process.start()
        there.close()
        return process, here

    def map(self, calls: list[tuple], seconds: float) -> list[tuple]:
        """(value, failure) of each call, in order; failure is null, "timeout", or what was raised."""
        out: list[tuple] = [(None, "lost")] * len(calls)
        busy: dict[int, tuple[int, float]] = {}
        left = list(range(len(calls)))[::-1]
        while left or busy:
            for w in range(self.size):
                if w not in busy and left:
                    i = left.pop()
                    self.workers[w][1].send(calls[i])
                    busy[w] = i, time.monotonic() + seconds
            pipes = {self.workers[w][1]: w for w in busy}
            soonest = min(end for _, end in busy.values())
            ready = multiprocessing.connection.wait(list(pipes), max(0.0, soonest - time.monotonic()))
            for pipe in ready:
                w = pipes[pipe]
                i, _ = busy.pop(w)
                try:
                    out[i] = pipe.recv()
                except EOFError:
                    out[i] = None, "died"
                    self.workers[w] = self._start()
            now = time.monotonic()
            for w in [w for w, (_, end) in busy.items() if end <= now]:
                i, _ = busy.pop(w)
                out[i] = None, "timeout"
                self.workers[w][0].kill()
                self.workers[w][0].join()
                self.workers[w][1].close()
                self.workers[w] = self._start()
        return out
