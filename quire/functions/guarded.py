"""Calls in a child process with limits, so that a document cannot take its task with it."""

from __future__ import annotations

import multiprocessing
import os
import resource
import signal
from collections.abc import Callable, Mapping

GRACE = 5.0
_fork = multiprocessing.get_context("fork")


class Guard:
    """Calls one of ``functions`` by name, in a child that lives as long as it behaves.

    A call that takes more than ``seconds``, or ends the process, is a ``RuntimeError`` here,
    and the next call gets a new child. One that needs more than ``memory`` bytes beyond what
    the process has is a ``MemoryError`` of the call, or its end where native code does not
    survive that. An exception of the call itself is a ``RuntimeError`` with its text.

    The limit of time is a timer of the child's kernel, so it also ends a child whose task is
    gone; one that is not in a call ends with the task's side of the pipe.
    """

    def __init__(
        self, functions: Mapping[str, Callable], seconds: float | None = None,
        memory: int | None = None,
    ):
        self.functions, self.seconds, self.memory = functions, seconds, memory
        self.child = self.pipe = None

    def __call__(self, name: str, argument: bytes):
        if self.child is None:
            self._start()
        try:
            self.pipe.send((name, argument))
            if not self.pipe.poll(None if self.seconds is None else self.seconds + GRACE):
                raise RuntimeError(self._late())
            good, found = self.pipe.recv()
        except (EOFError, OSError):
            raise RuntimeError(self._ended()) from None
        except RuntimeError:
            self.close()
            raise
        if good:
            return found
        raise RuntimeError(found)

    def close(self) -> None:
        if self.child is not None:
            self.pipe.close()
            self.child.kill()  # it has nothing to save
            self.child.join()
            self.child.close()
            self.child = self.pipe = None

    def _start(self) -> None:
        self.pipe, theirs = _fork.Pipe()
        self.child = _fork.Process(target=self._serve, args=(self.pipe, theirs), daemon=True)
        self.child.start()
        theirs.close()

    def _late(self) -> str:
        return f"conversion timed out after {self.seconds:g}s"

    def _ended(self) -> str:
        self.child.join(GRACE)
        code = self.child.exitcode
        self.close()
        if code == -signal.SIGALRM:
            return self._late()
        how = f"signal {-code}" if code is not None and code < 0 else f"exit code {code}"
        return f"conversion ended its process ({how})"

    def _serve(self, ours, pipe) -> None:
        ours.close()  # else the end of the task would not be seen
        signal.signal(signal.SIGALRM, signal.SIG_DFL)
        if self.memory is not None:
            limit = _address_space() + self.memory
            _, most = resource.getrlimit(resource.RLIMIT_AS)
            soft = limit if most == resource.RLIM_INFINITY else min(limit, most)
            resource.setrlimit(resource.RLIMIT_AS, (soft, most))
        while True:
            try:
                name, argument = pipe.recv()
            except EOFError:
                os._exit(0)
            signal.setitimer(signal.ITIMER_REAL, self.seconds or 0)
            try:
                reply = True, self.functions[name](argument)
            except Exception as problem:
                reply = False, str(problem) or type(problem).__name__
            signal.setitimer(signal.ITIMER_REAL, 0)
            pipe.send(reply)


def _address_space() -> int:
    with open("/proc/self/statm", encoding="ascii") as file:
        return int(file.read().split()[0]) * resource.getpagesize()
