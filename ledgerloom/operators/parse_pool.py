"""Parsing in child processes, so that no text can take a task down.

Each pool has a few children that read requests from a pipe, one after the
other.  A child that dies on a text is started anew and the text is tried once
more; one that is still at a text after the time limit is killed and the text
isn't tried again.  Either way the file is passed over.
"""

from __future__ import annotations

import pickle
import select
import struct
import subprocess
import sys
from collections.abc import Callable

TIMEOUT_S = 30.0
WORKERS = 2


def _send(pipe, value: object) -> None:
    raw = pickle.dumps(value)
    pipe.write(struct.pack("<q", len(raw)) + raw)
    pipe.flush()


class Child:
    def __init__(self, function: str):
        module, _, name = function.partition(":")
        code = f"import sys; sys.path[:0] = {sys.path!r}\nfrom {module} import {name} as f\nfrom ledgerloom.operators.parse_pool import serve\nserve(f)"
        self.process = subprocess.Popen([sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def _read(self, size: int, timeout: float) -> bytes:
        out = b""
        while len(out) < size:
            if not select.select([self.process.stdout], [], [], timeout)[0]:
                raise TimeoutError
            part = self.process.stdout.read1(size - len(out))
            if not part:
                raise EOFError
            out += part
        return out

    def ask(self, args: tuple, timeout: float) -> object:
        _send(self.process.stdin, args)
        return pickle.loads(self._read(struct.unpack("<q", self._read(8, timeout))[0], timeout))

    def stop(self) -> None:
        self.process.kill()
        self.process.wait()


def serve(function: Callable) -> None:
    """The loop of a child: until its pipe is closed."""
    source, sink = sys.stdin.buffer, sys.stdout.buffer
    sys.stdout = sys.stderr  # what a parser prints must not reach the pipe
    while head := source.read(8):
        _send(sink, function(*pickle.loads(source.read(struct.unpack("<q", head)[0]))))


class ParsePool:
    """``function`` as ``module:name``, called in the children by turns."""

    def __init__(self, function: str = "ledgerloom.operators.extract:extract", workers: int = WORKERS, timeout: float = TIMEOUT_S):
        self.function, self.timeout, self.turn = function, timeout, 0
        self.children: list[Child | None] = [None] * workers

    def call(self, *args: object) -> object | None:
        """The result, or None for a text that crashed two children or took
        longer than the limit."""
        for _ in range(2):
            self.turn = (self.turn + 1) % len(self.children)
            child = self.children[self.turn] or Child(self.function)
            self.children[self.turn] = child
            try:
                return child.ask(args, self.timeout)
            except TimeoutError:
                child.stop()
                self.children[self.turn] = None
                return None
            except (EOFError, BrokenPipeError):
                child.stop()
                self.children[self.turn] = None
        return None

    def close(self) -> None:
        for child in self.children:
            if child is not None:
                child.stop()
        self.children = [None] * len(self.children)
