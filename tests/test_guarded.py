"""Documents that hang, end their process or take all memory are failed rows."""

import os
import signal
import time

import pytest

from helpers import docs
from quire.functions.guarded import Guard
from quire.operators.convert import convert
from quire.options import Options


def poison():
    # made inside a function, so that it travels by value
    def convert(content):
        if content == b"sleep":
            time.sleep(600)
        if content == b"spin":
            while True:
                pass
        if content == b"exit":
            os._exit(3)
        if content == b"kill":
            os.kill(os.getpid(), signal.SIGKILL)
        if content == b"memory":
            held = []
            while True:
                held.append(bytearray(16 << 20))
        if content == b"raise":
            raise ValueError("cannot read this")
        return {"md": content.decode()}

    return convert


FAILURES = {
    b"sleep": "conversion timed out after 1s", b"spin": "conversion timed out after 1s",
    b"exit": "conversion ended its process (exit code 3)",
    b"kill": "conversion ended its process (signal 9)",
    b"memory": "MemoryError", b"raise": "cannot read this"}


def test_each_poison_is_an_error_and_the_next_call_works():
    guard = Guard({"f": poison()}, seconds=1, memory=256 << 20)
    for content, error in FAILURES.items():
        with pytest.raises(RuntimeError) as problem:
            guard("f", content)
        assert str(problem.value) == error
        assert guard("f", b"fine") == {"md": "fine"}
    guard.close()
    assert guard.child is None


def test_a_child_serves_many_calls_and_large_ones():
    guard = Guard({"f": lambda content: os.getpid(), "g": len, "h": bytes}, seconds=60)
    first = guard("f", b"")
    assert first != os.getpid() and guard("f", b"") == first
    large = bytes(50 << 20)
    assert guard("g", large) == len(large) and guard("h", large) == large
    guard.close()
    with pytest.raises(ProcessLookupError):
        os.kill(first, 0)


def test_a_late_call_without_the_timer_is_ended_from_outside(monkeypatch):
    from quire.functions import guarded
    monkeypatch.setattr(guarded, "GRACE", 0.2)

    def stubborn(content):
        signal.setitimer(signal.ITIMER_REAL, 0)
        time.sleep(600)

    guard = Guard({"f": stubborn}, seconds=0.5)
    with pytest.raises(RuntimeError, match="timed out after 0.5s"):
        guard("f", b"")
    assert guard.child is None


def test_poison_documents_are_failed_rows_and_the_rest_is_converted(spark):
    files = {f"/in/{content.decode()}.txt": content for content in FAILURES}
    files |= {f"/in/{i}.txt": b"text %d" % i for i in range(40)}
    limits = Options(document_seconds=1, document_memory=256 << 20)
    rows = convert(docs(spark, files).coalesce(1), {".txt": poison()}, limits).collect()
    assert len(rows) == len(files)
    for row in rows:
        content = files[row["path"]]
        assert row["error"] == FAILURES.get(content)
        assert row["md"] == (None if content in FAILURES else content.decode())


def test_limits_can_be_left_out(spark):
    here = convert(docs(spark, {"/in/a.txt": b"x"}), {".txt": lambda content: {"md": "y"}},
                   Options(document_seconds=None))
    assert here.first()["md"] == "y"
