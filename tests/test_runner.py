"""The process runner's limits with stub programs."""

import os
import sys
import time

import pytest

from chronoforest.plans import batch as B

SPAWN = "import subprocess, sys, time; c = subprocess.Popen([sys.executable, '-c', 'import time; time.sleep(60)']); print(c.pid, flush=True); time.sleep(60)"


def stub(code, **limits):
    made = {}
    return (*B.run_engine([sys.executable, "-c", code], {"in.txt": "x"}, limits.pop("timeout", 60), made, **limits), made)


def test_ok_and_failed():
    status, code, log, _, made = stub("print(open('in.txt').read()); open('out.txt', 'w').write('y')")
    assert (status, code, log, made) == ("ok", 0, "x\n", {"out.txt": "y"})
    status, code, log, _, made = stub("import sys; print('why', file=sys.stderr); sys.exit(3)")
    assert (status, code, log, made) == ("failed", 3, "why\n", {})
    assert B.run_engine(["no-such-program-here"], {}, 1)[0] == "unavailable"


def test_too_long_ends_the_whole_group():
    status, code, log, seconds, _ = stub(SPAWN, timeout=3)
    assert (status, code) == ("timeout", None) and seconds < 30
    child = int(log.split()[0])
    for _ in range(50):
        try:
            os.kill(child, 0)
            with open(f"/proc/{child}/stat") as f:
                if f.read().rpartition(")")[2].split()[0] == "Z":
                    break
        except OSError:
            break
        time.sleep(0.1)
    else:
        pytest.fail("a program's own child lives on")


def test_too_much_output():
    status, _, log, _, made = stub("import sys\nopen('part', 'w').write('z')\nwhile True: sys.stdout.write('line of text\\n' * 1000)", max_output=1 << 20)
    assert status == "output_limit" and len(log) < 2 * B.LOG_BYTES and log.startswith("line of text") and made == {}


def test_too_much_memory():
    status, _, _, _, _ = stub("x = bytearray(300 << 20)\nimport time\ntime.sleep(60)", max_memory=200 << 20)
    assert status == "memory_limit"


def test_long_logs_keep_head_and_tail(tmp_path):
    (tmp_path / "log").write_text("a" * 50 + "b" * 900 + "c" * 50)
    text = B.head_and_tail(str(tmp_path / "log"), 100)
    assert text.startswith("a" * 50 + "\n") and text.endswith("\n" + "c" * 50) and "900 bytes" in text
