"""Executors that lack the package."""

import os
import subprocess
import sys

import pytest

SCRIPT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "shipping.py")


def ship(part, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, SCRIPT, part], cwd=folder, env=env, capture_output=True, text=True, timeout=900)
    return out.stdout, out.stderr


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_core_queries_without_the_package(tmp_path):
    out, err = ship("core", tmp_path)
    assert "DONE" in out and "FAILED" not in out, out + err[-2000:]
