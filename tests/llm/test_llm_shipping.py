"""Executors that lack the package."""

import os

import pytest

from tests.test_shipping import ship


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_without_the_package(tmp_path):
    out, err = ship("llm", tmp_path)
    assert "DONE" in out and "FAILED" not in out, out + err[-2000:]
