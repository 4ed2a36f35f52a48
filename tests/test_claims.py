"""Docstrings say which lines of the inventory a query covers; every model line has one."""

import re

import pytest

from panelwright.plans import registry


def claimed(text):
    spans = re.findall(r"\b([A-Z])(\d+)(?:-[A-Z](\d+))?", text)
    return {f"{k}{i}" for k, a, b in spans for i in range(int(a), int(b or a) + 1)}


@pytest.mark.parametrize("line", [f"M{i}" for i in range(1, 31)])
def test_every_model_line_is_claimed_by_a_query_of_its_kind(line):
    assert [n for n, f in registry.QUERIES.items() if line in claimed(f.__doc__ or "")]
