"""Every query has a name of its problem, and the module names no query twice."""

import re

from hebbspark.llm import queries as Q


def test_names():
    names = list(Q.queries())
    assert all(re.fullmatch(r"p[1-7]_\w+", n) for n in names)
    assert {n[:2] for n in names} == {f"p{i}" for i in range(1, 8)}
    assert set(Q.oracle_sql()) <= set(names)
