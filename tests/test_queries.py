import pytest

import quillmill.queries as core
from tests.parity import connect, same

SLOW = {"lda_topics", "kmeans_projection", "similar_words"}


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_sql(spark, small, name):
    same(core.queries()[name](spark, small), connect(small), core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql()) - SLOW))
def test_runs(spark, small, name):
    df = core.queries()[name](spark, small)
    got = df.collect()
    assert got and all(any(r[c] is not None for r in got) for c in df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_llm():
    from pathlib import Path

    root = Path(core.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillmill.llm" not in p.read_text(), p
