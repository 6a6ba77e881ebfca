"""Every core query: against its SQL, or at least to the end with stable columns."""

import oracle
import pytest

from cairn.plans import catalogue

QUERIES = {k: v for r in catalogue.registries() for k, v in r.queries.items()}
SQL = {k: v for r in catalogue.registries() for k, v in r.oracles.items()}


#: Rows over the smallest tables of the queries that SQL does not state; their operators are tested on fixtures.
ROWS = {
    "p1_nodes": 894, "p5_found": 83, "p5_normalised": 8, "activity_messages": 107, "html_to_text": 57, "markdown_blocks": 487, "cluster_memories": 54, "stub_embeddings": 148, "note_metadata": 100, "note_links": 200, "vault_statistics": 17,
}


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    frame = QUERIES[name](spark, data)
    if name in SQL:
        oracle.same(frame, con, SQL[name])
    else:
        assert frame.count() == ROWS[name]


def test_flagship_has_rows(spark, data):
    assert QUERIES[catalogue.FLAGSHIP](spark, data).count() > 0


def test_library_does_not_import_the_training_subpackage():
    from pathlib import Path

    import cairn

    root = Path(cairn.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "cairn.llm" not in path.read_text(), path
