"""Every query of the training-data operators over the whole small tables."""

import oracle
import pytest

from cairn.llm import queries

QUERIES = {k: v for r in queries.registries() for k, v in r.queries.items()}
SQL = {k: v for r in queries.registries() for k, v in r.oracles.items()}
COLUMNS = {
    "p2_found": ["record_id_a", "record_id_b"],
    "p3_found": ["derived_object_id", "group_id"],
    "p4_found": ["segment_id"],
    "p6_found": ["source", "record_id", "message_index", "pii_type", "start_char"],
    "p7_found": ["source", "conversation_id"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "start_char"],
}


#: Rows over the smallest tables of the queries that SQL does not state; their operators are tested on fixtures.
ROWS = {
    "p2_found": 7, "p4_pieces": 2, "p6_found": 17, "p6_redacted": 290, "p7_found": 10, "p7_turns": 330, "p8_packed": 104, "p8_own_mixture": 104, "p8_containers": 21, "p8_mixture": 7,
    "p9_found": 1, "p9_spans": 1, "p10_found": 1774, "p10_sentences": 1774,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    frame = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert frame.columns == COLUMNS[name]
        assert frame.count() == frame.distinct().count()
    if name in SQL:
        oracle.same(frame, oracle.connect(data), SQL[name])
    else:
        assert frame.count() == ROWS[name]


def test_packed_windows_hold_their_mixture(spark, data):
    """Over the whole small table: no container over its capacity, and the first lane near its targets."""
    packed = QUERIES["p8_packed"](spark, data).collect()
    sizes = {}
    for r in packed:
        sizes[(r.lane, r.window)] = sizes.get((r.lane, r.window), 0) + r.n_tokens
    assert max(sizes.values()) <= 2048
    assert sum(sizes.values()) / 2048 / len(sizes) > 0.95
