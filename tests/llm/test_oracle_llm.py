import pytest
from conftest import DATA, canonical

from brindle.llm import oracle, queries

Q = queries.queries()


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, duck, name):
    ours = Q[name](spark, f"{DATA}/sf0.01").toPandas()
    theirs = duck.sql(oracle.SQL[name]).df()
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(Q) - set(oracle.SQL)))
def test_query_runs(spark, name):
    assert Q[name](spark, f"{DATA}/sf0.001").count() > 0


COLUMNS = {
    "p1_found": ["table_name", "record_id", "pii_type"], "p2_found": ["conversation_id", "reason"], "p3_found": ["id", "defect"], "p4_found": ["doc_id", "seg_no"], "p5_found": ["doc_id", "first_entry", "last_entry"],
    "p6_found": ["doc_id", "seg_no"], "p7_found": ["doc_id"], "p8_found": ["source"], "p9_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = Q[name](spark, f"{DATA}/sf0.001")
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count()
