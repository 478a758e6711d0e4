"""The operators' queries against their SQL, on given tables and on awkward rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.data import documents, prose
from tests.oracle import compare
from uqframe.llm.queries import QUERIES

WITH_SQL = [n for n, (_, sql) in QUERIES.items() if sql is not None]


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, name):
    query, sql = QUERIES[name]
    assert compare(spark, name, query, sql, "/root/testdata/sf0.001") == ""


def awkward():
    rows = [(r[0], r[1], r[2], r[3]) for r in documents() if r[0] is not None][:-1]
    shared = "A line of this host that is on nearly every page of it"
    # 399 different texts and an empty one and a null one: 20 of 399 texts are above 5 %, of 400 not
    for k in range(398):
        line = f"{shared}\n" if k < 20 else ""
        rows.append((1000 + k, f"{line}{prose(3000 + k, 60)}", "en", "big"))
    rows += [(1500, "", "en", "big"), (1501, None, "en", "big")]
    for k in range(30):
        rows.append((1600 + k, f"{shared}\n{prose(4000 + k, 55)}", None, None))
    return rows


@pytest.mark.parametrize("name", ["op1_quality_rules", "op8_substrings", "op11_collocations"])
def test_awkward_documents(spark, tmp_path, name):
    columns = list(zip(*awkward()))
    table = pa.table({"doc_id": pa.array(columns[0], pa.int64()), "text": pa.array(columns[1], pa.string()),
                      "lang": pa.array(columns[2], pa.string()), "source": pa.array(columns[3], pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    query, sql = QUERIES[name]
    assert compare(spark, name, query, sql, str(tmp_path)) == ""
    if name == "op1_quality_rules":
        lost = {r.doc_id: r.n_lost for r in query(spark, str(tmp_path)).collect()}
        assert sum(lost[k] > 0 for k in range(1000, 1020)) == 19 and lost[1601] > 0
