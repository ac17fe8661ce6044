import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from gaugeflow.llm import decontam, secrets
from gaugeflow.llm.common import table
from gaugeflow.llm.oracle import ORACLE
from gaugeflow.llm.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent.parent
SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        kept = docs.collect()
        assert {r["doc_id"] for r in kept} <= before and len(kept) >= 0.6 * len(before), name
        if name == "decontamination":
            benchmark = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            assert all(row[1] == 0 for row in decontam.brute_force([r["text"] for r in kept], benchmark))
            dirty = [d for d, row in zip(before, decontam.brute_force([texts[d] for d in before], benchmark)) if row[1]]
            assert {r["doc_id"] for r in kept} == before - set(dirty)
        if name == "secrets":
            assert {r["doc_id"] for r in kept} == before
            for r in kept:
                assert r["n_chars"] == len(r["text"]) and sum(secrets.brute_force(r["text"])[:3]) == 0
                if sum(secrets.brute_force(texts[r["doc_id"]])[:3]) == 0 and "[SECRET]" not in r["text"]:
                    assert r["text"] == texts[r["doc_id"]]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in mixed) == sorted(r["doc_id"] for r in docs.collect())


def test_stages_take_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "Words of a text.", "en", "s", 16)], empty.schema)
    odd = odd.selectExpr("*", "'own' AS score", "1 AS contaminated")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert out.count() == (2 if name == "near_duplicates" else 4), name


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    import duckdb

    base = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = base.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted(map(str, cursor.fetchall()))
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in found.collect()) == expected


def test_the_rest_stands_without_the_subpackage():
    """With the subpackage and the pipeline file hidden, the entry module offers the other queries."""
    code = (
        "import sys\n"
        "class Hidden:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('gaugeflow.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hidden())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert names and not any(n.startswith('op') or n == 'pipeline' for n in names) and set(e.oracle_sql()) <= names\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
