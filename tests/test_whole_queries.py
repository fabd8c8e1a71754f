"""Further registered graph queries against their SQL in DuckDB."""

from pathlib import Path

import pytest
from test_queries import SF
from test_queries import test_query_is_its_sql as same_as_sql

from hornbeam.operators import materialize
from hornbeam.plans.graph import Graph
from hornbeam.sources.shared import shared_dir


@pytest.mark.parametrize("name", ["known_object_counts", "known_subject_counts"])
def test_counts_of_known_facts(spark, name):
    same_as_sql(spark, name)


def test_semantic_materialization_by_parts(spark, monkeypatch):
    """It is its SQL in parts too, and what rules without possible violations predict is kept nowhere but in the result."""
    monkeypatch.setattr(materialize, "PART_ROWS", 12_000)
    monkeypatch.setattr(materialize, "TASKS", 4)
    folder = Path(shared_dir(spark).removeprefix("file://"), "hornbeam")
    before = {*folder.glob("*")}
    same_as_sql(spark, "materialize_semantic")
    made = {*folder.glob("*")} - before
    ruled = {r[0] for x in made if x.name.startswith("pairs") for r in spark.read.parquet(f"file://{x}").select("rule_id").distinct().collect()}
    assert not [x for x in made if x.name.startswith(("predictions", "adjacency"))]
    assert ruled and ruled <= {r.rule_id for r in Graph(spark, SF).vetoable()}
