"""Registered graph queries against their SQL in DuckDB, and what the entry promises."""

import duckdb
import pytest

from hornbeam.plans import files, lift, queries

SF = "/root/testdata/sf0.001"
QUICK = ("scan_triples", "known_facts", "ground_path_2hop", "ground_pattern_triangle", "path_object_identity", "unary_start_nodes", "entity_types_closed", "disjoint_with_range", "materialize_standard", "materialize_until_target", "violations_func", "degree_filter", "inverse_functionality", "domain_satisfaction", "lp_metrics",
         "rule_scan", "rule_load", "amie_conversion", "ontology_scan", "prediction_log", "latest_run", "test_first_lines", "materialize_all_rules", "pattern_order", "violations_by_file", "domain_range_lookup", "tbox_builder", "named_entities", "metaedges", "property_axioms", "blank_and_system_classes", "rdfs_subproperties")


@pytest.mark.parametrize("name", QUICK)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in [*lift.TABLES, "region"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLE[name])
    columns = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want


def test_every_query_has_its_sql():
    assert files
    assert set(queries.QUERIES) == set(queries.ORACLE)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
