"""Rows of groups that many queries share."""

from test_link_prediction import _graph, _run

from hornbeam.operators import grounding


def _tasks(df):
    """How many tasks write the rows of the group with most queries, and its rows."""
    own = df.filter("side = 'sub'").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    return sum(n > 0 for n in own), sum(own)


def test_tie_blocks_of_many_queries_are_dealt_to_tasks(spark):
    """300 queries share the subject side's group of 600 candidates."""
    lp = _run(spark, (0.5, 0.4), *_graph(600, 300), False)
    tasks, rows = _tasks(lp.blocks())
    assert tasks > 4 and rows > 80_000


def test_few_queries_of_large_groups_are_sent_to_the_rows(spark, monkeypatch):
    """The bound is for the queries that are joined, not for those of all groups."""
    monkeypatch.setattr(grounding, "BROADCAST_ROWS", 400)
    monkeypatch.setattr("pyspark.sql.functions.broadcast", lambda df, real=grounding.F.broadcast: sent.append(df.columns) or real(df))
    sent = []
    lp = _run(spark, (0.5, 0.4), *_graph(600, 300), False)
    lp.rows("name", sides=("obj", "sub"))
    assert lp.asked.hornbeam_rows > 400 and ["anchor", "ask", "qid", "target"] in sent
