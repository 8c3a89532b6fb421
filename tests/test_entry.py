"""The driver's entry module, with and without the dealt operators."""

import importlib
import os
import sys

import duckdb
import pytest

from kbspark.plans import corpus
from kbspark.plans import queries as plans
from kbspark.sources import scratch


def test_entry_without_the_dealt_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "kbspark.llm", None)
    module = importlib.reload(__spark_entry__)
    assert set(module.queries()) == set(plans.QUERIES) and set(module.oracle_sql()) == set(plans.ORACLES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


class Elsewhere:
    """A session as far as scratch folders ask it."""

    def __init__(self, master, folder=None):
        self.conf, self.sparkContext = self, self
        self.master, self.folder, self.applicationId = master, folder, "app"

    def get(self, key, default):
        return self.folder or default


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(scratch.NoSharedFolder):
            scratch.fresh_path(Elsewhere(master), "x")
        assert scratch.fresh_path(Elsewhere(master, "s3a://b/c"), "x").startswith("s3a://b/c/kbspark-app/x-")
    assert scratch.scratch_dir(Elsewhere("local[4]")).startswith("file://")


def test_scratch_tables_of_a_scope_are_deleted(spark):
    before = scratch.stored(spark.range(3), "before")
    with scratch.scope(spark) as keep:
        gone, kept = scratch.stored(spark.range(4), "gone"), keep(scratch.stored(spark.range(5), "kept"))
    assert before.df.count() == 3 and kept.df.count() == 5
    assert not os.path.exists(gone.path.removeprefix("file://")) and os.path.exists(kept.path.removeprefix("file://"))


def test_scans_are_as_files_split_them(spark):
    rows = corpus.table(spark, "/root/testdata/sf0.001", "documents")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["concept_id", "score"]


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    rel = con.sql(plans.ORACLES[name])
    order = sorted(rel.columns)
    wanted = sorted((tuple(dict(zip(rel.columns, r))[c] for c in order) for r in rel.fetchall()), key=repr)
    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == wanted


def test_all_kinds_are_listed_with_counts(spark):
    found = plans.QUERIES["list_all_with_graph_counts"](spark, "/root/testdata/sf0.001").groupBy("type").count().collect()
    assert {r["type"] for r in found} == {"customer", "supplier", "nation", "region", "part"}


def test_pagerank_converges(spark, tmp_path):
    """Against plain rounds until nothing moves."""
    import pandas as pd

    suppliers, parts = range(1, 4), range(1, 7)
    items = [(1, 1), (1, 2), (2, 2), (2, 2), (3, 3), (1, 4), (3, 4), (3, 5)]
    for name, rows in (("supplier", {"s_suppkey": suppliers}), ("part", {"p_partkey": parts}), ("lineitem", {"l_suppkey": [s for s, _ in items], "l_partkey": [p for _, p in items], "l_linenumber": [1, 2] * 4})):
        spark.createDataFrame(pd.DataFrame(rows)).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r.concept_id: r.pagerank for r in plans.QUERIES["pagerank_supply_converged"](spark, str(tmp_path)).collect()}
    ids = [f"s/{s}" for s in suppliers] + [f"p/{p}" for p in parts]
    out = {i: [] for i in ids}
    for s, p in items:
        out[f"s/{s}"].append(f"p/{p}")
        out[f"p/{p}"].append(f"s/{s}")
    ranks = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(500):
        sunk = sum(ranks[i] for i in ids if not out[i])
        ranks = {i: (0.15 + 0.85 * sunk) / len(ids) + 0.85 * sum(ranks[j] * out[j].count(i) / len(out[j]) for j in ids if out[j]) for i in ids}
    assert set(found) == set(ids) and all(abs(found[i] - ranks[i]) < 1e-5 for i in ids)
