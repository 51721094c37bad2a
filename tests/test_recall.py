"""The cell index against the exact search."""

from corvid.plans.catalog import QUERIES


def test_cells_are_exact(spark):
    sf = "/root/testdata/sf0.01"
    got = {n: {tuple(r) for r in QUERIES[n](spark, sf).collect()} for n in ("ivf_topk", "ivf_exact", "knn_grid", "knn_batch")}
    assert got["ivf_topk"] == got["ivf_exact"] == got["knn_grid"] == got["knn_batch"]
