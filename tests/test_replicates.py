"""The registered bootstrap takes the operator's own replicate count."""

from tractspark.plans import queries as Q


def test_bootstrap_runs_all_replicates(spark, monkeypatch):
    taken, real = [], Q.S.bootstrap_delta
    monkeypatch.setattr(Q.S, "bootstrap_delta", lambda rows, base, replicates=5000: taken.append(replicates) or real(rows, base, replicates=replicates))
    Q.bootstrap_intervals(spark, "/root/testdata/sf0.001")
    assert taken == [5000]
