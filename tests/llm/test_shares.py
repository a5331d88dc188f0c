"""Shares of the splits, wanted and got."""


def test_shares_are_met_and_no_group_is_torn(spark, data):
    from skylattice.llm.queries import p3_shares

    rows = {r.split: r for r in p3_shares(spark, data).collect()}
    assert set(rows) == {"train", "val", "test"} and all(r.torn == 0 for r in rows.values())
    assert abs(sum(r.got for r in rows.values()) - 1) < 1e-5 and abs(sum(r.wanted for r in rows.values()) - 1) < 1e-5
