import pytest

from millrace.spec import Aggregate, Distinct, GroupBy, Join, Ref, parse


def test_specs():
    q = parse("S=b join:S0=R1 R=a res:S1,R5,R5")
    assert q == Join("a", "b", Ref("R", 1), Ref("S", 0), (Ref("S", 1), Ref("R", 5), Ref("R", 5)))
    q = parse("R=a", "groupby:R2", "res:count,avg(R3),max(R4)")
    assert q == GroupBy("a", Ref("R", 2), (Aggregate("count"), Aggregate("avg", Ref("R", 3)), Aggregate("max", Ref("R", 4))))
    assert [a.name for a in q.res] == ["count", "avg(R3)", "max(R4)"]
    assert parse("R=a select:R7,gt,1800 distinct:R3,R4") == Distinct("a", Ref("R", 7), "gt", 1800.0, (Ref("R", 3), Ref("R", 4)))


@pytest.mark.parametrize("bad", ["", "R=a", "R=a S=b join:R0=R1 res:R1", "R=a groupby:R1 res:median(R2)", "R=a groupby:S1 res:count", "R=a select:R1,like,3 distinct:R1", "R=a select:R1,gt distinct:R1", "R=a R=b groupby:R1 res:count", "nonsense"])
def test_errors_show_the_usage(bad):
    with pytest.raises(ValueError, match="R=<path>"):
        parse(bad)
