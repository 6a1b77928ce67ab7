"""What a search by one's own function writes."""

import re

from manifolder.plans import queries


def test_only_lists_of_neighbours_are_dealt(spark, sf):
    """Before the pairs went through bounds, all of them were dealt and sorted."""
    plan = queries.QUERIES["knn_callable"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    crossed = [m.start() for m in re.finditer("CartesianProduct|BroadcastNestedLoopJoin", plan)]
    above = [re.findall(r"Exchange|MapInArrow", plan[:at])[-1] for at in crossed]
    assert crossed and set(above) == {"MapInArrow"}
