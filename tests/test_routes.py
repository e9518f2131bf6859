import random

import pytest

from lexmill.operators import routes as R

EDGES, NODES, ASKED = "src long, dst long, pos int", "node long", "question long, entry long, target long"


def reader(edges, pages, entry, target):
    """One page after another in the order in which they were found, links in the order in which they stand."""
    if entry not in pages or target not in pages:
        return None
    first = {}
    for s, d, p in edges:
        first[s, d] = min(first.get((s, d), p), p)
    queue, seen = [(entry,)], {entry}
    while queue:
        route = queue.pop(0)
        if route[-1] == target:
            return list(route)
        for d in [d for (s, d), p in sorted(first.items(), key=lambda x: (x[1], x[0][1])) if s == route[-1]]:
            if d in pages and d not in seen:
                seen.add(d)
                queue.append((*route, d))
    return None


@pytest.mark.parametrize("seed", range(4))
def test_routes_equal_a_reader(spark, seed):
    r = random.Random(seed)
    pages = set(range(40))
    edges = [(r.randrange(40), r.randrange(44), r.randrange(6)) for _ in range(110)]
    asked = [(q, r.randrange(42), r.randrange(42)) for q in range(50)] + [(90, 1, 2), (90, 2, 1), (91, 5, 5)]
    got = R.question_routes(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(p,) for p in pages], NODES), spark.createDataFrame(asked, ASKED)).collect()
    assert len(got) == len(asked)
    for x in got:
        want = reader(edges, pages, x["entry"], x["target"])
        assert x["route"] == want and x["hops"] == (None if want is None else len(want) - 1)
        assert x["status"] == ("reached" if want else "entry_missing" if x["entry"] not in pages else "target_missing" if x["target"] not in pages else "unreachable")


def test_long_walk_and_no_questions(spark):
    edges = spark.createDataFrame([(i, i + 1, 0) for i in range(12)], EDGES)
    pages = spark.createDataFrame([(i,) for i in range(13)], NODES)
    got = R.question_routes(edges, pages, spark.createDataFrame([(1, 0, 12), (2, 3, 10), (3, 5, 4)], ASKED)).orderBy("question").collect()
    assert [(x["hops"], x["route"]) for x in got] == [(12, list(range(13))), (7, list(range(3, 11))), (None, None)]
    assert R.question_routes(edges, pages, spark.createDataFrame([], ASKED)).count() == 0


def test_jump_codes(spark):
    routed = spark.createDataFrame([(i, 9, [1, 9]) for i in range(6)] + [(6, 9, None)], "question long, target long, route array<long>")
    answers = [(0, True, [1, 9], 9), (1, True, [1, 9], None), (2, True, [1, 2, 9], 9), (3, True, [], 3), (4, False, [1, 9], 9), (5, True, [1, None], None), (6, True, [1], None), (7, True, [1], None)]
    got = R.check_jumps(spark.createDataFrame(answers, "question long, positive boolean, jumps array<long>, first_hit long"), routed)
    assert sorted(map(tuple, got.collect())) == [(2, "JUMPS_OFF_ROUTE"), (3, "HIT_OFF_TARGET"), (3, "JUMPS_INVALID"), (4, "NEGATIVE_HIT"), (5, "JUMPS_INVALID"), (6, "ROUTE_MISSING"), (7, "ROUTE_MISSING")]
