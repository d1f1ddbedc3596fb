from loomwork.operators import entities


def test_link_is_greedy(spark):
    q = spark.createDataFrame([(1, "New York City hall in new york"), (2, None), (3, "")], "qid int, query string")
    n = spark.createDataFrame([("new york",), ("new york city",), ("york city hall",), ("hall",)], "canon string")
    got = sorted((r.qid, r.start, r.canon) for r in entities.link(q, n).collect())
    assert got == [(1, 1, "new york city"), (1, 4, "hall"), (1, 6, "new york")]


def test_subset_aliases(spark):
    n = spark.createDataFrame([("ann",), ("ann lee",), ("bob",), ("bob ray",), ("bob kay",), ("bob",)], "canon string")
    got = {(r.alias, r.canon, r.status) for r in entities.subset_aliases(n).collect()}
    assert got == {("ann", "ann lee", "active"), ("bob", "bob ray", "candidate"), ("bob", "bob kay", "candidate")}
    assert entities.subset_aliases(n.limit(0)).count() == 0


def test_initial_aliases(spark):
    n = spark.createDataFrame([("ann lee",), ("ann l",), ("bob ray",)], "canon string")
    assert [(r.alias, r.canon) for r in entities.initial_aliases(n).collect()] == [("ann l", "ann lee")]
