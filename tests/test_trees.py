"""Tree selection and rebasing on a tree small enough to follow."""

from corpusloom.operators import trees as T

ROWS = [("a", "x", 50, 1), ("a", "y", 5, 1), ("a", "z", 5, 1), ("b", "u", 2, 60), ("b", None, 1, 1), ("c", "v", 1, 1), ("d", "w", 0, 0)]


def leaves(df):
    return {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()}


def test_select_tree(spark):
    paths = spark.createDataFrame(ROWS, "top string, low string, p long, q long")
    got = leaves(T.select_tree(paths, ("top", "low"), "p", "q", (10.0, 40.0)))
    assert got == {("a", "x"): (50, 1), ("a", T.REMAINING): (10, 2), ("b", "u"): (2, 60), ("b", None): (1, 1), (T.REMAINING, None): (1, 1)}


def test_the_largest_child_is_named_where_none_reaches_the_threshold(spark):
    paths = spark.createDataFrame([("a", "x", 3, 1), ("a", "y", 4, 1), ("a", "z", 4, 1)], "top string, low string, p long, q long")
    assert leaves(T.select_tree(paths, ("top", "low"), "p", "q", (50.0, 90.0))) == {("a", "y"): (4, 1), ("a", T.REMAINING): (7, 2)}


def test_empty_tree_and_zero_sums(spark):
    paths = spark.createDataFrame([], "top string, low string, p long, q long")
    assert T.select_tree(paths, ("top", "low"), "p", "q", (1.0, 1.0)).count() == 0
    zero = spark.createDataFrame([("a", "x", 0, 0)], paths.schema)
    assert leaves(T.select_tree(zero, ("top", "low"), "p", "q", (1.0, 1.0))) == {("a", "x"): (0, 0)}


def test_rebase_tree(spark):
    paths = spark.createDataFrame(ROWS, "top string, low string, p long, q long")
    tree = T.select_tree(paths, ("top", "low"), "p", "q", (10.0, 40.0))
    bench = spark.createDataFrame([("a", "x", 7), ("a", "n", 2), ("m", "x", 4)], "top string, low string, n long")
    got = leaves(T.rebase_tree(tree, bench, ("top", "low"), "n"))
    assert got == {("a", "x"): (7,), ("a", T.REMAINING): (2,), ("b", "u"): (0,), ("b", None): (0,), (T.REMAINING, None): (4,)}
