"""Small tables with known metrics."""

N = None
ROWS = {
    "missing": ("item string, att1 string, att2 string", [(str(i + 1), a, b) for i, (a, b) in enumerate(zip(["a", "b", N, "a", "a", N, N, "b", "a", N, N, N], ["f", "d", "f", N, "f", "d", "d", N, "f", N, "f", "d"]))]),
    "full": ("item string, att1 string, att2 string", [("1", "a", "c"), ("2", "a", "c"), ("3", "a", "c"), ("4", "b", "d")]),
    "unique": (
        "`unique` string, nonUnique string, nonUniqueWithNulls string, uniqueWithNulls string, onlyUniqueWithOtherNonUnique string, halfUniqueCombinedWithNonUnique string",
        [("1", "0", "3", "1", "5", "0"), ("2", "0", "3", "2", "6", "0"), ("3", "0", "3", N, "7", "0"), ("4", "5", N, "3", "0", "4"), ("5", "6", N, "4", "0", "5"), ("6", "7", N, "5", "0", "6")],
    ),
    "uninformative": ("att1 int, att2 int", [(1, 0), (2, 0), (3, 0)]),
    "distinct": ("att1 string, att2 string", [("a", N), ("a", N), (N, "x"), ("b", "x"), ("b", "x"), ("c", "y")]),
    "numeric": ("item string, att1 int, att2 int, att3 int", [("1", 1, 0, 0), ("2", 2, 0, 0), ("3", 3, 0, 0), ("4", 4, 5, 4), ("5", 5, 6, 6), ("6", 6, 7, 7)]),
    "lengths": ("att1 string", [("",), ("a",), ("bb",), ("ccc",), ("dddd",)]),
    "positive": ("att1 int, att2 int", [(i, 2 * i) for i in range(1, 7)]),
    "negative": ("att1 int, att2 int", [(i, 14 - 2 * i) for i in range(1, 7)]),
    "low": ("att1 int, att2 int", [(12, 8), (10, 12), (8, 1), (6, 30), (4, 9), (2, 7)]),
}


def frame(spark, name):
    schema, rows = ROWS[name]
    return spark.createDataFrame(rows, schema)
