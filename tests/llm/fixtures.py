"""Awkward documents that every operator must take."""

LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "a"),
    (2, "alpha beta gamma delta epsilon zeta", "b"),  # an equal text
    (3, None, "a"),
    (4, "", None),
    (5, "", "a"),
    (6, " \n\t ", "b"),
    (7, LONG, "a"),
    (7, LONG, "a"),  # a repeated row
    (None, "no identifier at all here", "b"),
    (None, None, None),
    (8, "alpha beta", "b"),  # one identifier, two texts
    (8, "gamma delta", "b"),
]


def awkward(spark):
    """These documents, with further columns whose names the operators use themselves."""
    d = spark.createDataFrame([(i, t, s, n, "x", None) for n, (i, t, s) in enumerate(ROWS)], "doc_id long, text string, source string, n long, keep string, rep string")
    for c in ("k", "d", "sha", "bytes", "words", "p", "part", "pos", "score", "__id", "__text", "__k", "h", "src", "grp", "id", "size", "start", "len", "rank"):
        d = d.selectExpr("*", f"'{c}' as `{c}`")
    return d


def empty(spark):
    return awkward(spark).limit(0)
