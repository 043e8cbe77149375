"""Small tables with what every operator must cope with."""

LONG = ("lorem ipsum dolor sit amet " * 4000).strip()


def documents(spark, rows=None, extra=True):
    """(doc_id, text, ...): nulls, empty and very long texts, ties, repeated rows, and columns
    whose names operators use inside."""
    base = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta\nA line that three documents share.\nx"),
        (2, "alpha BETA gamma delta epsilon zeta eta theta\n  a LINE that three documents share. \ny"),
        (3, "A line that three documents share.\nA line that three documents share.\n\nshort"),
        (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE\ttwo"), (9, LONG), (10, LONG + " end"),
        (11, "İstanbul ΣΑΣ naïve x <|endoftext|> it's 123 漢字 🎉\x1c!"),
        (11, "İstanbul ΣΑΣ naïve x <|endoftext|> it's 123 漢字 🎉\x1c!"),
        (None, "no id here\nA line that three documents share."), (None, None),
    ] if rows is None else rows
    df = spark.createDataFrame(base, "doc_id bigint, text string")
    if not extra:
        return df
    for c in ("doc", "n", "node", "ids", "score", "key", "label", "uid", "h", "drops", "id", "batch"):
        df = df.selectExpr("*", f"'other' AS {c}")
    return df


def empty(spark, schema="doc_id bigint, text string"):
    return spark.createDataFrame([], schema)


def pairs(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)
