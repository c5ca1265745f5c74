"""Tables that hold nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, fp long, size long, component_id long, stays long, shards long, row long"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, "clash", None, 1, 2, 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"w{i % 701}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (6, LONG + " x"), (None, "a b c d e f"), (7, "é ß ñ x\x1cy A.B"), (8, "a  b\n\n c <|endoftext|> d ")]
