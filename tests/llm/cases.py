"""Documents that every operator must take: nulls, empty and long texts, repeats, ties, clashing columns."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " + PASSAGE, "en", "a", 1),
    (2, "one two three " + PASSAGE + " four five six seven", "en", "a", 2),
    (2, "one two three " + PASSAGE + " four five six seven", "en", "a", 2),  # repeats in full
    (3, "one two three " + PASSAGE + " four five six eight", "en", "b", 3),
    (3, "the same id with another text altogether, nothing else in common here at all", "en", "b", 3),
    (4, None, None, None, None),
    (5, "", "en", "c", 0),
    (6, " \t\n\r ", "en", None, 4),
    (None, "no id here but words enough to be a document of its own kind", "en", "a", 9),
    (7, LONG, "en", "b", 5),
    (8, "word " * 50, "en", "c", 6),
    (9, "über dir 😀 Straße naïve\u00a0space\u2003wide " * 4, "de", "ü", 7),
    (10, "short one", "en", "c", 8),
    (11, "short one", "en", "c", 8),
]
DDL = "doc_id long, text string, lang string, source string, n_words long"


def documents(spark, rows=ROWS, parts=3):
    return spark.createDataFrame(rows, DDL).repartition(parts)


def words(text):
    return (text or "").encode().split()
