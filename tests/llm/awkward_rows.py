"""Rows that every operator must take."""

#: Cases that every operator takes: nulls, empty and blank texts, ties, repeated rows, a long text.
AWKWARD = [
    (1, "One two three four five six seven eight nine ten eleven twelve."),
    (2, "One two three four five six seven eight nine ten eleven twelve."),
    (3, None),
    (4, ""),
    (5, " \n\t \n"),
    (6, "word"),
    (None, "A row without an id but with words of its own."),
    (7, "twice"),
    (7, "twice"),
    (8, "αβγ δεζ “quoted” 日本語 🎉\nsecond line with a few more words\nthird"),
    (9, "long " * 5000),
]
