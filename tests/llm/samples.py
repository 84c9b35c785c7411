"""Small documents with what can go wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, n_lines string, finger int, position double, `block` string"
WORDS = "the of and in to is was for on with he that by at from as are this be an or".split()


def text(seed: int, n: int = 60, lines: int = 4) -> str:
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n // lines)) for _ in range(lines))


def rows(n: int = 40):
    out = []
    for i in range(n):
        t = text(i % 30)  # ten exact copies
        if i % 7 == 0:
            t += "\nA Shared Line of Some Length \t"
        if i % 11 == 0:
            t = t.replace(" ", "  ", 1) + " changed"
        out.append((i, t, "en" if i % 2 else "de", f"s{i % 4}"))
    out += [
        (100, None, "en", "s0"), (101, "", "en", None), (102, " \n\t ", None, "s1"), (103, "one", "en", "s1"), (104, "one", "en", "s1"), (104, "one", "en", "s1"), (None, text(3), "en", "s2"), (None, None, None, None),
        (105, "long " * 30_000 + "end", "en", "s3"), (106, text(1), "fr", "s3"), (106, text(2), "fr", "s3"), (107, "É é \U0001f600 日本 ", "xx", "s3"), (108, "x" * 50_000, "en", "s0"),
    ]
    return [(*r, len(r[1] or ""), 7, "x", None, 0.5, "b") for r in out]


def docs(spark, n: int = 40):
    return spark.createDataFrame(rows(n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s: str) -> str:
    return s.translate({65 + i: 97 + i for i in range(26)})
