import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `row` int, hash double"


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, passages, nulls, empty and long texts, ties and repeated rows; ids with nulls."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéfgh") for _ in range(r.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage, base = prose(60), prose(120)
    texts = [prose(r.randint(20, 150)) for _ in range(60)]
    texts += [base] * 5 + [base.upper()]
    for k in range(8):
        w = base.split()
        w[10 * k] = "changed"
        texts.append(" ".join(w))
    texts += [prose(20) + "\n" + passage + "\n" + prose(20) for _ in range(10)]
    texts += [None, None, "", "", " \n\t", "one", "one two three four", "ONE two three four", "a\x0bb\x0cc\rd\te", "é" * 60, "aaaa " * 40]
    texts += ["stupid idiot " + prose(30), "!!! ### " * 20, "same line\n" * 9, prose(12000)]
    out = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or ""), "x", k, 0.5) for k, t in enumerate(texts)]
    out += [(3, texts[3], "en", "s3", 1, "x", 1, 0.5)] * 3 + [(None, prose(40), "en", "s1", 1, "x", 1, 0.5), (None, base, "en", None, 1, "x", 1, 0.5)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    made = [(r[0], int(len((r[1] or "").split()) > 25), int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 2]
    return spark.createDataFrame(made + [(1, None, None), (2, 7, 7), (None, 1, 1), (5, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
