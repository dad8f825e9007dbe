import random

import pytest

#: Names that operators use inside.
CLASHING = ("th", "id", "fp", "lw_keep", "lw_id", "word", "n", "key", "uid", "part", "shard", "number", "host", "rule", "sh_id", "a", "b")


def prose(rng, words):
    return " ".join(rng.choice(("ab", "cde", "fghi", "k", "lmno", "pqrst", "uv")) + rng.choice(("a", "e", "io", "un", "")) + str(rng.randint(0, 9)) for _ in range(words))


def hard_texts():
    """Null, empty, blank, tied, repeated and very long texts among ordinary ones."""
    rng = random.Random(5)
    lines = [prose(rng, 9) for _ in range(12)]
    base = [prose(rng, 120) for _ in range(12)]
    texts = [None, "", " \n\t", "x", base[0], base[0], base[1].replace(" ", "\n", 6), base[1].replace(" ", "\n", 6)]
    texts += base[2:]
    texts += [base[2] + " end", base[3].upper(), "\n".join(lines), "\n".join(lines[2:9]), "\n".join(["same"] * 7), "\n" * 6]
    texts += ["\n".join([prose(rng, 3), *lines[4:8], prose(rng, 3)]), prose(rng, 30_000), "é ß 日本   x'y!! <|endoftext|>"]
    return texts


@pytest.fixture(scope="session")
def hard(spark):
    """``documents`` with the hard texts, a null id, a repeated row, and columns with names that operators use."""
    rows = [(i, t) for i, t in enumerate(hard_texts())]
    rows += [(None, "no id here"), rows[4], (7, "another text of id seven")]
    full = [(i, t, "en", "src", len(t or "")) + tuple("x" for _ in CLASHING) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
