import datetime

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text[, lang]) rows."""
    def make(rows, extra=False):
        whole = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(whole, SCHEMA)
        if extra:  # columns named like those of the operators' results
            for name in ("n_words", "kept", "hits", "token_ids", "shard", "key", "anchor", "bits", "component", "place"):
                frame = frame.selectExpr("*", f"date'2020-01-01' AS {name}")
        return frame

    make.extra_value = datetime.date(2020, 1, 1)
    return make


@pytest.fixture(scope="session")
def texts():
    """Texts with words of a small vocabulary, copies and edits."""
    import random

    draw = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "éta", "theta", "x", "42", "kappa,", "mu."]
    out = [" ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 2, 3, 8, 20, 60, 150]))) for _ in range(60)]
    for text in out[:20]:
        parts = text.split(" ")
        parts[len(parts) // 2] = "changed"
        out += [text, " ".join(parts), text + "\n\tand more"]
    return out
