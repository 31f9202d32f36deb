import os
import random

import pytest


@pytest.fixture(scope="session")
def paths():
    import public_tokenizers as p

    return {"json": p.path("byte_bpe_50k.json"), "ranks": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}


@pytest.fixture(scope="session")
def tokenizer(paths):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(paths["json"])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and ids: (doc_id, text, lang, source)."""
    rnd = random.Random(4)
    words = ["the", "and", "of", "l'eau", "über", "naïve", "don't", "we'll", "x1", "42", "!!", "<|endoftext|>", "漢字", "🙂"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "\n\n", "  ", "\t"]), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", None])) for k in range(60)]
    rows += [(60, None, "en", "a"), (61, "", None, None), (None, "a text without an id", "en", "b"), (7, "an id again", "fr", "a")]
    rows += [rows[3], rows[3], (62, "long and wide " * 8000, "en", "a"), (63, " \n\t ", "en", "a")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def odd(spark, odd_rows):
    """The odd rows, with columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("n", "block", "queue", "node", "pos", "h", "site", "tokens")})
