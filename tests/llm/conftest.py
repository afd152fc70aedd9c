import pytest

#: Columns that operators use by these names inside or return; as inputs they must not disturb anything.
CLASHING = ("words", "text_key", "node", "bucket", "n_words", "kept", "host", "shard", "hash", "spans", "ids", "score", "place", "root", "_gone_id")
WORDS = ("the river was calm and the old boat moved slowly along its green bank while a grey bird looked for fish under the "
         "low wooden bridge near our house where children used to play after school every long summer day").split()


def sentence(start: int, n: int) -> str:
    return " ".join(WORDS[(start * 7 + i * (1 + start % 5)) % len(WORDS)] + ("" if i % 3 else str((start * 31 + i) % 97)) for i in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """make([(doc_id, text), ...]): a documents table with extra columns."""
    def build(rows, lang="en", source="s"):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
        filled = [(i, t, lang, source if not isinstance(source, dict) else source.get(i), len(t or "")) + ("x",) * len(CLASHING) for i, t in rows]
        return spark.createDataFrame(filled, schema)
    return build


@pytest.fixture(scope="session")
def odd():
    """Null ids and texts, empty and blank texts, repeated rows, one very long text, and texts without a letter."""
    long = " ".join(sentence(i, 40) for i in range(600))
    return [(1, None), (2, ""), (3, " \n\t "), (4, sentence(1, 30)), (4, sentence(1, 30)), (None, sentence(2, 30)), (None, None), (7, long), (8, "12 34 !!"),
            (9, sentence(1, 30)), (10, "one")]
