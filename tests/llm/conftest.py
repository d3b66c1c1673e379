import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Intermediate tables of the session go where the test session says, if nothing else does."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def documents(spark):
    """A small table with missing, empty, repeated and long texts, and columns named like results."""

    def make(texts, **columns):
        extra = {"lang": "en", "kept": "x", "spans": 1, "n_words": -1, "row": 5} | columns
        rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
        kinds = {str: "string", int: "long"}
        schema = "doc_id long, text string, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in extra.items())
        return spark.createDataFrame(rows, schema)

    return make


AWKWARD = [None, "", " \n\t ", "word", "same text here again and again", "same text here again and again", "é" * 3000 + " " + "long word " * 4000]


@pytest.fixture
def awkward():
    return list(AWKWARD)
