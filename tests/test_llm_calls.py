"""The language model as a partitioned source."""

from lodestone.operators import assistant
from lodestone.sources.llm_port import called


def make_flaky():
    seen = {}

    def ask(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt.startswith("never"):
            raise OSError("down")
        return None if prompt.startswith("second") and seen[prompt] < 2 else f"said {prompt}"

    return ask


def test_calls_are_made_once_again_and_end_as_rows(spark):
    prompts = ["a", "b", "a", "second x", "never y", None, ""] + [f"p{i}" for i in range(30)]
    got = {r.prompt: (r.response, r.attempts) for r in called(spark.createDataFrame([(p,) for p in prompts], "prompt string").repartition(3), make_flaky, 2, 3).collect()}
    assert len(got) == 35 and got["a"] == ("said a", 1) and got["second x"] == ("said second x", 2) and got["never y"] == (None, 3) and got[""] == ("said ", 1)
    assert called(spark.createDataFrame([], "prompt string"), make_flaky).count() == 0


def make_intents():
    return lambda prompt: "Support!" if prompt.endswith("help") else None


def test_queries_are_classified_by_their_distinct_texts(spark):
    rows = [(1, " Help "), (2, "help"), (3, "other"), (4, "  "), (5, None)]
    got = {r.i: r.intent for r in assistant.classified(spark.createDataFrame(rows, "i int, query string"), make_intents).collect()}
    assert got == {1: "support", 2: "support", 3: "informational", 4: "", 5: ""}
