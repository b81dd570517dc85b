"""Providers in batches, failed batches as rows, and the steps of an answer."""

from lodestrata.operators import ask
from lodestrata.operators.retrieval import INSUFFICIENT

EVIDENCE = "query_id int, rank int, chunk_id string, path string, first int, last int, lang string, entity string, sha string, text string"



def providers():
    """Made here, as workers don't import the tests."""
    most = ask.BATCH

    class Lengths:
        def embed(self, texts):
            assert len(texts) <= most
            if any("bad" in (t or "") for t in texts):
                raise ValueError("a bad text")
            return [[float(len(t or "")), 1.0] for t in texts]

    class Parrot:
        def generate(self, prompts):
            if any("broken" in p for p in prompts):
                raise RuntimeError("no answer")
            return ["See [E1] and [E9]  twice [E1]." if "thing" in p else "" for p in prompts]

    def missing():
        raise OSError("no such model")

    return Lengths, Parrot, missing


def test_a_failed_batch_is_a_status_and_no_failed_job(spark):
    lengths, _, missing = providers()
    ask.register_embedder("lengths", lengths)
    ask.register_embedder("missing", missing)
    chunks = [("r1", f"c{k}", "x" * k) for k in range(70)] + [("r2", "d", "bad")]
    rows = spark.createDataFrame(chunks, "run_id string, chunk_id string, chunk_text string").repartition("run_id")
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id string")
    one = ask.embed(rows.filter("run_id = 'r1'"), "lengths").unionByName(ask.embed(rows.filter("run_id = 'r2'"), "lengths"))
    got = {r["run_id"]: tuple(r)[1:] for r in ask.stage_status(one, runs).collect()}
    assert got == {"r1": ("completed", 70, None), "r2": ("failed", 0, "ValueError: a bad text"), "r3": ("completed", 0, None)}
    assert {(r["chunk_id"], tuple(r["vector"])) for r in one.collect() if r["vector"]} == {(f"c{k}", (float(k), 1.0)) for k in range(70)}
    assert {r["error"] for r in ask.embed(rows, "missing").collect()} == {"OSError: no such model"}


def test_the_steps_of_an_answer(spark):
    ask.register_model("parrot", providers()[1])
    questions = spark.createDataFrame([(1, "r", "  known thing\nmore "), (2, "r", " \n"), (3, "x", "known"), (4, "r", "known"), (5, "r", None), (6, "r", "other")], "query_id int, run_id string, question string")
    runs = spark.createDataFrame([("r",)], "run_id string")
    evidence = spark.createDataFrame([(q, k, f"c{q}{k}", "f.py", 1, 2, None, None, None, "text") for q in (1, 2, 3, 6) for k in (2, 1)], EVIDENCE)
    got = {r["query_id"]: tuple(r)[1:] for r in ask.ask(questions, runs, evidence).collect()}
    assert got[1] == ("Based on the repository evidence, known thing is implemented as shown in the source code [E1][E2].", ["c11", "c12"], 2, None)
    assert got[2] == got[5] == got[4] == (INSUFFICIENT, [], 0, None) and got[3] == ("Analysis run 'x' not found.", [], 0, None)
    got = {r["query_id"]: tuple(r)[1:] for r in ask.ask(questions, runs, evidence, "parrot").collect()}
    assert got[1] == ("See [E1] and twice [E1].", ["c11"], 2, None) and got[6] == (INSUFFICIENT, [], 2, None) and got[2][0] == INSUFFICIENT
    broken = spark.createDataFrame([(1, "r", "broken known")], questions.schema)
    assert [tuple(r)[1:] for r in ask.ask(broken, runs, evidence, "parrot").collect()] == [(None, [], 2, "RuntimeError: no answer")]
