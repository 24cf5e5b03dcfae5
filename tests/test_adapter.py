from quillgraph.operators import adapter


def test_slots_without_a_sentence_are_not_judged(spark):
    rows = [(0, "said", None), (1, "", None), (2, None, None), (3, "said", "api_error")]
    p = spark.createDataFrame([(k, "prompt", 9, s, e) for k, s, e in rows], "context_index int, prompt string, budget int, said string, broken string")
    got = {r.context_index: (r.error, r.attempts, r.intent is None) for r in adapter.judged(p, sentence="said", failed="broken").collect()}
    assert got == {0: (None, 1, False), 1: ("missing_filled_sentence", 0, True), 2: ("missing_filled_sentence", 0, True), 3: ("no_script03_response", 0, True)}
