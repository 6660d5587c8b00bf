"""BM25 over classes of equal targets and queries."""

from graphloom.operators import matching


def test_equal_targets_share_a_score_and_the_least_ids_are_given(spark, monkeypatch):
    made = []
    checkpointed = matching.checkpointed
    monkeypatch.setattr(matching, "checkpointed", lambda df: made.append(checkpointed(df)) or made[-1])
    words = [["red", "nut"], ["red", "nut"], ["blue", "nut"], ["red", "red", "nut"]]
    targets = spark.createDataFrame([(k, "t", words[k % 4]) for k in range(40)] + [(90, "t", None), (91, "u", ["red"])], "id long, kind string, words array<string>")
    queries = spark.createDataFrame([(k, "t", ["nut", "red"] if k % 2 else ["red", "nut", "red"]) for k in range(10)] + [(77, "t", ["blue"])], "id long, kind string, words array<string>")
    found = {}
    for r in matching.bm25(queries, targets, 3, {"t": ("t",)}).collect():
        found.setdefault(r["query"], {})[r["rank"]] = (r["target"], r["score"])
    assert {q: [x[0] for _, x in sorted(f.items())] for q, f in found.items()} == {**{k: [3, 7, 11] for k in range(10)}, 77: [2, 6, 10]}
    assert len({tuple(sorted(f.items())) for q, f in found.items() if q < 10}) == 1
    sizes = {tuple(df.columns): df.count() for df in made}
    assert sizes["source", "terms", "asker"] == 2
    assert sizes["kind", "profile", "least", "members"] == 3
