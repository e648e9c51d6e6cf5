"""Training documents are told apart by id, and used with all their passages."""

from fleetfootprint.llm import quality


def test_repeated_ids_take_one_place(spark, monkeypatch):
    rows = [(i, f"word{i} " * (i + 1)) for i in range(8) for _ in range(30)] + [(8, "long text of many words " * 2000), (9, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10) for _ in range(2)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, own: seen.append((bags, own)))
    quality.fit(docs, labels, train_rows=7)
    quality.fit(docs, labels)
    assert len(seen[0][0]) == 7 and len({b.tobytes() for b in seen[0][0]}) == 7
    assert len(seen[1][0]) == 10 and sorted(seen[1][1]) == [0] * 5 + [1] * 5
    assert max(len(b) for b in seen[1][0]) == 100
