from tessera.llm import toxicity


def test_thresholds_take_the_true_share_of_toxic_rows(spark, documents, monkeypatch):
    """A word that more clean than toxic documents hold is no reason to drop, however small the sample for fitting is."""
    monkeypatch.setattr(toxicity, "POSITIVES", 40)
    monkeypatch.setattr(toxicity, "NEGATIVES", 40)
    rows, labels = [], []
    for i in range(1500):
        odd = i % 10 == 0
        rows.append((i, f"plain words number n{i % 7} here" + " dubious" * odd))
        labels.append((i, int(odd and i % 50 in (0, 10))))
    docs, marks = documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, marks, seen="true").collect()}
    assert len(got) == 1500 and sum(got[i] for i, t in labels if not t) == 0


def test_nulls_repeats_and_missing_labels(spark, documents):
    docs = documents([(1, "a b"), (1, "a b"), (None, None)], raw_score="x")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.classify(docs, none).collect()] == [0, 0, 0]
    some = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.clean(docs, some).columns == docs.columns and toxicity.clean(docs, some).count() == 3
