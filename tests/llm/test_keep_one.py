"""The near-duplicate stage links what SimHash links, beside similar sets of shingles."""

from sparrowgrid.llm import simhash


def test_texts_with_near_fingerprints_are_linked(spark):
    often = "ab cd ef gh ij " * 200  # five shingles many times: they decide the fingerprint, and are few of the set
    rows = [(1, often + " ".join(f"k{i}" for i in range(12))), (2, often + " ".join(f"m{i}" for i in range(12))), (3, "a text of its own with other words"), (4, None), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_print = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert by_print == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 4]
