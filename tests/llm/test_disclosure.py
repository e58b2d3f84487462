"""Terms that disclose an entity, wherever they stand."""

from weftgraph.llm import pii


def test_terms_are_told_by_document_and_marked_everywhere(spark):
    common = "these common words stand in every text of the corpus "
    far = [f"zanzibar {i} {common * 4}and the last of it: ann@x.org" for i in range(4)]  # over 64 code points apart
    other = [f"{common}of 😀 Zanzibar alone, zanzibar", f"{common}nothing"]
    filler = [f"{common}number {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(far + other + filler)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.spans(df).collect()}
    told = lambda i: [(far + other + filler)[i][t["start"] : t["end"]] for t in found[i]["terms"]]
    assert all("zanzibar" in told(i) for i in range(4))
    assert told(4) == ["Zanzibar", "zanzibar"] and not any(told(i) for i in range(5, 66))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert not any("zanzibar" in t.lower() for t in clean.values()) and clean[5] == other[1]


def test_terms_inside_an_entity_are_its_own(spark):
    texts = [f"holder {i} of lee@mail.org" for i in range(5)] + [f"nothing {i}" for i in range(60)]
    found = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("doc_id < 5").collect()
    assert all([texts[r["doc_id"]][t["start"] : t["end"]] for t in r["terms"]] == ["holder"] for r in found)
