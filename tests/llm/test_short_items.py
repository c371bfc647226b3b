from codeloom.llm import decontaminate as D


def test_short_items_are_found_with_all_their_substitutions(spark):
    items, docs = [], []
    for n in range(6, 10):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        most = n - -(-10 * n // 13)
        places = [(i,) for i in range(n)] if most == 1 else [(i, j) for j in range(n) for i in range(j)]
        for p in places:
            docs.append((len(docs), n, "before " * 4 + " ".join("other" if k in p else w for k, w in enumerate(words)) + " after" * 4))
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    got = D.overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, n) for i, n, _ in docs}
