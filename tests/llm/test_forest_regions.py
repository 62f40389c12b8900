from folioflow.llm.minhash_forest import regions_of


def test_a_rep_meets_its_root_in_one_row(spark):
    rows = spark.createDataFrame([(t, 7, rep) for rep in (1, 2, 3) for t in range(20) for _ in range(2)], "tree int, k1 long, rep long")
    found = regions_of(rows).collect()
    assert sorted((r.rep, len(r.regions)) for r in found) == [(1, 20), (2, 20), (3, 20)]
