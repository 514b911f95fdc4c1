import corpus_pipeline as cp
from gridloom.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        after = cp.written(stage(spark, docs, SF))
        assert after.columns == columns, name
        n = after.count()
        assert n == before if name in ("line_dedup", "pii_pseudonyms") else 0 < n < before, name
        if name == "pii_pseudonyms":
            assert after.filter("text like '%@mail%'").join(docs.withColumnRenamed("text", "t"), "doc_id").filter("text = t").count() == 0
        docs, before = after, n
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_one_of_each_group_stays(spark):
    rows = [(i, f"word{i // 3} " * 30 + f"tail{i // 3}", "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_dedup_stage(spark, docs, SF).collect()) == list(range(0, 30, 3))


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
