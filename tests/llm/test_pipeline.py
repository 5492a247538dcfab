from tideglass.llm import common


def test_stages_over_the_smallest_tables(spark, sf):
    import corpus_pipeline as cp

    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] > 0.8 * counts[3]
    pieces = cp.STAGES[-1][1](spark, docs, sf)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"] and cp.ORACLE_SQL is None


def test_stages_on_odd_and_empty_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows, further columns with clashing names; and no rows at all."""
    import corpus_pipeline as cp
    import odd
    from pyspark.sql import functions as F

    for docs in (odd.odd_documents(spark).withColumn("toxic_score", F.lit("mine")).withColumn("rate", F.lit(2)).withColumn("at", F.lit("x")), odd.empty_documents(spark)):
        columns, rows = docs.columns, docs.count()
        for name, stage in cp.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, sf), name)
            assert docs.columns == columns and docs.count() <= rows, name
            assert rows == 0 or docs.count() > 0, name
        assert (cp.STAGES[-1][1](spark, docs, sf).count() > 0) == (rows > 0)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
