"""The pipeline against its stages worked out one by one."""

import corpus_pipeline
from pyspark.sql import functions as F
from cabinlift.llm import decontaminate, line_dedup, ngram_join, quality
from cabinlift.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.support import documents


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    ids = lambda df, name="doc_id": {r[name] for r in df.collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SMALL)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        seen.append(spark.read.parquet(path))
    good = quality.quality_report(docs, labels).filter("predicted = 1")
    assert ids(seen[1]) == ids(good)
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(seen[1]).collect()}
    texts = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert texts == {i: r["text"] for i, r in lines.items() if r["n_dropped"] == 0 or r["text"].split()}
    assert ids(seen[3]) == ids(ngram_join.jaccard_components(seen[2]), "component_id")
    assert ids(seen[4]) == ids(decontaminate.contamination_report(seen[3], bench).filter("not contaminated"))
    last = corpus_pipeline.STAGES[-1][1](spark, seen[4], SMALL)
    assert ids(last) == ids(seen[4]) == ids(corpus_pipeline.run(spark, SMALL))


def test_rows_are_decided_one_by_one(spark):
    words = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(words[:60]), " ".join(words[60:120]), " ".join(words[120:])
    docs = documents(spark, [a, a, a, b, c, c, b + " x", ""], [5, 5, None, 5, None, None, 7, 8])
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(5, a), (5, b), (0, c), (8, "")])


def test_copies_from_four_fifths_on_are_near(spark):
    words = [f"w{i}" for i in range(204)]
    texts = [" ".join(words[:200]), " ".join([*words[:90], *(f"x{i}" for i in range(17)), *words[107:200]])]
    assert [r["component_id"] for r in ngram_join.jaccard_components(documents(spark, texts)).orderBy("doc_id").collect()] == [0, 1]
    rows = corpus_pipeline.ngram_jaccard_join(spark, documents(spark, texts), SMALL).collect()
    assert [r["doc_id"] for r in rows] == [0]


def test_contaminated_rows_go_whatever_their_id(spark):
    bench = next(r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 15)
    docs = documents(spark, [bench, "clean words here", bench, "clean too"], [1, 1, None, None])
    got = corpus_pipeline.benchmark_decontamination(spark, docs, SMALL)
    assert sorted(r["text"] for r in got.collect()) == ["clean too", "clean words here"]


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


CLASHES = ("n_lines", "n_dropped", "row_", "row", "doc", "body_", "drops", "of_", "in_", "first", "component_id", "digest", "n", "line")


def test_columns_with_clashing_names_come_through(spark):
    line = "this line is long enough to be taken for a repeated one"
    docs = documents(spark, [f"{line}\nown words of one {i} here\n{'filler ' * 30}" for i in range(4)] + [None, ""]).drop("digest", "line", "n")
    docs = docs.select("*", *[F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in CLASHES])
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        for row in out.collect():
            assert [row[c] for c in CLASHES] == [f"{c}{row['doc_id']}" for c in CLASHES], name


def test_rows_without_an_id_lose_their_repeated_lines(spark):
    line = "this line is long enough to be taken for a repeated one"
    docs = documents(spark, [f"{line}\na", f"{line}\nb", f"{line}\nc", line], [None, 3, None, None])
    got = sorted(r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, SMALL).collect())
    assert got == ["a", "c", f"{line}\nb"]


def test_nothing_in_nothing_out(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0 if name == "documents" else 10**9).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
