import json

from sievelake.operators.evaluate import averages
from sievelake.sources.reports import read_descriptions, read_reports, read_texts, report_classes, to_result_json
from sievelake.streaming.live import detect_stream, live_findings, live_redaction, windowed_counts


def test_reports(spark, tmp_path):
    about = {"precision": 0.5, "recall": 1.0, "f1": 0.66, "per_class": {"A": {"precision": 0.5, "recall": 1.0, "f1-score": 0.66, "support": 3}, "B": {"precision": 0.0, "recall": 0.0, "f1-score": 0.0, "support": 0}, "micro avg": {"precision": 0.5, "recall": 1.0, "f1-score": 0.66, "support": 3}}}
    (tmp_path / "a.json").write_text(json.dumps(about, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    reports = read_reports(spark, [str(tmp_path), str(tmp_path / "missing"), str(tmp_path / "no*.json")])
    assert read_reports(spark, [str(tmp_path / "missing")]).count() == 0 and read_reports(spark, []).columns == reports.columns
    assert reports.count() == 2 and reports.where("precision IS NULL").count() == 1
    classes = report_classes(reports)
    assert {r.entity_group for r in classes.collect()} == {"A", "B"}
    got = {r.average: r for r in averages(classes).collect()}
    assert got["macro avg"].precision == 0.25 and got["weighted avg"].recall == 1.0 and got["micro avg"].precision == 0.5
    assert averages(classes.where("false")).count() == 3


def test_texts_and_json(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    texts = read_texts(spark, str(tmp_path), "text")
    assert texts.count() == 2
    assert json.loads(to_result_json(texts.select("text")).first().value)["text"] in ("one", "two")


def test_descriptions(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Title\n\n1. NAME\n   - First name.\n   - Examples: 3. or 4\n\n2. CITY\n   - A city.\n")
    got = sorted(map(tuple, read_descriptions(spark, str(tmp_path / "d.txt")).collect()))
    assert got == [(1, "NAME", "First name.\nExamples: 3. or 4"), (2, "CITY", "A city.")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "mail a@b.cc", 0), (2, "none", 0)], "doc_id long, text string, n int").selectExpr("doc_id", "text", "timestamp '2024-01-01 00:00:00' AS ts").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(str(src))
    got = []
    query = detect_stream(stream.select("doc_id", "text"), lambda df, i: got.extend(df.collect()))
    query.awaitTermination(120)
    assert {(r.doc_id, r.word) for r in got if r.entity_group == "EMAIL"} == {(1, "a@b.cc")}
    out = live_findings(stream.select("doc_id", "text"))
    query = out.writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.doc_id, r.word) for r in spark.table("live").where("entity_group = 'EMAIL'").collect()} == {(1, "a@b.cc")}
    query = live_redaction(stream.select("doc_id", "text"), replacement="#").writeStream.format("memory").queryName("redacted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("redacted").where("doc_id = 1").first().redacted.endswith("#")
    assert windowed_counts(spark.read.parquet(str(src)), "@").first().n == 1
