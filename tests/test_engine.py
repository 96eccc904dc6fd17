import re

import pytest
from parity import CASES, COVERAGE
from pyspark.sql import functions as F

from sievelake.functions.catalog import CATEGORIES, FORMS, catalog, detectors, labelled, load_forms
from sievelake.operators import evaluate as ev
from sievelake.operators import summarize as sm
from sievelake.operators.detect import Options, detect, detect_arrow, detect_columns, spread
from sievelake.operators.merge import merge
from sievelake.operators.redact import redact, redact_texts
from sievelake.operators.tagger import first_that_loads, join_tokens, normalise, run_tagger
from sievelake.operators.validate import drop_invalid, validate
from sievelake.plans.engine import Engine

TEXTS = [
    (1, "Some random data: 1234 - 5678 - and 9012"),
    (2, "Customer: Arun Sharma, DOB: 15/08/1990, Aadhaar: 1234 5678 9012, Driver License: MH-14-2011-0062821"),
    (3, "Name: Priya Mehta, Phone: 9876543210, Random: 1234, Invalid: 5678"),
    (4, ""),
    (5, None),
    (6, "😀 mail a.b@c.de. And x@y.zz"),
]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, DOCS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_example_has_the_form_of_its_category(spark):
    for c, form, examples in CATEGORIES:
        for e in examples:
            assert re.match(form, e), (c, e)
    assert catalog(spark).count() == 22


def test_load_forms_marks_broken_ones(spark):
    assert load_forms('{"A": {"regex": "^(?P<q>ab)$"}, "B": 3, "C": {"regex": 1}, "D": {"regex": "^(?<q>ab)$"}}') == {"A": None, "B": None, "C": None, "D": "^(?<q>ab)$"}  # Java matches them
    assert load_forms('{"A": {"regex": "^a$"}, "B": {"regex": "("}, "C": {}}') == {"A": "^a$", "B": None, "C": None}
    assert load_forms("no json") == {} and load_forms("[1]") == {}
    assert [p.regex for p in detectors(forms={"NEW": "^n$", "OLD": None})] == ["(?i)^n$"]


def test_as_written_finds_only_the_patterns_without_doubled_backslashes(docs):
    found = detect(docs, Options(profile="as_written", variant="strict"))
    regex = {r[0] for r in found.where("method = 'regex_enhanced'").select("entity_group").distinct().collect()}
    assert regex == {"GIVENNAME", "SURNAME", "FULLNAME"}
    s = {r.doc_id: r for r in sm.summary_by_document(docs, validate(found)).collect()}
    assert (s[1].total_entities, s[1].filtered_entities, s[1].avg_confidence) == (2, 7, pytest.approx(0.95))
    assert (s[2].total_entities, s[2].filtered_entities) == (14, 2)
    assert (s[3].total_entities, s[3].filtered_entities, s[3].avg_confidence) == (14, 0, pytest.approx(13.25 / 14))
    assert s[3].methods_used == ["contextual", "regex"] and s[3].validation_rate == 1.0
    assert (s[4].total_entities, s[5].total_entities, s[4].validation_rate, s[5].avg_confidence, s[4].categories_found) == (0, 0, 0.0, 0.0, [])


@pytest.mark.parametrize("variant", ["library", "service", "strict"])
@pytest.mark.parametrize("profile", ["intended", "as_written"])
def test_both_engines_agree(spark, docs, variant, profile):
    options = Options(variant=variant, profile=profile, use_names=True)
    both = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t, _ in COVERAGE], DOCS))
    assert rows(detect(both, options)) == rows(detect_arrow(both, options))


def test_long_texts_and_marks(spark, monkeypatch):
    from sievelake.functions import spans

    long = "Anna Bell and Carl Dorn met at 10:30, mail a@b.cc. " * 400
    some = [(1, long), (2, "\uffffAnna\ufffe Bell\uffff a@b.cc"), (3, "A1 Anna_Bell Anna Bell1 x"), (4, "word " * 30_000), (None, "Anna Bell"), (None, "a@b.cc Anna Bell"), (1, "x Anna Bell")]
    docs = spark.createDataFrame(some, DOCS)
    options = Options(use_names=True, categories=("FULLNAME", "EMAIL", "TIME", "CITY"))
    want = rows(detect_arrow(docs, options))
    for size in (128, 2):
        if size == 2:
            some = some[1:3] + some[4:] + [(1, long[:600])]
            docs = spark.createDataFrame(some, DOCS)
            want = rows(detect_arrow(docs, options))
        monkeypatch.setattr(spans, "SLICE", size)
        got = rows(detect(docs, options))
        assert [x for x in got if "\uffff" not in x[3] and "\ufffe" not in x[3]] == [x for x in want if "\uffff" not in x[3] and "\ufffe" not in x[3]] and len(got) == len(want) > 20


def test_nothing_is_shuffled(docs):
    for df in (detect(docs, Options()), validate(detect(docs, Options())), redact_texts(docs, Options())):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_pattern_runs_once_a_text(docs):
    options = Options(categories=("EMAIL",), use_contextual=False)
    counted = validate(detect(docs, options)).groupBy("entity_group").count()
    for df in (counted, redact_texts(docs, options)):
        assert df._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1


def test_every_pattern_that_is_rewritten_finds_the_same(spark):
    """Random texts of the signs that repetitions and boundaries turn on, against the patterns as they are."""
    import random

    rng = random.Random(6)
    parts = ["Ab", "abc", "X", "a1", " ", "  ", "\n", "_", ".", "é", "Name", "name:", "CITY", " : ", "card number", "pan  number", "M", "Female", "12", "123456", "9876543210", "Road", "Park", "a@b.c-d", "-"]
    docs = spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))) for i in range(400)], DOCS)
    for variant in ("library", "service", "strict"):
        options = Options(variant=variant, use_names=True)
        assert rows(detect(docs, options)) == [x for x in rows(detect_arrow(docs, options))]


PARTS = ["Ab", "abc", "X", "a1", " ", "  ", "\n", "\r", "\t", "_", ".", "Name", "name:", "CITY", " : ", "card number", "pan  number", "M", "Female", "12", "123456", "9876543210", "+91-", "1234 5678 9012", " 3456"]
PARTS += ["ABCPD1234K", "HDFC0001234", "MH-14-2011-0062821", "K1234567", "15/08/2024", "14:30", "f47ac10b-58cc-4372-a567-0e02b2c3d479", "Road", "Park", "a@b.c-d", "-", "\\", "\\d", "\\s", "aged", "address: "]


@pytest.mark.parametrize("variant", ["library", "service", "strict"])
def test_whole_columns_hold_the_same_findings(spark, monkeypatch, variant):
    """Random texts, half of them with signs that the engines take differently; null and repeated ids; parts and batches of a few texts and words."""
    import random

    from sievelake.functions import columns

    monkeypatch.setattr(columns, "PART", 300)
    monkeypatch.setattr(columns, "WORDS", 200)
    rng = random.Random(8)
    odd = ["é", "\x0b", "\x00", "\x01", "\x1c", "\u212a", "\u017f", "\u0301", "\xa0", "\uffff"]
    some = [(i % 150, "".join(rng.choice(PARTS + odd * (i % 2)) for _ in range(rng.randrange(30))), f"k{i}") for i in range(200)]
    some += [(None, None, "n"), (None, "", None), (None, "Anna Bell", None), (None, "Anna é Bell", "é"), (7, "Anna Bell 12 " * 100, "long")]
    docs = spark.createDataFrame(some, "doc_id long, text string, `a.b` string").withColumnRenamed("a.b", "kept")
    for profile in ("intended", "as_written"):
        options = Options(variant=variant, profile=profile, use_names=True)
        want, got = detect(docs, options, keep=("kept",)), detect_columns(docs, options, ("kept",))
        assert got.dtypes == want.dtypes and rows(got) == rows(want)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_whole_columns_without_texts_or_patterns(spark, docs):
    assert detect_columns(docs.where("doc_id > 3 AND doc_id < 6")).count() == detect_columns(docs.where("false")).count() == 0
    assert detect_columns(docs, Options(categories=())).count() == 0


def test_other_patterns_are_not_looked_for_in_whole_columns():
    from sievelake.functions.columns import of_catalog
    from sievelake.operators.detect import patterns

    assert of_catalog(patterns(Options(use_names=True))) and not of_catalog(detectors(forms={"NEW": "^n$"}))


def test_spread_by_bytes(spark, tmp_path):
    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert spread(table, size // 20).rdd.getNumPartitions() in (20, 21) and spread(table, 10 * size).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_a_rollup_makes_no_rows_of_findings(spark):
    """Rows are made for subtotals of counts; categories and groups that are null stay apart from subtotals."""
    judged = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", None), (None, "X")], "by string, entity_group string")
    rolled = sm.corpus_rollup(judged, "by")
    assert rows(rolled) == sorted([("a", "X", 2), ("a", None, 1), (None, "X", 1), ("a", None, 3), (None, None, 1), (None, None, 4)], key=str)
    plan = rolled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Expand")


def test_spans_are_code_points(docs):
    found = detect(docs, Options()).join(docs, "doc_id")
    assert found.where(F.expr("substring(text, start + 1, end - start)") != F.col("word")).isEmpty()
    mails = detect(docs, Options(categories=("EMAIL",))).where("doc_id = 6").collect()
    assert [(m.word, m.start) for m in mails] == [("a.b@c.de.", 7), ("x@y.zz", 21)]


def test_expected_categories_are_found(spark):
    texts = spark.createDataFrame([(i, t, e.split(",")) for i, t, e in COVERAGE], "doc_id long, text string, expected array<string>")
    assert texts.count() == sm.coverage(texts.select("doc_id", "expected"), detect(texts)).where("passed").count()


def cases(spark):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "doc_id long, entity_group string, word string, score double")


def test_strict_and_cross_validation(spark):
    strict = {(r.doc_id): r for r in validate(cases(spark)).collect()}
    cross = {(r.doc_id): r for r in validate(cases(spark), cross=True).collect()}
    at = {(c, w): i for i, (c, w, _) in enumerate(CASES)}
    assert [strict[at[x]].validation.valid for x in (("DATE", "1234 - 5678 -"), ("AADHAAR", "9012"), ("CITY", "Mobile"), ("IBAN", "x"))] == [False, False, True, False]
    want = {("AADHAAR", "9012"): "BUILDINGNUM", ("AADHAAR", "9876543210"): "TELEPHONENUM", ("DRIVERLICENSENUM", "AAAPA1234A"): "PAN", ("DATE", "123456"): "ZIPCODE", ("DATE", "123456789"): "ACCOUNTNUM", ("DATE", "New Delhi"): "FULLNAME", ("DATE", "new delhi"): "CITY", ("CITY", "Mobile"): "CITY"}
    assert {k: cross[at[k]].entity_group for k in want} == want
    low = cross[at["TELEPHONENUM", "Mobile"]]
    assert (low.status, low.entity_group, low.validation.corrected_category, low.original_category) == ("FILTERED", "TELEPHONENUM", "GIVENNAME", None)
    assert cross[at["DATE", "28"]].validation.corrected_category == "AGE"
    assert cross[at["DRIVERLICENSENUM", "ABCDE1234F"]].filter_reason.startswith("Does not match DRIVERLICENSENUM schema pattern: ^")
    assert cross[at["IBAN", "x"]].filter_reason == "Unknown category: IBAN"
    first = [cross[i] for i in range(26)]
    assert sum(r.status == "VALID" for r in first) == 26 and sum(r.original_category != r.entity_group for r in first) == 2


def test_missing_forms_and_odd_scores(spark):
    odd = spark.createDataFrame([(1, "A", "x", float("nan")), (2, "B", "x", 0.9), (3, "A", "x", 0.5), (4, None, "x", 0.9), (5, "A", None, 0.9)], "doc_id long, entity_group string, word string, score double")
    for cross in (False, True):
        got = {r.doc_id: (r.status, r.validation.reason) for r in validate(odd, forms={"A": "^x$", "B": None}, cross=cross).collect()}
        assert got[1][0] == "FILTERED" and got[2] == ("FILTERED", "No validation pattern available for B") and got[3][0] == "VALID" and got[4][0] == got[5][0] == "FILTERED"


MERGE = [
    ([("x", 0, 4, "a", 0.9, "r"), ("x", 2, 6, "b", 0.8, "c")], [("x", "b", 0, 6, 0.9, "r+c")]),
    ([("x", 0, 4, "a", 0.9, "r"), ("y", 0, 4, "a", 0.9, "r"), ("x", 2, 6, "b", 0.9, "r")], [("x", "a", 0, 4, 0.9, "r"), ("y", "a", 0, 4, 0.9, "r"), ("x", "b", 2, 6, 0.9, "r")]),
    ([("x", 0, 4, "a", 0.9, "r"), ("x", 4, 8, "b", 0.9, "r")], [("x", "a", 0, 4, 0.9, "r"), ("x", "b", 4, 8, 0.9, "r")]),
    ([("x", 0, 9, "a", 0.9, "r"), ("x", 2, 4, "b", 0.9, "r"), ("x", 8, 12, "c", 0.9, "r")], [("x", "c", 0, 12, 0.9, "r+r+r")]),
]


@pytest.mark.parametrize("found,want", MERGE)
def test_merge(spark, found, want):
    df = spark.createDataFrame([(1, i, g, w, s, e, p, m) for i, (g, s, e, w, p, m) in enumerate(found)], "doc_id long, seq int, entity_group string, word string, start int, end int, score double, method string")
    got = [tuple(r)[2:] for r in sorted(merge(df).collect(), key=lambda r: r.seq)]
    assert got == want
    assert merge(df.where("false")).count() == 0


def test_redaction(spark, docs):
    valid = validate(detect(docs, Options(profile="as_written", use_contextual=False))).where("status = 'VALID'")
    exact = {r.doc_id: r.redacted for r in redact(docs, valid, mode="exact").collect()}
    safe = {r.doc_id: r.redacted for r in redact(docs, valid).collect()}
    assert exact[1].startswith("[REDACTED]ACTED] random data:") and safe[1].startswith("[REDACTED] random data:")
    assert (safe[4], safe[5]) == ("", None)
    apart = detect(docs, Options(categories=("EMAIL",), use_contextual=False))
    assert rows(redact(docs, apart)) == rows(redact(docs, apart, mode="exact"))
    assert {r.doc_id: r.redacted for r in redact(docs, apart, "*").collect()}[6] == "😀 mail * And *"


def test_redaction_of_odd_rows(spark):
    rows_ = [(None, "n@n.nn and o@o.oo"), (1, "zz mail q@w.ee"), (1, "a@b.cc"), (None, None), (2, ""), (3, "none")]
    docs = spark.createDataFrame(rows_, DOCS)
    options = Options(use_contextual=False, categories=("EMAIL",))
    want = [(None, "# and #"), (1, "zz mail #"), (1, "#"), (None, None), (2, ""), (3, "none")]
    for mode in ("safe", "exact"):
        got = [(r.doc_id, r.redacted) for r in redact_texts(docs, options, "#", mode).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    table = detect(docs.where("doc_id IS NULL"), options)
    assert [r.redacted for r in redact(docs.where("text LIKE 'n@%'"), table, "#").collect()] == ["# and #"]
    assert sorted((r.start, r.word) for r in detect(docs, options).where("doc_id = 1").collect()) == [(0, "a@b.cc"), (8, "q@w.ee")]


def test_safe_redaction_against_python(spark, monkeypatch):
    import random

    from sievelake.functions import spans

    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abé😀 ") for _ in range(rng.randrange(200)))) for i in range(60)]
    found = []
    for i, t in texts:
        for k in range(rng.randrange(30)):
            s = rng.randrange(len(t) + 1)
            found.append((i, k, s, min(len(t), s + rng.randrange(1, 9))))
    docs, spans_ = spark.createDataFrame(texts, DOCS), spark.createDataFrame(found, "doc_id long, seq int, start int, end int")

    def python(i, t):
        out, reach = "", 0
        for s, e in sorted({x[2:] for x in found if x[0] == i}):
            if s >= reach:
                out += t[reach:s] + "[X]"
            reach = max(reach, e)
        return out + t[reach:]

    def spliced(i, t):
        for _, _, s, e in sorted((x for x in found if x[0] == i), key=lambda x: (-x[2], x[1])):
            t = t[:s] + "[X]" + t[e:]
        return t

    for size in (128, 4):
        monkeypatch.setattr(spans, "SLICE", size)
        assert {r.doc_id: r.redacted for r in redact(docs, spans_, "[X]").collect()} == {i: python(i, t) for i, t in texts}
    assert {r.doc_id: r.redacted for r in redact(docs, spans_, "[X]", "exact").collect()} == {i: spliced(i, t) for i, t in texts}


def test_forms_hold_from_the_start_and_for_all_digits(spark):
    some = [(1, "A", "xx12", 0.9), (2, "A", "12xx", 0.9), (3, "AGE", "٢٨", 0.9), (4, "CITY", "New\u00a0Delhi", 0.9), (5, "ZIPCODE", "110001\n", 0.9)]
    df = spark.createDataFrame(some, "doc_id long, entity_group string, word string, score double")
    forms = {"A": "[0-9]+", **{c: FORMS[c] for c in ("AGE", "CITY", "ZIPCODE")}}
    want = {i: bool(re.match(forms[c], w)) for i, c, w, _ in some}
    assert {r.doc_id: r.status == "VALID" for r in validate(df, forms=forms).collect()} == want == {1: False, 2: True, 3: True, 4: True, 5: True}
    assert sorted(r.doc_id for r in drop_invalid(df, forms=forms).collect()) == [2, 3, 4, 5] and drop_invalid(df.withColumn("score", F.lit(0.0)), forms=forms).count() == 4


def test_models_that_are_loaded_count(spark, docs):
    raw = spark.createDataFrame([(1, "bert", 0, "CITY", None, "Its own", "0.9", "0", "4")], "doc_id long, model string, i int, entity_group string, entity string, word string, score string, start string, end string")
    found = normalise(docs, raw, own_words=True)
    assert found.first().word == "Its own" and normalise(docs, raw).first().word == "Some"
    engine = Engine(spark, Options(categories=("EMAIL",), use_contextual=False), found, ("ml_bert", "ml_llama"))
    assert {r.doc_id: r.methods_used for r in engine.summarize(docs).collect()} == {1: ["ml_bert", "ml_llama"], 2: ["ml_bert", "ml_llama"], 3: ["ml_bert", "ml_llama"], 4: ["ml_bert", "ml_llama"], 5: ["ml_bert", "ml_llama"], 6: ["ml_bert", "ml_llama", "regex"]}
    assert engine.anonymize(docs, "#").where("doc_id = 1").first().redacted.startswith("# random")


def test_loading_in_several_ways():
    def fails():
        raise OSError("no weights")

    assert first_that_loads(fails, lambda: "model", fails)() == "model"
    with pytest.raises(OSError, match="weights"):
        first_that_loads(fails, fails)()


def test_joining_tokens(spark):
    tokens = [(1, "m", 0, "B-X", 0.5, 0, 3, False), (1, "m", 1, "I-Y", 0.7, 3, 5, True), (1, "m", 2, "I-X", 1.0, 6, 8, False), (1, "m", 3, "B-X", 0.4, 9, 10, False), (1, "m", 4, None, 0.9, 11, 12, False)]
    df = spark.createDataFrame(tokens, "doc_id long, model string, i int, label string, score double, start int, end int, inside boolean")
    got = {s: sorted((r.i, r.entity_group, float(r.score), int(r.start), int(r.end)) for r in join_tokens(df, s).collect()) for s in ("simple", "first")}
    assert got["simple"] == [(0, "X", 0.5, 0, 3), (1, "Y", 0.7, 3, 5), (2, "X", 1.0, 6, 8), (3, "X", 0.4, 9, 10)]
    assert got["first"] == [(0, "X", 0.75, 0, 8), (1, "X", 0.4, 9, 10)]
    with pytest.raises(ValueError, match="strategy"):
        join_tokens(df, "max")


def test_tagger_and_normalisation(spark, docs):
    def load():
        def model(text):
            if "Customer" in text:
                raise ValueError
            return [{"entity": "NAME", "score": 0.7, "start": 0, "end": 4}, {"entity_group": "X", "score": "bad", "start": 0, "end": 1}, {"start": None, "end": 2}]

        return model

    found = normalise(docs, run_tagger(docs, "toy", load)).collect()
    assert {r.doc_id for r in found} == {1, 3, 6}
    assert [(r.entity_group, r.word, r.score, r.method) for r in sorted((r for r in found if r.doc_id == 1), key=lambda r: r.seq)] == [("NAME", "Some", 0.7, "ml_toy"), ("UNKNOWN", "So", 0.0, "ml_toy")]


def test_engine(spark, docs):
    raw = spark.createDataFrame([(1, "m", 0, "CITY", None, "0.9", "0", "4")], "doc_id long, model string, i int, entity_group string, entity string, score string, start string, end string")
    engine = Engine(spark, Options(categories=("CITY", "EMAIL"), use_contextual=False), normalise(docs, raw))
    assert engine.detect(docs).where("method = 'ml_m'").count() == 1
    assert Engine(spark, Options(use_ml=False, use_regex=False, use_contextual=False)).detect(docs).count() == 0
    assert engine.summarize(docs).count() == 6 and engine.detect_merged(docs).count() > 0 and engine.status().first().model and engine.catalog().count() == 22
    assert engine.anonymize(docs, "#").where("doc_id = 6").first().redacted .count("#") >= 2
    engine.register("find_pii")
    docs.createOrReplaceTempView("some_docs")
    assert spark.sql("SELECT d.doc_id, p.word FROM some_docs d, LATERAL find_pii(d.text) p WHERE p.entity_group = 'EMAIL'").count() == 2


def test_evaluation(spark):
    key = "doc_id long, start int, end int, entity_group string"
    gold = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 5, "A"), (2, 0, 1, "B")], key)
    found = spark.createDataFrame([(1, 0, 2, "A"), (1, 0, 2, "A"), (3, 0, 1, "C")], key)
    got = {r.entity_group: (r.precision, r.recall, r.tp, r.support) for r in ev.evaluate(gold, found).collect()}
    assert got == {"A": (1.0, 0.5, 1, 2), "B": (0.0, 0.0, 0, 1), "C": (0.0, 0.0, 0, 0)}


def test_conflicts_match_brute_force(spark):
    import random

    rng = random.Random(1)
    spans = [(rng.randrange(3), i, rng.choice("xyz"), s, s + rng.randrange(1, 200), "w") for i in range(80) for s in [rng.randrange(400)]]
    df = spark.createDataFrame(spans, "doc_id long, seq int, entity_group string, start int, end int, word string")
    want = {}
    for a in spans:
        for b in spans:
            if a[0] == b[0] and a[2] < b[2] and a[3] < b[4] and b[3] < a[4]:
                want[a[0], a[2], b[2]] = want.get((a[0], a[2], b[2]), 0) + 1
    assert {(r.doc_id, r.a, r.b): r.n for r in sm.conflicts(df).collect()} == want


def test_labels_read_genders_in_full():
    assert any("(Male|Female|M|F)" in p.regex for p in labelled()) and len(labelled("service")) == 15 and labelled("library") == []
    assert list(FORMS)[7] == "STREET"
