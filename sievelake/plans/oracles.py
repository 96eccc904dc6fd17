"""DuckDB SQL that gives the same rows as the named queries."""

from __future__ import annotations

from ..functions.catalog import CATEGORIES, FORMS, PRIORITY, Pattern, detectors, names
from ..operators.detect import Options, patterns
from .notes import CASES, CLASSES, COVERAGE, NOTES, SHORT, TAGGED, TOKENS, values_sql
from .queries import IN_DOCUMENTS, IN_NOTES, IN_TURNS, OWN_FORMS

_NOTES = f"({NOTES})"
_TEXTS = values_sql(COVERAGE, "doc_id, text, expected")
_CASES = values_sql([(i, *x) for i, x in enumerate(CASES)], "doc_id, entity_group, word, score")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans_sql(source: str, wanted: list[Pattern]) -> str:
    """Matches with offsets, from the lengths of matches and of what lies between."""
    parts = []
    for rank, p in enumerate(wanted):
        regex = _quote(p.regex)
        parts.append(f"""
            SELECT doc_id, {rank} AS rank, i, {_quote(p.category)} AS entity_group, g AS word, (stop - length(g))::INT AS start, stop::INT AS stop, {p.score}::DOUBLE AS score, {_quote(p.method)} AS method
            FROM (
                SELECT doc_id, i, g, sum(length(s) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
                FROM (
                    SELECT doc_id, unnest(m) AS m, unnest(g) AS g, unnest(s[1:len(m)]) AS s, unnest(range(len(m))) AS i
                    FROM (SELECT doc_id, regexp_extract_all(text, {regex}) AS m, regexp_extract_all(text, {regex}, {p.group}) AS g, string_split_regex(text, {regex}) AS s FROM {source} WHERE regexp_matches(text, {regex}))
                )
            )""")
    return "(" + " UNION ALL ".join(parts) + ")"


def found_sql(source: str, **options) -> str:
    return f"(SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) - 1)::INT AS seq FROM {spans_sql(source, patterns(Options(**options)))})"


def _case(otherwise: str, cases: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in cases) + f" ELSE {otherwise} END"


def judged_sql(found: str, least: float = 0.5, cross: bool = False) -> str:
    has = lambda c: "true" if FORMS[c] == ".*" else f"regexp_matches(word, {_quote('^(?:' + FORMS[c] + ')')})"
    own = _case("false", [(f"category = '{c}'", has(c)) for c in FORMS])
    order = PRIORITY + [c for c in FORMS if c != "STREET" and c not in PRIORITY]
    other = _case("NULL", [(has(c), f"'{c}'") for c in order]) if cross else "NULL"
    form = _case("NULL", [(f"category = '{c}'", _quote(FORMS[c])) for c in FORMS])
    good = "'Matches ' || category || ' schema pattern'" if cross else "'Matches schema pattern'"
    bad = "'Does not match ' || category || ' schema pattern: ' || form" if cross else "'Does not match schema pattern: ' || form"
    return f"""(
        SELECT * EXCLUDE (category, own, other, form, keep), CASE WHEN keep THEN coalesce(corrected_category, category) ELSE category END AS entity_group,
               CASE WHEN keep THEN 'VALID' ELSE 'FILTERED' END AS status, CASE WHEN NOT keep THEN reason END AS filter_reason,
               CASE WHEN keep AND corrected_category IS NOT NULL THEN category END AS original_category
        FROM (
            SELECT *, valid AND score >= {least} AS keep FROM (
                SELECT *, known AND (own OR other IS NOT NULL) AS valid,
                       CASE WHEN NOT known THEN 'Unknown category: ' || category WHEN own THEN {good}
                            WHEN other IS NOT NULL THEN 'Cross-validated: matches ' || other || ' pattern instead of ' || category ELSE {bad} END AS reason,
                       {'CASE WHEN NOT known THEN NULL WHEN own THEN category ELSE other END' if cross else 'NULL::VARCHAR'} AS corrected_category
                FROM (SELECT * RENAME (entity_group AS category) FROM {found}) f,
                     LATERAL (SELECT {own} AS own, {other} AS other, {form} AS form, category IN ({', '.join(map(_quote, FORMS))}) AS known)
            )
        )
    )"""


def merged_sql(found: str) -> str:
    return f"""(
        WITH a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, seq) AS ord FROM {found}),
        b AS (SELECT *, lag(entity_group) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM a),
        c AS (SELECT *, sum((before IS DISTINCT FROM entity_group)::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM b),
        d AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
        e AS (SELECT *, sum((reach IS NULL OR start >= reach)::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM d)
        SELECT doc_id, (island - 1)::INT AS seq, min(entity_group) AS entity_group, arg_max(word, ord) AS word, min(start) AS start, max(stop) AS stop, max(score) AS score, string_agg(method, '+' ORDER BY ord) AS method
        FROM e GROUP BY doc_id, island
    )"""


def _digest(found: str, by: str) -> str:
    return f"SELECT {by}, count(*) AS n, sum(start)::BIGINT AS starts, sum(stop)::BIGINT AS ends, count(DISTINCT word) AS words, round(sum(score), 4) AS scores FROM {found} GROUP BY {by}"


def _summary(docs: str, judged: str) -> str:
    valid = "status = 'VALID'"
    method = "CASE WHEN method = 'contextual' THEN 'contextual' WHEN starts_with(method, 'regex') THEN 'regex' ELSE 'name_patterns' END"
    return f"""
    SELECT d.doc_id, coalesce(v, 0) AS total_entities, coalesce(f, 0) AS filtered_entities, coalesce(c, '') AS categories_found, coalesce(m, '') AS methods_used,
           coalesce(round(a, 6), 0.0) AS avg_confidence, coalesce(round(v / nullif(v + f, 0), 6), 0.0) AS validation_rate
    FROM {docs} d LEFT JOIN (
        SELECT doc_id, count(*) FILTER (WHERE {valid}) AS v, count(*) FILTER (WHERE NOT {valid}) AS f, avg(score) FILTER (WHERE {valid}) AS a,
               array_to_string(list_sort(list_distinct(list(entity_group) FILTER (WHERE {valid}))), ',') AS c, array_to_string(list_sort(list_distinct(list({method}))), ',') AS m
        FROM {judged} GROUP BY doc_id
    ) s ON s.doc_id = d.doc_id"""


_DOCS = {"use_contextual": False, "categories": IN_DOCUMENTS}
_IN_DOCUMENTS = found_sql("documents", **_DOCS)
_IN_NOTES = found_sql(_NOTES, categories=IN_NOTES)


def _one(category: str) -> str:
    return found_sql("documents", use_contextual=False, categories=(category,))


def _spliced(docs: str, spans: str) -> str:
    """Texts with spans (doc_id, spans: list of start and stop, last first) replaced."""
    return f"""
    SELECT d.doc_id, CASE WHEN spans IS NULL THEN text ELSE list_reduce(spans, lambda acc, x: {{'t': substr(acc.t, 1, x.s) || '[REDACTED]' || substr(acc.t, x.e + 1), 's': 0, 'e': 0}}, {{'t': text, 's': 0, 'e': 0}}).t END AS redacted
    FROM {docs} d LEFT JOIN ({spans}) s ON s.doc_id = d.doc_id"""


def _safe_spans(found: str) -> str:
    return f"""
    SELECT doc_id, list({{'t': '', 's': s, 'e': e}} ORDER BY s DESC) AS spans FROM (
        SELECT doc_id, min(start) AS s, max(stop) AS e FROM (
            SELECT *, sum((reach IS NULL OR start >= reach)::INT) OVER (PARTITION BY doc_id ORDER BY start, stop, seq) AS island FROM (
                SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {found}
            )
        ) GROUP BY doc_id, island
    ) GROUP BY doc_id"""


_GOLD = " UNION ALL ".join(
    f"SELECT doc_id, strpos(text, '{label}') - 1 + {len(label)} AS start, strpos(text, '{label}') - 1 + {len(label)} + strpos(substr(text, strpos(text, '{label}') + {len(label)}), ',') - 1 AS stop, '{c}' AS entity_group FROM {_NOTES}"
    for label, c in (("Email: ", "EMAIL"), ("Account: ", "ACCOUNTNUM"), ("Gender: ", "GENDER"), ("City: ", "CITY"))
)
_PREDICTED = found_sql(_NOTES, use_contextual=False, categories=("EMAIL", "ACCOUNTNUM", "GENDER", "CITY"))
_JUDGED = "doc_id, entity_group, word, score::DOUBLE AS score, valid, reason, corrected_category, status, filter_reason, original_category"
#: Texts in which letters and digits beyond ASCII are a digit and other signs beyond ASCII a hyphen: word boundaries are then the same to all engines, and so are names, which are ASCII.
_ASCII = r"(SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\p{Mn}\x00-\x7F]', '-', 'g'), '[^\x00-\x7F]', '0', 'g') AS text FROM documents)"
_TAGGED = f"""(SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY model, i) - 1)::INT AS seq, label AS entity_group, substr(text, least(s, length(text)) + 1, greatest(least(e, length(text)) - s, 0)) AS word,
            s AS start, e AS stop, p AS score, 'ml_' || model AS method FROM (
                SELECT *, coalesce(nullif(entity_group, ''), nullif(entity, ''), 'UNKNOWN') AS label, CASE WHEN "start" IS NULL THEN 0 ELSE try_cast("start" AS INT) END AS s,
                       CASE WHEN stop IS NULL THEN 0 ELSE try_cast(stop AS INT) END AS e, CASE WHEN score IS NULL THEN 0.0::DOUBLE ELSE try_cast(score AS DOUBLE) END AS p
                FROM {values_sql(TAGGED, 'doc_id, model, i, entity_group, entity, score, "start", stop')}
            ) JOIN {_TEXTS} USING (doc_id) WHERE s IS NOT NULL AND e IS NOT NULL AND p IS NOT NULL)"""


def _joined(strategy: str) -> str:
    tokens = values_sql(TOKENS, "doc_id, model, i, label, score, start, stop, inside")
    if strategy == "first":
        tokens = f"""(SELECT doc_id, model, min(i) AS i, arg_min(label, i) AS label, arg_min(score, i) AS score, min(start) AS start, max(stop) AS stop
            FROM (SELECT * REPLACE (coalesce(label, 'O') AS label), sum((NOT inside)::INT) OVER (PARTITION BY doc_id, model ORDER BY i) AS word FROM {tokens}) GROUP BY doc_id, model, word)"""
    return f"""WITH t AS (SELECT *, regexp_replace(coalesce(label, 'O'), '^[BI]-', '') AS category FROM {tokens}),
        r AS (SELECT *, sum((category IS DISTINCT FROM before OR starts_with(label, 'B-'))::INT) OVER (PARTITION BY doc_id, model ORDER BY i) AS run
              FROM (SELECT *, lag(category) OVER (PARTITION BY doc_id, model ORDER BY i) AS before FROM t))
        SELECT doc_id, model, (row_number() OVER (PARTITION BY doc_id, model ORDER BY run) - 1)::INT AS i, min(category) AS entity_group, round(avg(score), 6) AS score, min(start)::INT AS start, max(stop)::INT AS "end"
        FROM r WHERE category <> 'O' GROUP BY doc_id, model, run"""


_TURNS = "(SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations)"


def oracle_sql() -> dict[str, str]:
    return {
        "catalog_overview": f"SELECT ord, category, regex, n AS n_examples, examples FROM {values_sql([(i + 1, c, form, len(x), ', '.join(x)) for i, (c, form, x) in enumerate(CATEGORIES)], 'ord, category, regex, n, examples')}",
        "detect_email": f'SELECT doc_id, word, start, stop AS "end", score, method FROM {_one("EMAIL")}',
        "detect_account": f'SELECT doc_id, word, start, stop AS "end" FROM {_one("ACCOUNTNUM")}',
        "detect_fullname": _digest(f"(SELECT *, 0 AS seq FROM {spans_sql(_ASCII, names())})", "method"),
        "detect_all_regex": _digest(found_sql(_NOTES, use_contextual=False), "entity_group, method"),
        "detect_library_regex": _digest(found_sql(_NOTES, use_contextual=False, variant="library"), "entity_group, method"),
        "detect_contextual": f'SELECT doc_id, entity_group, word, start, stop AS "end" FROM {found_sql(_NOTES, use_regex=False)}',
        "detect_names": f'SELECT doc_id, word, start, stop AS "end", score, method FROM {found_sql(_NOTES, use_regex=False, use_contextual=False, use_names=True)}',
        "detect_as_written": f'SELECT doc_id, seq, entity_group, word, start, stop AS "end", method FROM {found_sql(_TEXTS, profile="as_written")}',
        "union_methods": _digest(found_sql(_NOTES, variant="service", use_names=True), "method"),
        "validate_strict": f"SELECT {_JUDGED} FROM {judged_sql(_CASES)}",
        "validate_cross": f"SELECT {_JUDGED} FROM {judged_sql(_CASES, cross=True)}",
        "relabel": f"SELECT original_category, entity_group, count(*) AS n FROM {judged_sql(_CASES, cross=True)} WHERE original_category <> entity_group GROUP BY ALL",
        "filter_confidence": f"SELECT entity_group, status, filter_reason, count(*) AS n FROM {judged_sql(_IN_NOTES, 0.92)} GROUP BY ALL",
        "merge_islands": f'SELECT doc_id, seq, entity_group, word, start, stop AS "end", score, method FROM {merged_sql(found_sql(_NOTES, variant="service", use_names=True, categories=IN_NOTES))}',
        "summary_by_doc": _summary(_NOTES, judged_sql(_IN_NOTES)),
        "summary_of_entities": f"""SELECT doc_id, count(*) AS total_entities, array_to_string(list_sort(list_distinct(list(entity_group))), ',') AS categories_found,
            array_to_string(list_sort(list_distinct(list(method))), ',') AS methods_used, round(avg(score), 6) AS avg_confidence, string_agg(printf('%.2f', score), ',' ORDER BY seq) AS scores
            FROM {merged_sql(found_sql(_TEXTS, variant="library", use_contextual=False))} GROUP BY doc_id""",
        "summary_by_category": f"SELECT entity_group, status, count(*) AS n, count(DISTINCT doc_id) AS docs, round(avg(score), 6) AS avg_score FROM {judged_sql(_IN_DOCUMENTS)} GROUP BY ALL",
        "corpus_rollup": f"SELECT lang, entity_group, count(*) AS n FROM {judged_sql(_IN_DOCUMENTS)} JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, entity_group)",
        "group_display": f"""SELECT doc_id, status, entity_group, count(*) AS n, string_agg(word || ' (' || format('{{:.1f}}', score * 100) || '%)', '; ' ORDER BY start, seq) AS shown
            FROM {judged_sql(_IN_NOTES)} GROUP BY doc_id, status, entity_group""",
        "redact_exact": _spliced(_TEXTS, f"SELECT doc_id, list({{'t': '', 's': start, 'e': stop}} ORDER BY start DESC, seq) AS spans FROM {found_sql(_TEXTS, profile='as_written', use_contextual=False)} GROUP BY doc_id"),
        "redact_safe": _spliced(_NOTES, _safe_spans(f"(SELECT * FROM {judged_sql(_IN_NOTES)} WHERE status = 'VALID')")),
        "redact_conversations": _spliced(_TURNS, _safe_spans(found_sql(_TURNS, use_contextual=False, categories=IN_TURNS))),
        "redact_documents": _spliced("documents", _safe_spans(f"(SELECT * FROM {judged_sql(_IN_DOCUMENTS)} WHERE status = 'VALID')")),
        "redact_by_model": _spliced(_TEXTS, f"SELECT doc_id, list({{'t': '', 's': start, 'e': stop}} ORDER BY start DESC, seq) AS spans FROM {_TAGGED} GROUP BY doc_id"),
        "redact_exact_notes": _spliced(_NOTES, f"SELECT doc_id, list({{'t': '', 's': start, 'e': stop}} ORDER BY start DESC, seq) AS spans FROM {found_sql(_NOTES, profile='as_written', use_contextual=False, categories=('GIVENNAME', 'SURNAME'))} GROUP BY doc_id"),
        "rollup_all_categories": f"SELECT priority, entity_group, count(*) AS n FROM {judged_sql(found_sql(_NOTES))} JOIN {_NOTES} USING (doc_id) GROUP BY ROLLUP (priority, entity_group)",
        "ml_join_simple": _joined("simple"),
        "ml_join_first": _joined("first"),
        "report_rows": f'SELECT entity_group, "precision", recall, f1, support FROM {values_sql(CLASSES, 'entity_group, "precision", recall, f1, support')}',
        "catalog_described": f"""SELECT ord, category, CASE category WHEN 'EMAIL' THEN 'An address that mail is sent to.' || chr(10) || 'Has one at sign.' WHEN 'AGE' THEN 'Years, in digits.' END AS description
            FROM {values_sql([(i + 1, c) for i, (c, _, _) in enumerate(CATEGORIES)], 'ord, category')}""",
        "status": f"SELECT false AS model, {len(patterns(Options()))} AS patterns",
        "blank_texts": f"""SELECT total_entities, filtered_entities, avg_confidence, validation_rate, count(*) AS n FROM ({_summary(f"({SHORT})", judged_sql(found_sql(f"({SHORT})")))}) GROUP BY ALL""",
        "merge_confident": _digest(merged_sql(f"(SELECT * FROM {found_sql(_NOTES, variant='service', use_names=True, categories=IN_NOTES)} WHERE score >= 0.92)"), "entity_group, method"),
        "validate_batch": _digest(f"(SELECT * FROM {judged_sql(found_sql(_NOTES, variant='service'))} WHERE valid)", "entity_group"),
        "validate_cross_notes": f"SELECT original_category, entity_group, status, count(*) AS n, count(DISTINCT word) AS words FROM {judged_sql(found_sql(_NOTES, variant='service'), cross=True)} GROUP BY ALL",
        "detect_unknown_categories": _digest(f"(SELECT *, 0 AS seq FROM {spans_sql('(SELECT o_orderkey AS doc_id, o_orderpriority AS text FROM orders)', detectors(forms=OWN_FORMS))})", "entity_group"),
        "detect_by_sql": f'SELECT doc_id, entity_group, word, start, stop AS "end" FROM {found_sql(_NOTES, use_contextual=False, categories=IN_TURNS)}',
        "detect_by_python": _digest(found_sql(_NOTES, use_contextual=False), "entity_group, method"),
        "json_results": f"SELECT entity_group, status, count(*) AS n, count(DISTINCT doc_id) AS docs, round(avg(score), 6) AS avg_score FROM {judged_sql(_IN_DOCUMENTS)} GROUP BY ALL",
        "clean_docs": f"SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {_IN_DOCUMENTS}) GROUP BY lang",
        "docs_with_category": f"SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM {_one('EMAIL')})",
        "topk_exposed_docs": f"SELECT doc_id, count(*) AS n FROM {judged_sql(_IN_DOCUMENTS)} WHERE status = 'VALID' GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 20",
        "preview": "SELECT doc_id, substr(text, 1, 80) || '...' AS preview FROM documents",
        "ml_normalize": f'SELECT * RENAME (stop AS "end") FROM {_TAGGED}',
        "coverage_ratio": f"""SELECT doc_id, round(r, 6) AS ratio, r >= 0.7 AS passed FROM (
            SELECT t.doc_id, len(list_intersect(string_split(expected, ','), coalesce(have, []))) / len(string_split(expected, ',')) AS r
            FROM {_TEXTS} t LEFT JOIN (SELECT doc_id, list(DISTINCT entity_group) AS have FROM {found_sql(_TEXTS)} GROUP BY doc_id) f ON f.doc_id = t.doc_id)""",
        "metrics_averages": f"""WITH c AS (SELECT *, round(recall * support) AS tp, CASE WHEN "precision" > 0 THEN round(round(recall * support) / "precision") ELSE 0 END AS predicted FROM {values_sql(CLASSES, 'entity_group, "precision", recall, f1, support')}),
            s AS (SELECT sum(tp) AS tp, sum(predicted) AS predicted, sum(support)::BIGINT AS support FROM c)
            SELECT 'micro avg' AS average, round(tp / predicted, 6) AS "precision", round(tp / support, 6) AS recall, round(2 * tp / (predicted + support), 6) AS f1, support FROM s
            UNION ALL SELECT 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM c
            UNION ALL SELECT 'weighted avg', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM c""",
        "evaluate_gold_vs_pred": f"""SELECT entity_group, round(p, 6) AS "precision", round(r, 6) AS recall, coalesce(round(2 * p * r / nullif(p + r, 0), 6), 0.0) AS f1, tp, predicted, support FROM (
            SELECT entity_group, count(*) FILTER (WHERE g AND f) AS tp, count(f) AS predicted, count(g) AS support, coalesce(tp / nullif(predicted, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r
            FROM (SELECT DISTINCT doc_id, start, stop, entity_group, true AS g FROM ({_GOLD})) a
            FULL JOIN (SELECT DISTINCT doc_id, start, stop, entity_group, true AS f FROM {_PREDICTED}) b USING (doc_id, start, stop, entity_group) GROUP BY entity_group)""",
        "span_conflicts": f"""WITH f AS MATERIALIZED (SELECT * FROM {found_sql(_NOTES, use_contextual=False, categories=("ACCOUNTNUM", "TELEPHONENUM", "AADHAAR", "STREET", "BUILDINGNUM"))})
            SELECT a, b, sum(n)::BIGINT AS n, count(*) AS docs FROM (
                SELECT x.doc_id, x.entity_group AS a, y.entity_group AS b, count(*) AS n FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.entity_group < y.entity_group AND x.start < y.stop AND y.start < x.stop GROUP BY ALL
            ) GROUP BY a, b""",
    }
