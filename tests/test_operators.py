import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.operators import accounts, ask, facts, grid, jobs, reports, resolve, search, state, statement
from factloom.operators import evidence as evidence_ops
from factloom.scope import Scope, scoped
from factloom.sources import corpus, evidence, office, seed
from factloom.streaming import ingest

ALL = Scope.everything()


def fact(i, value=193.0e6, **kw):
    base = {"fact_id": f"fact_{i}", "entity_id": "secl", "metric": "coal_production", "value": float(value), "unit": "t", "period_start": date(2024, 4, 1), "period_end": date(2025, 3, 31), "period_label": "FY2024-25", "fiscal_year": "FY2024-25", "status": "validated", "document_id": "doc_1", "conf_ocr": None, "conf_parse": 0.97, "conf_answer": None, "unit_ambiguous": False, "notes": None}
    return base | kw


SCHEMA = "fact_id string, entity_id string, metric string, value double, unit string, period_start date, period_end date, period_label string, fiscal_year string, status string, document_id string, conf_ocr double, conf_parse double, conf_answer double, unit_ambiguous boolean, notes string"


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def test_scope(make):
    df = make(fact(1), fact(2, entity_id="mcl"))
    assert scoped(df, Scope.of("mcl")).count() == 1 and scoped(df, Scope.of()).count() == 0 and scoped(df, Scope.of("*")).count() == 2
    assert "LocalTableScan <empty>" in scoped(df, Scope.of())._jdf.queryExecution().toString()


def test_series_picks_and_never_adds(make):
    df = make(fact(1), fact(2), fact(3, 60e6, period_end=date(2024, 6, 30)), fact(4, 191e6, status="extracted"))
    assert [(r.value, r.fact_count) for r in facts.series(df, "coal_production", ALL).collect()] == [(193e6, 2)]


def test_radar_threshold(make):
    df = make(fact(1, 193.0), fact(2, 191.5), fact(3, 100.0, metric="x"), fact(4, 100.4, metric="x"), fact(5, 0.0, metric="z"), fact(6, 0.0, metric="z"), fact(7, 50.0, status="rejected"))
    got = facts.radar(df, ALL).collect()
    assert [(r.metric, r.fact_ids) for r in got] == [("coal_production", ["fact_2", "fact_1"])] and abs(got[0].spread - 1.5 / 193) < 1e-12
    with pytest.raises(ValueError):
        state.check_tighter(0.01)


def test_states(make, spark):
    df = make(fact(1, status="extracted", conf_parse=0.5), fact(2, status="extracted", conf_ocr=0.9), fact(3, status="extracted", unit_ambiguous=True), fact(4, status="extracted", conf_parse=None), fact(5, status="needs_review"))
    look = lambda d: {r.fact_id[5:]: r.status for r in d.collect()}
    assert look(state.promote_high(state.flag_low(df))) == {"1": "needs_review", "2": "validated", "3": "extracted", "4": "extracted", "5": "needs_review"}
    decided = state.apply_decisions(df, spark.createDataFrame([("fact_5", 1, "reject", None), ("fact_5", 2, "correct", 7.0)], "fact_id string, seq int, decision string, corrected_value double"))
    five = decided.where("fact_id = 'fact_5'").first()
    assert (five.status, five.value, five.review_state) == ("validated", 7.0, "corrected")
    two = make(fact(1, 193.0), fact(2, 191.5), fact(3, 5.0, metric="y", status="conflicted"))
    groups = facts.radar(two, ALL)
    assert look(state.reconcile(two, groups, ALL)) == {"1": "conflicted", "2": "conflicted", "3": "extracted"}
    kept = state.apply_decisions(df.withColumn("review_state", F.lit("approved")), spark.createDataFrame([("fact_5", 1, "reject", None, "no")], "fact_id string, seq int, decision string, corrected_value double, note string"))
    assert {r.fact_id: (r.review_state, r.notes) for r in kept.collect()} == {"fact_5": ("rejected", "no")} | {f"fact_{i}": ("approved", None) for i in range(1, 5)}


CONFLICT = "conflict_id string, entity_id string, fact_ids array<string>, resolved_fact_id string, resolution_note string, value_low double, value_high double"


def test_resolving_conflicts(make, spark):
    df = make(fact(1, 193.0), fact(2, 191.5), fact(3, 5.0, metric="y", status="conflicted"), fact(4, 6.0, metric="y"), fact(5, entity_id="mcl"), fact(6, entity_id="mcl"))
    conflicts = spark.createDataFrame([("c1", "secl", ["fact_2", "fact_1"], None, None, 191.5, 193.0), ("c2", "secl", ["fact_3", "fact_4"], "fact_3", "done", 5.0, 6.0), ("c3", "mcl", ["fact_5", "fact_6"], None, None, 0.0, 0.0)], CONFLICT)
    told = [("c1", "fact_9", "stranger", "u", 1), ("c1", "fact_1", "first", "u", 2), ("c1", "fact_2", "too late", "v", 3), ("c2", "fact_4", "closed", "u", 1), ("c3", "fact_5", "not mine", "u", 1)]
    choices = spark.createDataFrame(told, "conflict_id string, winner string, note string, actor string, seq int")
    facts_, after = state.resolve_conflicts(df, conflicts, choices, Scope.of("secl"))
    assert {r.fact_id[5:]: (r.status, r.review_state) for r in facts_.collect()} == {"1": ("validated", "approved"), "2": ("rejected", "rejected"), "3": ("conflicted", "unreviewed"), "4": ("validated", "unreviewed"), "5": ("validated", "unreviewed"), "6": ("validated", "unreviewed")}
    assert {r.conflict_id: (r.resolved_fact_id, r.resolution_note, r.resolved_by) for r in after.collect()} == {"c1": ("fact_1", "first", "u"), "c2": ("fact_3", "done", None), "c3": (None, None, None)}
    open_ = {r.conflict_id: (r.width and round(r.width, 4), [m.fact_id for m in r.members]) for r in facts.open_conflicts(conflicts, df, ALL).collect()}
    assert open_ == {"c1": (0.0078, ["fact_2", "fact_1"]), "c3": (None, ["fact_5", "fact_6"])}


def test_deleting_for_extraction(make, spark):
    df = make(fact(1), fact(2), fact(3, document_id="doc_2"), fact(4, document_id="doc_2")).withColumn("document_version", F.when(F.col("fact_id") == "fact_2", 2).otherwise(1))
    conflicts = spark.createDataFrame([("c1", "secl", ["fact_1", "fact_3"], None, None, 0.0, 1.0), ("c2", "secl", ["fact_3", "fact_4"], "fact_1", None, 0.0, 1.0), ("c3", "secl", ["fact_2", "fact_4"], None, None, 0.0, 1.0)], CONFLICT)
    left, kept = state.delete_documents(df, conflicts, spark.createDataFrame([("doc_1", 1), ("doc_9", 1)], "document_id string, document_version int"))
    assert sorted(r.fact_id for r in left.collect()) == ["fact_2", "fact_3", "fact_4"] and [r.conflict_id for r in kept.collect()] == ["c3"]


def test_inserting(spark):
    table = spark.createDataFrame([("e1", "d", "x")], "evidence_id string, document_id string, text string")
    both = state.insert(table, spark.createDataFrame([("d", "y"), ("d", "z")], "document_id string, text string"), key="evidence_id").collect()
    assert len({r.evidence_id for r in both}) == 3 and all(r.evidence_id for r in both)
    with pytest.raises(ValueError, match="unknown columns: colour"):
        state.insert(table, table.withColumn("colour", F.lit("red")))


def test_setters(spark):
    docs = spark.createDataFrame([("d", None, "FY2020-21", None, None), ("e", "x", None, "mcl", "mcl")], "document_id string, doc_class string, fiscal_year string, publisher_entity_id string, owner_entity_id string")
    after = {r.document_id: tuple(r)[1:] for r in state.set_fields(docs, spark.createDataFrame([("d", "scan", None, "secl"), ("e", None, "FY2021-22", "ecl")], "document_id string, doc_class string, fiscal_year string, publisher_entity_id string")).collect()}
    assert after == {"d": ("scan", "FY2020-21", "secl", "secl"), "e": ("x", "FY2021-22", "ecl", "mcl")}
    counters = lambda *rows: spark.createDataFrame(rows, "document_id string, stage string, done int, total int, at string").withColumn("at", F.col("at").cast("timestamp"))
    once = state.set_progress(docs, counters(("d", "ocr", 1, 9, "2024-01-01"), ("d", "ocr", 4, 9, "2024-01-02"), ("d", "extract", 2, 2, "2024-01-01")))
    twice = {r.document_id: {k: (v.done, v.total) for k, v in r.progress.items()} for r in state.set_progress(once, counters(("d", "ocr", 9, 9, "2024-01-03"), ("e", "ocr", 0, 1, "2024-01-01"))).collect()}
    assert twice == {"d": {"ocr": (9, 9), "extract": (2, 2)}, "e": {"ocr": (0, 1)}}
    assert facts.bounded(200) == 200
    with pytest.raises(ValueError):
        facts.bounded(0)


def test_accounts(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    users = spark.createDataFrame([(1, "a", True, "admin", 3, None, None), (2, "b", False, "admin", 0, None, None), (3, "c", True, "viewer", 4, None, None), (4, "d", True, "viewer", 9, at(1), at(1))], "user_id int, username string, is_active boolean, role string, failed_login_count int, locked_until string, last_login_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("locked_until", "last_login_at")})
    rows = [(1, 1, at(2), "failure"), (1, 2, at(3), "success"), (1, 3, at(4), "failure"), (3, 1, at(5), "failure"), (3, 2, at(6), "failure"), (4, 1, at(7), "unlock"), (9, 1, at(1), "failure")]
    events = spark.createDataFrame(rows, "user_id int, seq int, at string, kind string").withColumn("at", F.col("at").cast("timestamp"))
    after = {r.user_id: (r.failed_login_count, str(r.locked_until), str(r.last_login_at)) for r in accounts.logins(users, events).collect()}
    assert after == {1: (1, "None", at(3)), 2: (0, "None", "None"), 3: (6, "2024-01-06 00:15:00", "None"), 4: (0, "None", at(1))}
    scopes = spark.createDataFrame([(1, "*"), (2, "secl"), (3, "secl"), (3, "mcl")], "user_id int, entity_id string")
    see = lambda e: sorted(r.username for r in accounts.users_with(users, scopes, e).collect())
    assert see("secl") == ["a", "c"] and see("ncl") == ["a"] and accounts.active_admins(users).first().admins == 1
    assert {(r.entity_id, r.username) for r in accounts.users_with(users, scopes).collect()} == {("secl", "a"), ("secl", "c"), ("mcl", "a"), ("mcl", "c")}
    changes = [(2, "secl", 1, "grant"), (2, "mcl", 2, "grant"), (3, "secl", 1, "revoke"), (1, "ncl", 1, "replace"), (1, "ecl", 1, "replace"), (1, "ecl", 2, "revoke"), (4, None, 5, "replace"), (4, "secl", 4, "grant")]
    held = {(r.user_id, r.entity_id) for r in accounts.regrant(scopes, spark.createDataFrame(changes, "user_id int, entity_id string, seq int, kind string")).collect()}
    assert held == {(2, "secl"), (2, "mcl"), (3, "mcl"), (1, "ncl")}


def test_layout_order(spark):
    rows = [("e1", "d", 1, 1, "line", 5.0, 2.0, "b"), ("e2", "d", 1, 1, "line", None, None, "z"), ("e3", "d", 1, 1, "line", 5.0, 1.0, "a"), ("e4", "d", 1, None, "line", None, 1.0, "w"), ("e5", "x", 1, 1, "line", 1.0, 1.0, "no"), ("e6", "d", 1, 1, "cell", 0.0, 0.0, "c")]
    spans = spark.createDataFrame(rows, "evidence_id string, document_id string, document_version int, page int, kind string, bbox_y0 double, bbox_x0 double, text string").withColumns({c: F.lit(None).cast("string") for c in ("table_id", "row_idx", "col_idx")})
    papers = spark.createDataFrame([("d", "secl"), ("x", "mcl")], "document_id string, owner_entity_id string")
    placed = evidence_ops.by_page(spans, papers, Scope.of("secl"), page=1).orderBy("position").collect()
    assert [r.evidence_id for r in placed] == ["e6", "e3", "e1", "e2"] and evidence_ops.count(spans, papers, Scope.of("mcl")).first().evidence == 1
    assert {(r.document_id, r.page): r.lines for r in evidence_ops.page_lines(spans).collect()} == {("d", 1): ["b", "a", "z"], ("d", None): ["w"], ("x", 1): ["no"]}
    assert [r.evidence_id for r in evidence_ops.by_document(spans, kinds=("line",)).where("document_id = 'd'").orderBy("position").collect()] == ["e3", "e1", "e2", "e4"]


def test_document_state(spark):
    docs = spark.createDataFrame([("d", "received", "s", "r", {"a": "1"})], "document_id string, state string, failed_stage string, failed_reason string, stage_progress map<string,string>")
    events = spark.createDataFrame([("d", 1, "failed", "extract", "x", {"b": "2"}), ("d", 2, "ready", None, None, {"a": "3"})], "document_id string, seq int, state string, stage string, reason string, progress map<string,string>")
    got = state.set_state(docs, events).first()
    assert got.state == "ready" and got.failed_stage is None and got.stage_progress == {"a": "3", "b": "2"}


def test_resolve_ladder(make, spark):
    df = make(
        fact(1), fact(2, entity_id="a", status="rejected"), fact(3, 1.0, entity_id="b"), fact(4, 2.0, entity_id="b"), fact(5, entity_id="c", unit_ambiguous=True), fact(6, entity_id="d", status="extracted"),
        fact(7, 1.000, entity_id="e"), fact(8, 1.001, entity_id="e"),
    )
    asked = spark.createDataFrame([(e, "coal_production", "FY2024-25") for e in ("secl", "a", "b", "c", "d", "e", "nobody")], "entity_id string, metric string, period_label string")
    got = {r.entity_id: (r.reason, r.fact_id) for r in resolve.resolve(asked, df, ALL).collect()}
    assert got == {"secl": (None, "fact_1"), "a": ("no_validated_fact", None), "b": ("open_conflict", None), "c": ("ambiguous_unit", None), "d": ("no_validated_fact", None), "e": ("open_conflict", None), "nobody": ("out_of_corpus", None)}


def test_extract_demo_table(spark):
    found, skips = grid.extract(seed.demo_evidence(spark))
    rows = {(r.entity_id, r.fiscal_year): (r.value, r.metric, r.status) for r in found.collect()}
    assert len(rows) == 8 and rows["secl", "FY2024-25"] == (193.0e6, "coal_production", "extracted")
    assert [(r.reason, r.sample) for r in skips.collect()] == [("total_row", "Total")]


def test_extract_reasons(spark):
    rows = [("SECL", 1.0, 2.0), ("Somebody else", 3.0, 4.0)]
    base = seed.demo_evidence(spark, rows=rows)
    reasons = lambda e: sorted(r.reason for r in grid.extract(e)[1].collect())
    assert reasons(base) == ["no_entity"] * 2
    assert reasons(base.where("text not like '%Figures%'")) == ["no_entity"] * 2 + ["no_unit"] * 2
    assert reasons(base.withColumn("text", F.when(F.col("text").contains("Figures"), "(Figures in Miil Te)").otherwise(F.col("text")))) == ["ambiguous_unit"] * 2 + ["no_entity"] * 2
    assert reasons(base.withColumn("text", F.when(F.col("text").contains("Figures"), "(Figures in hectares)").otherwise(F.col("text")))) == ["no_entity"] * 2 + ["wrong_dimension"] * 2
    assert reasons(base.withColumn("text_layer_recognised", F.lit(True))) == ["unverifiable_ocr_layer"] * 4


STATEMENT = [
    (2, 2, "COAL"), (2, 3, "PRODUCTIO"), (2, 4, "N (Figs in Miil Te)"), (4, 2, "AUG'23"), (4, 4, "APR'"), (4, 5, "23 - AUG'23"), (6, 1, "ACTUAL THIS"), (6, 3, "% GROWTH"),
    *((9, i, t) for i, t in enumerate(["ECL", "2.7", "2.4", "12.2", "15.6", "13.4", "16.6"])), *((10, i, t) for i, t in enumerate(["BCCL", "3.1", "2.7", "14.3", "16.2", "13.5", "20.2"])),
    *((11, i, t) for i, t in enumerate(["NCL", "11.4", "10.5", "7.8", "57.4", "53.8", "6.7"])), *((12, i, t) for i, t in enumerate(["WCL", "3.0", "2.5", "99.0", "21.8", "18.4", "18.5"])), *((13, i, t) for i, t in enumerate(["CIL", "20.2", "18.1", "11.6", "111.0", "99.1", "12.0"])),
]


def test_statement(spark):
    schema = "document_id string, table_id string, page int, row_idx int, col_idx int, text string, extraction_method string, text_layer_recognised boolean, fiscal_year string, publisher_entity_id string"
    cells = lambda items: spark.createDataFrame([("d", "t", 1, r, c, t, "table_stream", True, None, "cil") for r, c, t in items], schema)
    got = statement.read(cells(STATEMENT)).collect()
    figures = {(r.entity_id, r.period_label): r.value for r in got if r.reason is None}
    assert len(figures) == 14 and figures["ecl", "Aug 2023"] == 2.7e6 and figures["ecl", "Aug 2022"] == 2.4e6 and figures["ncl", "Apr 2022 - Aug 2022"] == pytest.approx(53.8e6)
    assert sorted(r.reason for r in got if r.reason) == ["fails_self_check", "total_row"]
    wrong = [(r, c, "50.0" if c == 3 and r > 8 or c == 6 and r > 8 else t) for r, c, t in STATEMENT]
    assert {r.reason for r in statement.read(cells(wrong)).collect()} == {"layout_unverified"}
    assert statement.read(seed.demo_evidence(spark)).count() == 0


def test_questions(make, spark):
    asked = {
        "What was SECL coal production in FY2024-25?": ("secl", "coal_production", "FY2024-25", "exact_figure"), "coal production of SECL": ("secl", "coal_production", None, "comparison"),
        "Compare coal production across years": (None, "coal_production", None, "comparison"), "Why did production fall?": (None, None, None, "narrative"), "Draft a reply to the question": (None, None, None, "draft"),
        "safety in mines": (None, None, None, "discovery"), "output of Mahanadi Coalfields in 2024": ("mcl", None, "2024", "discovery"), "raw coal production by South Eastern Coalfields in 2023, or FY2021-22": ("secl", "coal_production", "FY2021-22", "exact_figure"),
        "as on 31.03.2025, coal stock of ECL in Mar 2025": ("ecl", "coal_stock", "Mar 2025", "exact_figure"),
    }
    got = ask.slots(spark.createDataFrame([(q,) for q in asked], "question string")).collect()
    assert {r.question: (r.entity, r.metric, r.period, r.kind) for r in got} == asked
    kind, rows = ask.answer(spark, "What was SECL coal production in FY2024-25?", make(fact(1)), None, ALL)
    assert kind == "exact_figure" and rows.first().value == 193e6


def test_search(spark):
    rows = spark.createDataFrame([("a", 1, "The mines closed early"), ("b", 1, "A mine was closing"), ("c", 2, "closed shop, no mining"), ("d", 1, "nothing here")], "document_id string, page int, text string")
    find = lambda q: [r.document_id for r in search.search(rows, q).collect()]
    assert sorted(find("mine")) == ["a", "b", "c"] and find('"mine closed"') == ["a"] and sorted(find("mine -closed")) == [] and sorted(find("shop or early")) == ["a", "c"]
    assert find("") == [] and find('"') == [] and "[[" in search.search(rows, "mines").first().snippet


def test_reports(make, spark):
    template = reports.TEMPLATES["production-summary"]
    asked = spark.createDataFrame([("South Eastern Coalfields", "2024-25"), ("Atlantis", "2024"), ("SECL", "soon")], "entity string, period string")
    known = {r.entity: r for r in reports.contexts(asked).collect()}
    assert (known["South Eastern Coalfields"].entity_id, known["South Eastern Coalfields"].entity_code, known["South Eastern Coalfields"].period_label, known["South Eastern Coalfields"].fault) == ("secl", "SECL", "FY2024-25", None)
    assert (known["Atlantis"].fault, known["SECL"].fault) == ("unknown entity", "unknown period")
    fields = reports.fields(spark, template, {"entity": "secl", "period": "FY2024-25"})
    manifest = resolve.pin(fields, make(fact(1)), ALL)
    text = reports.markdown("Summary", manifest)
    assert "193,000,000.00" in text and "Not available" in text and resolve.complete(manifest)
    assert [r.change for r in resolve.diff(manifest, make(fact(1, 5.0)), ALL).collect()] == ["changed"]
    placed = make(fact(1)).withColumns({"document_version": F.lit(2), "page": F.lit(3), "table_id": F.lit("t1"), "cell_ref": F.lit("B2")})
    assert resolve.sources(manifest, placed).first().locators == "doc:doc_1 v2 p.3 t1 B2"
    stored = reports.create(manifest.withColumn("report_key", F.lit("k")), "u1", "2024-02-01", template.name)
    row = stored.first()
    assert (row.state, row.complete, row.template_id) == ("draft", True, "production-summary")
    again = reports.reproduce(stored)
    assert reports.markdown("Summary", again) == text
    rows = [(i, s, a, c) for i, (s, a, c) in enumerate([("in_review", "x", True), ("draft", "x", True), ("draft", "x", False), ("in_review", "x", False), ("in_review", "x", True), ("in_review", "y", True), ("approved", "x", True), ("published", "x", True)])]
    held = spark.createDataFrame(rows, "report_id int, state string, author string, complete boolean").withColumns({c: F.lit(None).cast(t) for c, t in (("approved_by", "string"), ("approved_at", "timestamp"), ("published_at", "timestamp"))})
    wanted = [(0, 1, "approved", "approver", "y"), (0, 2, "draft", "admin", "y"), (1, 1, "published", "admin", "y"), (2, 1, "in_review", "officer", "y"), (3, 1, "approved", "viewer", "y"), (4, 1, "approved", "officer", "y"), (5, 1, "approved", "admin", "y"), (6, 1, "in_review", "approver", "y")]
    moves = spark.createDataFrame(wanted, "report_id int, seq int, target string, role string, actor string").withColumn("at", F.lit("2024-03-01").cast("timestamp"))
    after = {r.report_id: (r.state, r.refusal, r.approved_by) for r in reports.move(held, moves).collect()}
    assert after == {0: ("approved", None, "y"), 1: ("draft", "illegal", None), 2: ("in_review", None, None), 3: ("in_review", "incomplete", None), 4: ("in_review", "role", None), 5: ("in_review", "own", None), 6: ("in_review", None, None), 7: ("published", None, None)}
    told = reports.narrated(spark.createDataFrame([(1, "A", "It rose to 193 in 2024. It fell by 8%."), (1, "B", "It rose."), (2, "A", "Of 7 mines.")], "report_id int, title string, text string"), spark.createDataFrame([(1, 193.0)], "report_id int, value double"))
    assert {(r.report_id, r.title): (r.text, r.flagged) for r in told.collect()} == {(1, "A"): ("It rose to 193 in 2024.", True), (1, "B"): ("It rose.", False), (2, "A"): ("", True)}


TEMPLATE = """# a template
id: yearly
version: 3
title: "Yearly, {{period}}"
required:
  - metric: coal_production
    entity: "{{entity}}"
    period: '{{period}}'   # as given
optional:
sections:
  - kind: narrative
    title: Reply
    prompt: Say it.
  - kind: figures
    title: Figures
"""


def test_templates():
    t = reports.Template.load(TEMPLATE)
    assert (t.name, t.version, t.title, t.required, t.optional, t.sections, t.prompts) == ("yearly", 3, "Yearly, {{period}}", (("coal_production", "{{entity}}", "{{period}}"),), (), ("narrative", "figures"), (("Reply", "Say it."),))
    assert reports.plain_yaml("- 1\n- a b\n- x: true\n  y: ~\n") == [1, "a b", {"x": True, "y": None}] and reports.plain_yaml("") == {}
    assert reports.Template.load('{"name": "n", "title": "t", "required": [{"metric": "m", "entity": "e", "period": "p"}]}').required == (("m", "e", "p"),)


def test_office_files(spark, tmp_path):
    figures = [office.Figure("Coal production", "SECL", "FY2024-25", 193e6, "t", "doc_1"), office.Figure("Coal offtake", "SECL", "FY2024-25", None, None, None, False, "out_of_corpus")]
    (tmp_path / "a.xlsx").write_bytes(office.workbook("T & U", figures, {"Made": "2024"}))
    (tmp_path / "b.docx").write_bytes(office.document("T & U", figures, {"Reply": "It rose."}))
    (tmp_path / "c.pptx").write_bytes(office.slides("T", figures))
    got = evidence.digitize(evidence.inspect(evidence.blobs(spark, str(tmp_path))).where("reason is null")).collect()
    sheets = {(r.table_id, r.cell_ref): r.text for r in got if r.kind == "sheet_cell"}
    assert {"Coal production", "193000000.0", "doc_1", "T & U", "2024"} <= set(sheets.values())
    assert {r.text for r in got if r.kind == "line"} >= {"T & U", "It rose.", "Sources: doc_1"} and "193,000,000.00" in {r.text for r in got if r.kind == "table_cell"}
    with zipfile.ZipFile(tmp_path / "c.pptx") as z:
        assert "193,000,000.00 t (doc_1)" in z.read("ppt/slides/slide2.xml").decode() and z.testzip() is None
    with pytest.raises(ValueError):
        office.document("T", [office.Figure("m", "e", "p", None, None, None, True, "open_conflict")])


def test_prose_degrades(make, spark):
    lines = spark.createDataFrame([("d", 1, "SECL output was 193 last year"), ("e", 1, "nothing")], "document_id string, page int, text string")
    ask_ = "Why did SECL coal production rise to output"
    none = lines.where("document_id = 'e'")
    assert ask.degrade(spark, ask_, make(fact(1)), lines, ALL, model=lambda p, f: f"It was {int(f[0].value)}. It fell by 8. Output was 193.") == ("prose", "It was 193000000.")  # no passage holds all of the question's words
    assert ask.degrade(spark, "SECL output", make(fact(1)), lines, ALL, model=lambda p, f: "Output was 193. It fell by 8.") == ("prose", "Output was 193.")

    def gone(passages, figures):
        raise ConnectionError

    assert ask.degrade(spark, "output of SECL", make(fact(1)), lines, ALL, model=gone)[0] == "passages"
    assert ask.degrade(spark, ask_, make(fact(1)), none, ALL)[0] == "figures" and ask.degrade(spark, ask_, make(fact(1, entity_id="mcl")), none, ALL, model=gone)[0] == "out_of_corpus"
    terms = spark.createDataFrame([("blasting", 4, 1.0), ("haulage", 4, 2.0)], "term string, document_count int, score double")
    assert [(r.kind, r.question) for r in ask.suggestions(make(fact(1), fact(2, entity_id="mcl")), ALL, terms).collect()] == [("exact_figure", "MCL coal production FY2024-25"), ("comparison", "compare coal production across subsidiaries"), ("discovery", "documents mentioning haulage")]


def test_snippets(spark):
    words = [f"w{i}" for i in range(100)]
    words[20], words[26], words[80] = "Mines", "mining", "mine"
    text = spark.createDataFrame([(" ".join(words),), ("a mine",), ("no hit here",)], "t string")
    got = [r.s for r in text.select(search.snippet(F.col("t"), ["min"]).alias("s")).collect()]
    one, two = got[0].split(" ... ")
    assert one.count("[[") == 2 and "[[Mines]]" in one and two.count("[[") == 1 and all(8 <= len(x.split()) <= 28 for x in (one, two))
    assert got[1] == "a [[mine]]" and got[2] == "no hit here"


def test_corpus_files(spark):
    rows = [("https://x.in/a/ECL_Annual%20Report.pdf", "CIL"), ("https://x.in/a/report.pdf?n=wcl", "Annual report of Central Coalfields"), ("https://x.in/ncl/", "Northern Coalfields"), ("https://x.in/North-Eastern%20Coalfields.pdf", ""), ("https://x.in/Eastern+Coalfields.pdf", ""), ("https://x.in/p%zz.pdf", None), ("https://x.in/nlc-india.pdf", "NLC India"), ("https://x.in/excellence.pdf", "x")]
    df = spark.createDataFrame(rows, "url string, title string")
    filed = [r.c for r in df.select(corpus.company(F.col("url"), F.col("title"), F.lit("coalcontroller")).alias("c")).collect()]
    assert filed == ["ecl", "ccl", "ncl", "nec", "coalcontroller", "coalcontroller", "coalcontroller", "coalcontroller"]
    names_ = spark.createDataFrame([("ecl",), ("coalcontroller",)], "c string").select(corpus.organisation(F.col("c"), F.lit("Coal Controller")).alias("o")).collect()
    assert [r.o for r in names_] == ["Eastern Coalfields Limited", "Coal Controller"]


def test_queue(spark):
    rows = spark.createDataFrame([("a", "claimed", "w1", 1, 3), ("b", "claimed", "w1", 3, 3), ("c", "claimed", "w2", 1, 3)], "job_id string, state string, claimed_by string, attempts int, max_attempts int").withColumn("available_at", F.lit("2024-01-01").cast("timestamp"))
    outcome = spark.createDataFrame([("a", "w1", False, False), ("b", "w1", False, False), ("c", "w1", True, False)], "job_id string, worker string, ok boolean, permanent boolean")
    assert {r.job_id: r.state for r in jobs.finish(rows, outcome, "2024-01-02").collect()} == {"a": "pending", "b": "dead", "c": "claimed"}
    assert jobs.legal("received", "classified") and jobs.legal("ready", "ready") and not jobs.legal("received", "ready")


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="x"><sheets><sheet name="Offtake"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst xmlns='x'><si><t>SECL</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet xmlns='x'><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1'><v>188.2</v></c><c r='AA2' t='inlineStr'><is><t>note</t></is></c><c r='C1'/></row></sheetData></worksheet>")


def test_files(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", "<d xmlns='x'><body><p><t>Capacity</t></p><tbl><tr><tc><p><t>SECL</t></p></tc><tc><p><t>185.00</t></p></tc></tr></tbl></body></d>")
    (tmp_path / "d.zip").write_bytes(b"PK\x03\x04 broken")
    # the binaryFile reader leaves empty files out; a row of one comes from an upload
    empty = spark.createDataFrame([("/c.bin", 0, bytearray(), "e3", "doc_e3", "unknown")], "path string, length long, content binary, content_hash string, document_id string, kind string")
    files = evidence.blobs(spark, str(tmp_path)).unionByName(empty)
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in evidence.inspect(files).collect()} == {"a.xlsx": None, "b.docx": None, "c.bin": "empty", "d.zip": "unreadable"}
    got = {(r.kind, r.cell_ref, r.row_idx, r.col_idx, r.text) for r in evidence.digitize(evidence.inspect(files).where("reason is null")).collect()}
    assert got == {("sheet_cell", "A1", 1, 1, "SECL"), ("sheet_cell", "B1", 1, 2, "188.2"), ("sheet_cell", "AA2", 2, 27, "note"), ("line", None, None, None, "Capacity"), ("table_cell", "r0c0", 0, 0, "SECL"), ("table_cell", "r0c1", 0, 1, "185.00")}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../x", "0" * 10)
    assert evidence.archive_fault(buffer.getvalue()) == "traversal"


def test_stream_equals_batch(spark, tmp_path):
    rows = seed.demo_evidence(spark, "d1").unionByName(seed.demo_evidence(spark, "d2", rows=[("MCL", 190.0, 212.0)]))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows.write.parquet(source)
    for _ in range(2):  # a second run adds nothing
        ingest.ingest(spark, source, rows.schema, out, checkpoint).awaitTermination()
    rows.where("document_id = 'd2'").write.mode("append").parquet(source)
    ingest.ingest(spark, source, rows.schema, out, checkpoint).awaitTermination()
    stored, batch = spark.read.parquet(out), ingest.judge(ingest.read_tables(rows).persist())
    look = lambda d: sorted((r.fact_id, r.value, r.status) for r in d.select("fact_id", "value", "status").collect())
    assert look(stored) == look(batch) and len(look(batch)) == 10
    groups, flagged = ingest.settle(stored)
    # the two documents disagree on one company in both years
    assert groups.count() == 2 and flagged.where("status = 'conflicted'").count() == 4 and flagged.count() == 10


def test_statements_and_history_in_the_stream(spark, tmp_path):
    schema = "document_id string, table_id string, page int, row_idx int, col_idx int, text string, extraction_method string, text_layer_recognised boolean, fiscal_year string, publisher_entity_id string"
    monthly = spark.createDataFrame([("d1", "t", 1, r, c, t, "table_stream", True, None, "cil") for r, c, t in STATEMENT], schema)
    found = ingest.read_tables(monthly).collect()
    assert len(found) == 14 and {r.conf_parse for r in found} == {0.78} and all(0.8 <= r.conf_ocr <= 1 for r in found) and len({r.fact_id for r in found}) == 14
    out, source, checkpoint = (str(tmp_path / x) for x in ("out", "in", "check"))
    first = seed.demo_evidence(spark, "d2", rows=[("SECL", 100.0, 110.0)])
    first.write.parquet(source)
    ingest.ingest(spark, source, first.schema, out, checkpoint).awaitTermination()
    later = seed.demo_evidence(spark, "d3", rows=[("SECL", 300.0, 340.0)]).withColumn("text", F.replace(F.replace("text", F.lit("2024-25"), F.lit("2026-27")), F.lit("2023-24"), F.lit("2025-26")))
    later.unionByName(monthly).write.mode("append").parquet(source)
    ingest.ingest(spark, source, first.schema, out, checkpoint).awaitTermination()
    stored = {(r.document_id, r.fiscal_year, r.entity_id): (r.status, r.notes) for r in spark.read.parquet(out).where("document_id <> 'd1'").collect()}
    assert stored["d2", "FY2024-25", "secl"] == ("validated", None) and stored["d3", "FY2025-26", "secl"] == ("needs_review", "year_on_year_swing")  # only the stored year shows it
    assert spark.read.parquet(out).where("document_id = 'd1'").count() == 14


def test_seed(spark):
    df = seed.facts(spark, 60_000)
    assert df.select("entity_id").distinct().count() == 29 and df.select("metric").distinct().count() == 20 and df.where("period_end < period_start").count() == 0
