"""Report templates, lifecycle, and what is read from a stored manifest: pinned figures are rendered, never recomputed."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, periods, text
from ..functions.text import new_id
from ..scope import Scope, scoped


@dataclass(frozen=True)
class Template:
    name: str
    title: str
    required: tuple[tuple[str, str, str], ...]  # metric, entity, period; {{key}} is filled from the context
    optional: tuple[tuple[str, str, str], ...] = ()
    version: int = 1
    sections: tuple[str, ...] = field(default=("figures", "sources"))
    prompts: tuple[tuple[str, str], ...] = ()  # title, prompt of the sections that a model writes

    @classmethod
    def load(cls, text: str) -> Template:
        """From JSON, or from YAML of plain mappings, lists and scalars: id, title, version, required and optional fields, sections."""
        spec = json.loads(text) if text.lstrip().startswith("{") else plain_yaml(text)
        rows = lambda key: tuple(tuple(f[k] for k in ("metric", "entity", "period")) for f in spec.get(key) or [])
        sections = tuple(x["kind"] if isinstance(x, dict) else x for x in spec.get("sections") or ("figures", "sources"))
        prompts = tuple((x["title"], x["prompt"]) for x in spec.get("sections") or () if isinstance(x, dict) and x.get("prompt"))
        return cls(spec.get("id") or spec["name"], spec["title"], rows("required"), rows("optional"), int(spec.get("version", 1)), sections, prompts)


def plain_yaml(text: str):
    """The value of a YAML text that has only block mappings, block lists, scalars and comments."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]

    def scalar(x: str):
        if quoted := re.match(r"""(["'])(.*?)\1(?:\s+#.*)?$""", x):
            return quoted[2]
        x = x.split(" #")[0].strip()
        return {"null": None, "~": None, "": None, "true": True, "false": False}.get(x, int(x) if x.lstrip("-").isdigit() else x)

    def block(at: int, indent: int):
        out = [] if lines[at][1].startswith("-") else {}
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            if isinstance(out, list):
                body = line[1:].strip()
                if ":" in body and not body.startswith(("'", '"')):  # a mapping that begins beside its dash
                    lines[at] = (indent + 2, body)
                    value, at = block(at, indent + 2)
                    out.append(value)
                else:
                    out.append(scalar(body))
                    at += 1
                continue
            key, _, rest = line.partition(":")
            at += 1
            if rest.strip() or at == len(lines) or lines[at][0] < indent or lines[at][0] == indent and not lines[at][1].startswith("-"):
                out[key.strip()] = scalar(rest.strip())
            else:
                out[key.strip()], at = block(at, lines[at][0])
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def _template(name: str, title: str, required: tuple[str, ...], optional: tuple[str, ...], sections: tuple[str, ...], *prompts: tuple[str, str]) -> Template:
    of = lambda metrics: tuple((m, "{{entity}}", "{{period}}") for m in metrics)
    return Template(name, title, of(required), of(optional), 1, sections, prompts)


TEMPLATES = {
    t.name: t
    for t in (
        _template("production-summary", "Production, {{entity_name}}, {{period}}", ("coal_production",), ("coal_offtake", "overburden_removal"), ("figures", "narrative", "sources"), ("Summary", "Sum up the figures of the period.")),
        _template("parliamentary-response", "Reply, {{entity_name}}, {{period}}", ("coal_production", "coal_offtake"), ("overburden_removal",), ("narrative", "figures", "sources"), ("Reply", "State what was produced and taken off, without causes.")),
    )
}


def contexts(asked: DataFrame) -> DataFrame:
    """``asked``: entity, period as written. Adds entity_id, entity_name, entity_code, period_label, and what is unknown of them."""
    who = names.lookup(asked, "entity").select(F.col("raw").alias("entity"), F.col("id").alias("entity_id"))
    when = periods.lookup(asked, "period").select(F.col("raw").alias("period"), F.col("label").alias("period_label"))
    rows = asked.join(who, "entity", "left").join(when, "period", "left")
    full = F.element_at(F.create_map(*[F.lit(x) for e in names.ENTITIES for x in (e.entity_id, e.name)]), F.col("entity_id"))
    fault = F.when(F.col("entity_id").isNull(), "unknown entity").when(F.col("period_label").isNull(), "unknown period")
    return rows.withColumns({"entity_name": full, "entity_code": names.code_of(F.col("entity_id")), "fault": fault})


# What a report's state may become, and the least role for it.
MOVES = {("draft", "in_review"): "officer", ("in_review", "draft"): "reviewer", ("in_review", "approved"): "approver", ("approved", "in_review"): "approver", ("approved", "published"): "approver"}
ROLES = ("viewer", "officer", "reviewer", "approver", "admin")


def fill(text: str, context: dict[str, str]) -> str:
    for key, value in context.items():
        text = text.replace("{{" + key + "}}", value)
    return text


def fields(spark: SparkSession, template: Template, context: dict[str, str]) -> DataFrame:
    """entity_id, metric, period_label, required, position of every field: what ``resolve.pin`` takes."""
    rows = [(fill(e, context), m, fill(p, context), need, i) for i, (m, e, p, need) in enumerate([*((*f, True) for f in template.required), *((*f, False) for f in template.optional)])]
    return spark.createDataFrame(rows, "entity_id string, metric string, period_label string, required boolean, position int")


def move(reports: DataFrame, moves: DataFrame, four_eyes: bool = True) -> DataFrame:
    """Reports after ``moves``: report_id, seq, target, role, actor, at; one for each report, the first. ``refusal`` says why a move
    was refused: illegal, incomplete (to be approved or published), role, own (approval of one's own report), in this order."""
    first = moves.groupBy("report_id").agg(F.min_by(F.struct("target", "role", "actor", "at"), "seq").alias("_m"))
    rows = reports.join(first, "report_id", "left")
    target, ranks = F.col("_m.target"), {r: i for i, r in enumerate(ROLES)}
    known = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    needed = F.element_at(known({f"{a}>{b}": ranks[r] for (a, b), r in MOVES.items()}), F.concat_ws(">", "state", "_m.target"))
    refusal = (
        F.when(target.isNull(), None).when(needed.isNull(), "illegal").when(target.isin("approved", "published") & ~F.col("complete"), "incomplete")
        .when(F.coalesce(F.element_at(known(ranks), F.col("_m.role")), F.lit(-1)) < needed, "role")
        .when(F.lit(four_eyes) & (target == "approved") & F.col("_m.actor").eqNullSafe(F.col("author")), "own")
    )
    rows = rows.withColumn("refusal", refusal)
    done = F.col("_m.target").isNotNull() & F.col("refusal").isNull()
    stamp = lambda c, new: F.when(done & (target == "approved"), new).when(done & (target != "published"), None).otherwise(F.col(c))
    new = {"approved_by": stamp("approved_by", F.col("_m.actor")), "approved_at": stamp("approved_at", F.col("_m.at"))}
    new["published_at"] = F.when(done & (target == "published"), F.col("_m.at")).otherwise(F.col("published_at"))
    return rows.withColumns(new | {"state": F.when(done, target).otherwise(F.col("state"))}).drop("_m")


STATES = ("draft", "in_review", "approved", "published")
_FIGURES = "array<struct<position:int,entity_id:string,metric:string,period_label:string,required:boolean,reason:string,fact_id:string,value:double,unit:string,document_id:string>>"


def create(manifests: DataFrame, author: str, at: str, template: str = "", version: int = 1) -> DataFrame:
    """Draft reports of ``manifests``: report_key and the rows of ``resolve.pin`` (with required, position), a report for each key. The
    figures are kept as they are pinned."""
    named = [f.split(":")[0] for f in _FIGURES[len("array<struct<") : -2].split(",")]
    missing = [c for c in named if c not in manifests.columns]
    if missing:
        raise ValueError(f"a manifest needs {', '.join(missing)}")
    figures = F.array_sort(F.collect_list(F.struct(*named)))
    rows = manifests.groupBy("report_key").agg(figures.cast(_FIGURES).alias("_f"))
    whole = ~F.exists("_f", lambda f: f["required"] & f["reason"].isNotNull())
    none = F.lit(None)
    return rows.select(
        new_id("rep_", F.col("report_key"), F.lit(template), F.lit(at)).alias("report_id"), "report_key", F.lit(template).alias("template_id"), F.lit(version).alias("template_version"), F.lit("draft").alias("state"),
        F.lit(author).alias("author"), F.lit(at).cast("timestamp").alias("generated_at"), whole.alias("complete"), F.to_json("_f").alias("manifest"), none.cast("string").alias("approved_by"), none.cast("timestamp").alias("approved_at"), none.cast("timestamp").alias("published_at"),
    )


def reproduce(reports: DataFrame) -> DataFrame:
    """The figures of stored reports, from their manifests alone: report_id and a row for each figure."""
    return reports.select("report_id", F.inline(F.from_json("manifest", _FIGURES)))


def listed(reports: DataFrame, scope: Scope, state: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """The newest reports that the scope may see."""
    rows = scoped(reports, scope)
    rows = rows if state is None else rows.where(F.col("state") == state)
    return rows.orderBy(F.desc("generated_at"), "report_id").offset(offset).limit(limit)


def narrated(prose: DataFrame, figures: DataFrame) -> DataFrame:
    """``prose``: report_id, title, text of the sections that a model wrote; ``figures``: report_id, value. Sentences with numbers that no
    figure supports are left out; flagged tells whether any was."""
    allowed = figures.where("value is not null").groupBy("report_id").agg(F.collect_set("value").alias("_a"))
    rows = prose.join(allowed, "report_id", "left").withColumn("_a", F.coalesce("_a", F.array().cast("array<double>")))
    kept = text.verified(F.col("text"), F.col("_a"))
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.select("report_id", "title", kept.alias("text"), (F.regexp_replace(kept, r"\s+", " ") != squeezed).alias("flagged"))


def markdown(title: str, manifest: DataFrame) -> str:
    """A report's text from its (small) manifest; refused if a required figure is missing."""
    rows = sorted(manifest.collect(), key=lambda r: r.position)  # a row for each field of a template
    if any(r.required and r.reason for r in rows):
        raise ValueError("required figures are missing")
    label = lambda key: next((m.label for m in names.METRICS if m.key == key), key)
    out = [f"# {title}", "", "| Measure | Entity | Period | Value | Unit | Source |", "| --- | --- | --- | --- | --- | --- |"]
    out += [f"| {label(r.metric)} | {r.entity_id} | {r.period_label} | {r.value:,.2f} | {r.unit} | {r.document_id} |" for r in rows if not r.reason]
    out += ["", "Not available: " + ", ".join(f"{label(r.metric)} ({r.reason})" for r in rows if r.reason)] if any(r.reason for r in rows) else []
    return "\n".join([*out, "", "Sources: " + ", ".join(sorted({r.document_id for r in rows if not r.reason}))]) + "\n"
