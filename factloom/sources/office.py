"""Reports as office files, by the standard library: each is a ZIP archive of XML made from a report's (small) rows."""

from __future__ import annotations

import io
import zipfile
from typing import NamedTuple
from xml.sax.saxutils import escape

MAIN = "http://schemas.openxmlformats.org"
HEAD = ("Measure", "Entity", "Period", "Value", "Unit", "Source")


class Figure(NamedTuple):
    measure: str
    entity: str
    period: str
    value: float | None
    unit: str | None
    source: str | None
    required: bool = True
    reason: str | None = None


def _checked(figures: list[Figure]) -> list[Figure]:
    if any(f.required and f.reason for f in figures):
        raise ValueError("required figures are missing")
    return [f for f in figures if not f.reason]


def _archive(kind: str, main: str, parts: dict[str, str]) -> bytes:
    """A package whose main part is ``main``; content types follow from the parts' folders."""
    types = {name: kind_of for name, (_, kind_of) in parts.items()}
    override = "".join(f'<Override PartName="/{name}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for name, t in types.items() if t)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{MAIN}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{override}</Types>')
        z.writestr("_rels/.rels", _links([("officeDocument", main)]))
        for name, (content, _) in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def _links(targets: list[tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id="rId{i}" Type="{MAIN}/officeDocument/2006/relationships/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(targets, 1))
    return f'<Relationships xmlns="{MAIN}/package/2006/relationships">{rows}</Relationships>'


def _rows(figures: list[Figure]) -> list[list]:
    return [list(HEAD), *([f.measure, f.entity, f.period, f.value, f.unit, f.source] for f in figures)]


def workbook(title: str, figures: list[Figure], about: dict[str, str]) -> bytes:
    """Sheets Figures, Sources and About."""
    kept = _checked(figures)
    sources = sorted({f.source for f in kept if f.source})
    sheets = {"Figures": _rows(kept), "Sources": [["Document"], *([s] for s in sources)], "About": [["Title", title], *map(list, about.items())]}

    def cell(x, ref: str) -> str:
        if isinstance(x, (int, float)):
            return f'<c r="{ref}"><v>{x!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(x or ""))}</t></is></c>'

    sheet = lambda rows: f'<worksheet xmlns="{MAIN}/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{r}">' + "".join(cell(x, f"{chr(64 + c)}{r}") for c, x in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>"
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    parts = {"xl/workbook.xml": (f'<workbook xmlns="{MAIN}/spreadsheetml/2006/main" xmlns:r="{MAIN}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>', "spreadsheetml.sheet.main")}
    parts["xl/_rels/workbook.xml.rels"] = (_links([("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)]), "")
    parts |= {f"xl/worksheets/sheet{i}.xml": (sheet(rows), "spreadsheetml.worksheet") for i, rows in enumerate(sheets.values(), 1)}
    return _archive("xlsx", "xl/workbook.xml", parts)


def document(title: str, figures: list[Figure], sections: dict[str, str] | None = None) -> bytes:
    """Title, prose sections, the table of figures, and the sources."""
    kept = _checked(figures)
    p = lambda x: f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
    shown = lambda x: f"{x:,.2f}" if isinstance(x, float) else str(x or "")
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(shown(x))}</w:tc>" for x in row) + "</w:tr>" for row in _rows(kept)) + "</w:tbl>"
    prose = "".join(p(name) + p(body) for name, body in (sections or {}).items())
    sources = p("Sources: " + ", ".join(sorted({f.source for f in kept if f.source})))
    body = f'<w:document xmlns:w="{MAIN}/wordprocessingml/2006/main"><w:body>{p(title)}{prose}{table}{sources}</w:body></w:document>'
    return _archive("docx", "word/document.xml", {"word/document.xml": (body, "wordprocessingml.document.main")})


def slides(title: str, figures: list[Figure], per_slide: int = 8) -> bytes:
    """A title slide, then the figures, some on each slide."""
    kept = _checked(figures)
    lines = [f"{f.measure}, {f.entity}, {f.period}: {f.value:,.2f} {f.unit} ({f.source})" for f in kept]
    pages = [[title], *(lines[i : i + per_slide] for i in range(0, len(lines), per_slide))]
    space = f'xmlns:a="{MAIN}/drawingml/2006/main" xmlns:p="{MAIN}/presentationml/2006/main" xmlns:r="{MAIN}/officeDocument/2006/relationships"'
    group = "<p:nvGrpSpPr><p:cNvPr id=\"1\" name=\"\"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>"
    text = lambda xs: "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in xs)
    shape = lambda xs: f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="text"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="500000" y="500000"/><a:ext cx="8000000" cy="5500000"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/>{text(xs)}</p:txBody></p:sp>'
    slide = lambda xs: f"<p:sld {space}><p:cSld><p:spTree>{group}{shape(xs)}</p:spTree></p:cSld></p:sld>"
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(pages) + 1))
    parts = {"ppt/presentation.xml": (f'<p:presentation {space}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>', "presentationml.presentation.main")}
    parts["ppt/_rels/presentation.xml.rels"] = (_links([("slide", f"slides/slide{i}.xml") for i in range(1, len(pages) + 1)]), "")
    parts |= {f"ppt/slides/slide{i}.xml": (slide(xs), "presentationml.slide") for i, xs in enumerate(pages, 1)}
    return _archive("pptx", "ppt/presentation.xml", parts)
