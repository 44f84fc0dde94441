"""Report files of bounded size: a workbook, its reader and a document, as zipped XML parts written on the driver.

A report is for people: ``MOST_ROWS`` rows at most, more are an error. All parts that decide what
stands in it are DataFrame operations; only the finished rows come to the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.operators.reports import reviewed, summary
from postlode.operators.sinks import read_bytes, write_bytes

MOST_ROWS = 50_000
#: Most characters of a cell, as the file format has it.
CELL = 32_767

#: Column of a presenter row, its head in the workbook.
WORKBOOK_COLUMNS = (
    ("search_run_at", "Search Run Timestamp"), ("score", "Score"), ("title_fit_score", "Title Fit"), ("seniority_fit_score", "Seniority Fit"),
    ("remote_fit_score", "Remote Fit"), ("skill_fit_score", "Skill Fit"), ("geography_fit_score", "Geo Fit"), ("compensation_fit_score", "Comp / Hours Fit"),
    ("company_fit_score", "Company Signal Fit"), ("penalty_score", "Penalty"), ("priority", "Priority"), ("title", "Job Title"), ("company", "Company"),
    ("company_fit", "Company Type"), ("company_size", "Company Size"), ("company_size_source", "Company Size Source"), ("location", "Location"), ("city", "City"),
    ("country", "Country"), ("region", "Region"), ("remote_type", "Remote / Hybrid / Onsite"), ("seniority", "Level"), ("salary", "Potential Compensation"),
    ("salary_found", "Compensation Found?"), ("salary_target_met", "Compensation >= 50k/year or >= 4,200 gross/month?"), ("hours_found", "Working Hours Found?"),
    ("hours_target_met", "Working Hours <= 36h/week?"), ("salary_hour_notes", "Compensation / Hours Notes"), ("skills", "Required Skills"),
    ("description", "Requirements / Short Description"), ("source", "Source"), ("url", "Job Posting Link"), ("reason", "Why This Job Matches"), ("date_found", "Date Found"),
    ("date_posted", "Date Posted"), ("status", "Status"), ("interesting", "Interesting?"), ("applied", "Applied?"), ("next_step", "Next Step"),
    ("review_notes", "Review Notes"), ("dismissed", "Dismissed?"),
)

#: The overview's columns and heads.
OVERVIEW_COLUMNS = (
    ("score", "Score"), ("priority", "Priority"), ("status", "Status"), ("title", "Job Title"), ("company", "Company"), ("company_fit", "Company Type"),
    ("company_size", "Company Size"), ("city", "City"), ("country", "Country"), ("location", "Location"), ("remote_type", "Remote"), ("salary", "Compensation"),
    ("skills", "Skills"), ("url", "Link"), ("dismissed", "Dismissed?"),
)

#: Columns that a reviewed workbook must have, and those that it may have.
REQUIRED = (
    "search_run_at score priority title company location remote_type salary salary_target_met hours_target_met salary_hour_notes skills description url reason dismissed"
).split()
OPTIONAL = "company_fit company_size company_size_source city country status interesting next_step review_notes".split()
#: Columns that the document's presenter expects besides; empty where a workbook has none.
DEFAULTED = "source date_found date_posted status country region seniority".split()

DETAILS, OVERVIEW = "Job Details", "Overview"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _plain(value: object) -> str:
    """Text without characters that XML cannot hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", "" if value is None else str(value))


def bounded(rows: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """The rows of a report on the driver, in their order."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has {most} rows at most; filter it or export CSV")
    return [r.asDict() for r in got]


def letters(column: int) -> str:
    """A column's name, from 1: A, B, ..., Z, AA."""
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(row: int, column: int, value: object, style: int) -> str:
    at = f'r="{letters(column)}{row}" s="{style}"'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c {at}><v>{value}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_plain(value)[:CELL])}</t></is></c>'


def _row(number: int, values: Iterable[object], style: int = 0) -> str:
    return f'<row r="{number}">{"".join(_cell(number, i, v, style) for i, v in enumerate(values, 1))}</row>'


def _sheet(rows: list[str], head: int, last: int, columns: int, score: str, status: str, gone: str, yes_no: Iterable[str], widths: Iterable[int]) -> str:
    """A sheet with a frozen head, score bands, lists of choices, and struck rows where ``gone`` or ``status`` says so."""
    first, end = head + 1, max(head + 1, last)
    span = lambda a, b="": f"{a}{first}:{b or a}{end}"
    band = lambda at, style, order, rule: f'<conditionalFormatting sqref="{at}"><cfRule dxfId="{style}" priority="{order}" {rule}</cfRule></conditionalFormatting>'
    rule = f'OR(${gone}{first}="yes",${status}{first}="dismissed")'
    bands = band(span(score), 0, 1, 'type="cellIs" operator="greaterThanOrEqual"><formula>80</formula>')
    bands += band(span(score), 1, 2, 'type="cellIs" operator="between"><formula>60</formula><formula>79</formula>')
    bands += band(span("A", letters(columns)), 2, 3, f'type="expression"><formula>{escape(rule)}</formula>')
    choices = [(span(status), "new,shortlist,applied,interview,dismissed"), *[(span(c), "no,yes") for c in (*yes_no, gone)]]
    checks = "".join(f'<dataValidation type="list" allowBlank="1" sqref="{at}"><formula1>"{x}"</formula1></dataValidation>' for at, x in choices)
    return (
        f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0" showGridLines="0"><pane ySplit="{head}" topLeftCell="A{first}" '
        f'activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>'
        + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
        + f'</cols><sheetData>{"".join(rows)}</sheetData><autoFilter ref="A{head}:{letters(columns)}{max(head, last)}"/>{bands}'
        f'<dataValidations count="{len(choices)}">{checks}</dataValidations></worksheet>'
    )


_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="3"><font/><font><b/><color rgb="FFFFFFFF"/></font><font><b/><sz val="20"/></font></fonts>'
    '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FF1F4E79"/></patternFill></fill></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf>'
    '<xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fontId="2" applyFont="1"/></cellXfs><dxfs count="3">'
    + "".join(f'<dxf>{font}<fill><patternFill><bgColor rgb="FF{c}"/></patternFill></fill></dxf>' for font, c in (("", "C6EFCE"), ("", "FFEB9C"), ("<font><strike/></font>", "F2F2F2")))
    + "</dxfs></styleSheet>"
)


def _package(main: str, parts: dict[str, tuple[str, str]], links: dict[str, list[tuple[str, str]]]) -> bytes:
    """An office file: ``parts`` by name with (content type, content); ``links`` by part: (relation, target)."""
    types = "".join(f'<Override PartName="/{n}" ContentType={quoteattr(t)}/>' for n, (t, _) in parts.items())
    known = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    related = lambda some: f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">' + "".join(
        f'<Relationship Id="rId{i}" Type="{_REL}/{t}" Target="{to}"/>' for i, (t, to) in enumerate(some, 1)
    ) + "</Relationships>"
    files = {"[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACK}/content-types">{known}{types}</Types>', "_rels/.rels": related([("officeDocument", main)])}
    for part, some in links.items():
        folder, name = part.rsplit("/", 1)
        files[f"{folder}/_rels/{name}.rels"] = related(some)
    files |= {n: content for n, (_, content) in parts.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _counts(records: DataFrame) -> list[tuple[str, object]]:
    s = summary(records).first()
    return [
        ("Exported Jobs", s.exported), ("Average Score", s.average_score), ("Urgent / High", f"{s.urgent} / {s.high}"),
        ("Compensation Target Met", s.salary_target), ("Hours Target Met", s.hours_target),
    ]


def write_workbook(records: DataFrame, path: str) -> None:
    """Presenter rows as a workbook: an overview with counts, and all columns (K2)."""
    rows = bounded(records)
    names = [n for n, _ in WORKBOOK_COLUMNS]
    at = lambda name: letters(names.index(name) + 1)
    over = [_row(1, ["Postings Export"], 2)] + [_row(i, pair) for i, pair in enumerate(_counts(records), 3)]
    over += [_row(9, [h for _, h in OVERVIEW_COLUMNS], 1)] + [_row(i, [r[n] for n, _ in OVERVIEW_COLUMNS]) for i, r in enumerate(rows, 10)]
    all_ = [_row(1, [h for _, h in WORKBOOK_COLUMNS], 1)] + [_row(i, [r[n] for n in names]) for i, r in enumerate(rows, 2)]
    wide = {"title": 34, "description": 70, "url": 58, "reason": 52, "skills": 44, "review_notes": 36, "salary_hour_notes": 36, "location": 30}
    sheets = [
        _sheet(over, 9, 9 + len(rows), len(OVERVIEW_COLUMNS), "A", "C", letters(len(OVERVIEW_COLUMNS)), (), [wide.get(n, 16) for n, _ in OVERVIEW_COLUMNS]),
        _sheet(all_, 1, 1 + len(rows), len(names), at("score"), at("status"), at("dismissed"), (at("interesting"), at("applied")), [wide.get(n, 16) for n in names]),
    ]
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate((OVERVIEW, DETAILS), 1))
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    parts = {"xl/workbook.xml": (kind + "sheet.main+xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')}
    parts |= {f"xl/worksheets/sheet{i}.xml": (kind + "worksheet+xml", s) for i, s in enumerate(sheets, 1)}
    parts["xl/styles.xml"] = (kind + "styles+xml", _STYLES)
    links = {"xl/workbook.xml": [("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml"), ("styles", "styles.xml")]}
    write_bytes(records.sparkSession, path, _package("xl/workbook.xml", parts, links))


def _cells(content: bytes, sheet: str) -> list[list[str]]:
    """A sheet's cells as text; those left out are empty."""
    tag = lambda n: f"{{{_MAIN}}}{n}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        found = {s.get("name"): s.get(f"{{{_REL}}}id") for s in book.iter(tag("sheet"))}
        if sheet not in found:
            raise ValueError(f"the workbook has no sheet {sheet!r}")
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(x.get("Target") for x in links if x.get("Id") == found[sheet])
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in x.iter(tag("t"))) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))]
        root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in root.iter(tag("row")):
        values: dict[int, str] = {}
        for c in row.iter(tag("c")):
            at = 0
            for letter in re.match("[A-Z]+", c.get("r"))[0]:
                at = 26 * at + ord(letter) - 64
            text = "".join(t.text or "" for t in c.iter(tag("t"))) if c.get("t") == "inlineStr" else (c.findtext(tag("v")) or "")
            values[at] = shared[int(text)] if c.get("t") == "s" else text
        rows.append([values.get(i, "") for i in range(1, max(values, default=0) + 1)])
    return rows


def read_reviewed(spark: SparkSession, path: str, include_dismissed: bool = False) -> DataFrame:
    """Rows of an edited workbook with ``_seq``, without dismissed ones and too large companies."""
    head, *body = _cells(read_bytes(spark, path), DETAILS) or [[]]
    place = {h.strip(): i for i, h in enumerate(head)}
    heads = dict(WORKBOOK_COLUMNS)
    missing = [heads[n] for n in REQUIRED if heads[n] not in place]
    if missing:
        raise ValueError(f"the workbook lacks columns: {', '.join(missing)}")
    names = [n for n in (*REQUIRED, *OPTIONAL) if heads[n] in place]
    cell = lambda row, n: row[place[heads[n]]] if place[heads[n]] < len(row) else ""
    rows = [(i, *[cell(row, n) for n in names]) for i, row in enumerate(body)]
    read = spark.createDataFrame(rows, "_seq bigint, " + ", ".join(f"{n} string" for n in names))
    absent = [n for n in dict.fromkeys((*OPTIONAL, *DEFAULTED)) if n not in names]
    read = read.withColumns({n: F.lit("") for n in absent}).withColumn("score", F.col("score").try_cast("int"))
    return reviewed(read, include_dismissed)


def _paragraph(text: object, bold: bool = False, size: int = 0, style: str = "", centred: bool = False) -> str:
    looks = (f'<w:pStyle w:val="{style}"/>' if style else "") + ('<w:jc w:val="center"/>' if centred else "")
    marks = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{2 * size}"/>' if size else "")
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in _plain(text).split("\n"))
    return f"<w:p><w:pPr>{looks}</w:pPr><w:r><w:rPr>{marks}</w:rPr>{lines}</w:r></w:p>"


def _table(rows: list[list[str]]) -> str:
    sides = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    body = "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    return f"<w:tbl><w:tblPr><w:tblBorders>{sides}</w:tblBorders></w:tblPr>{body}</w:tbl>"


#: A card's lines; those marked are left out where they are empty.
_CARD = (
    ("Search run", "search_run_at", False), ("Status", "status", False), ("Company type", "company_fit", False), ("Company size", "company_size", False),
    ("City / Country", "_place", False), ("Link", "url", False), ("Compensation", "_pay", False), ("Skills", "skills", False), ("Next step", "next_step", True),
    ("Review notes", "review_notes", True), ("Why it matches", "reason", False), ("Description", "description", False),
)


def write_document(records: DataFrame, path: str, today: str = "") -> None:
    """Presenter rows, or reviewed ones, as a document: title, counts and a card a posting (K3)."""
    rows = bounded(records)
    s = summary(records).first()
    run = rows[0]["search_run_at"] if rows else today
    heads = (("Jobs", s.exported), ("Average Score", s.average_score), ("Urgent/High", f"{s.urgent}/{s.high}"), ("Salary OK", s.salary_target), ("Hours OK", s.hours_target))
    body = [_paragraph("Postings Report", True, 20, centred=True), _paragraph(f"{len(rows)} exported postings - search run: {run}", size=10, centred=True)]
    body += [_table([[_paragraph(f"{h}\n{v}", True, centred=True) for h, v in heads]]), _paragraph("")]
    if not rows:
        body.append(_paragraph("No postings were exported for the current filters."))
    for i, r in enumerate(rows, 1):
        r = r | {"_place": f"{r['city'] or 'Unknown'} / {r['country'] or 'Unknown'}", "_pay": f"{r['salary']} ({r['salary_hour_notes']})"}
        body += [_paragraph(f"{i}. {r['title']}", True, style="Heading2"), _paragraph(f"{r['company']} - {r['location']} - {r['remote_type']} - Score {r['score']}", True)]
        lines = [(label, r[n]) for label, n, optional in _CARD if r[n] or not optional]
        body += [_table([[_paragraph(label, True), _paragraph(value or "Unknown")] for label, value in lines]), _paragraph("")]
    styles = f'{_HEAD}<w:styles xmlns:w="{_WORD}"><w:style w:type="paragraph" w:styleId="Heading2"><w:name w:val="heading 2"/><w:rPr><w:b/><w:sz w:val="26"/></w:rPr></w:style></w:styles>'
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    parts = {
        "word/document.xml": (kind + "document.main+xml", f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body>{"".join(body)}</w:body></w:document>'),
        "word/styles.xml": (kind + "styles+xml", styles),
    }
    write_bytes(records.sparkSession, path, _package("word/document.xml", parts, {"word/document.xml": [("styles", "styles.xml")]}))
