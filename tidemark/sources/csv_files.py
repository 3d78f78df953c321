"""CSV documents: a strict reader, header mapping, guarded exports.

Files are read whole, one row each (a quoted field can hold line ends), and parsed by a four-state machine in Arrow batches; a file is
the unit of parallel work, as its quoting can only be told from its start. Damaged files give one row with ``error`` set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Logical contact fields with the other header names they go by, in the order of the export, and the export's own names where they differ.
ALIASES = {
    "contact_id": ("id", "record_id", "hs_object_id"),
    "full_name": ("name", "contact_name", "contact_full_name", "person_name", "person_full_name"),
    "first_name": ("given_name", "contact_first_name"),
    "last_name": ("surname", "family_name", "contact_last_name"),
    "raw_email": ("email", "email_address", "work_email", "business_email", "contact_email", "primary_email"),
    "normalized_email": ("normalizedemail",),
    "company": ("company_name", "account", "account_name", "organization_name"),
    "phone": ("phone_number", "mobile_phone", "mobile", "business_phone", "work_phone", "contact_phone"),
    "job_title": ("jobtitle", "title", "position"),
    "website": ("website_url", "company_website", "account_website", "url"),
    "state": ("state_province", "mailing_state", "mailing_state_province", "province"),
    "region": ("territory", "sales_region"),
    "segment": ("market_segment", "company_segment"),
    "lifecycle_stage": ("lifecyclestage", "stage", "status"),
    "expected_lifecycle_stage": ("expected_stage", "target_stage"),
    "owner_id": ("hubspot_owner_id", "contact_owner_id", "sales_owner_id", "sales_owner"),
    "canonical_contact_id": ("canonical_id", "merged_into"),
    "record_status": ("recordstatus",),
    "last_action": ("lastaction",),
    "quality_flags": ("qualityflags", "issues", "flags"),
    "skip_reason": ("import_skip_reason",),
    "skipped_at": ("import_skipped_at",),
}
EXPORT_NAMES = {"raw_email": "email", "skip_reason": "import_skip_reason", "skipped_at": "import_skipped_at"}


class CsvError(ValueError):
    """A malformed document, with the row and column of the fault."""


def parse_strict(text: str) -> list[list[str]]:
    """Rows of cells. A byte-order mark is dropped; LF, CR and CRLF end rows; a quote may only open a cell; doubled quotes stand for one."""
    rows, row, cell, state = [], [], [], "start"  # start | plain | quoted | closed
    text = text.removeprefix("﻿")
    i, n = 0, len(text)

    def fail(why: str) -> None:
        raise CsvError(f"{why} in row {len(rows) + 1}, column {len(row) + 1}")

    while i < n:
        c = text[i]
        if state == "quoted":
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    cell.append('"')
                    i += 1
                else:
                    state = "closed"
            else:
                cell.append(c)
        elif c == ",":
            row.append("".join(cell))
            cell, state = [], "start"
        elif c in "\r\n":
            i += text.startswith("\r\n", i)
            rows.append([*row, "".join(cell)])
            row, cell, state = [], [], "start"
        elif c == '"':
            if state != "start":
                fail("a quote inside a cell" if state == "plain" else "text after a closing quote")
            state = "quoted"
        elif state == "closed":
            fail("text after a closing quote")
        else:
            cell.append(c)
            state = "plain"
        i += 1
    if state == "quoted":
        fail("a quote that is never closed")
    if row or cell or state != "start":
        rows.append([*row, "".join(cell)])
    return rows


TOKEN = re.compile(r'"|,|\r?\n|[^",\r\n]+|\r')


def parse_tolerant(text: str) -> list[list[str]]:
    """Rows of cells as a spreadsheet reads them: a quote anywhere begins or ends a quoted stretch, doubled ones in it stand for one, LF and CRLF end rows. CsvError for a quote that is never closed or a ragged row that isn't blank."""
    rows, row, cell, quoted, after = [], [], [], False, -1
    text = text.removeprefix("﻿")
    for m in TOKEN.finditer(text):
        t = m[0]
        if t == '"':
            if not quoted and after == m.start():  # the second of a pair inside quotes
                cell.append('"')
                quoted = True
            else:
                quoted = not quoted
                after = -1 if quoted else m.end()
        elif quoted:
            cell.append(t)
        elif t == ",":
            row.append("".join(cell))
            cell = []
        elif t.endswith("\n"):
            rows.append([*row, "".join(cell)])
            row, cell = [], []
        else:
            cell.append(t)
    if quoted:
        raise CsvError("a quote that is never closed")
    if cell or row:
        rows.append([*row, "".join(cell).removesuffix("\r")])
    for k, r in enumerate(rows[1:], 2):
        if len(r) != len(rows[0]) and any(x.strip() for x in r):
            raise CsvError(f"{len(r)} cells instead of {len(rows[0])} in row {k}")
    return rows


def checked(rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Normal headers and the rows that aren't blank; CsvError for repeated headers or ragged rows."""
    if not rows:
        raise CsvError("no header")
    head, body = rows[0], rows[1:]
    if len({h.strip().lower() for h in head}) < len(head):
        raise CsvError("a header is repeated")
    kept = []
    for k, r in enumerate(body, 2):
        if any(x.strip() for x in r):
            if len(r) != len(head):
                raise CsvError(f"{len(r)} cells instead of {len(head)} in row {k}")
            kept.append(r)
    return head, kept


def read_documents(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """(path, row_id, headers, cells, error) of all rows of the CSV files of a path."""
    parse = parse_tolerant if tolerant else parse_strict
    kinds = [("path", pa.string()), ("row_id", pa.int64()), ("headers", pa.list_(pa.string())), ("cells", pa.list_(pa.string())), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    head, rows = checked(parse(content.as_py().decode("utf-8")))
                    out = [(name, k, head, r, None) for k, r in enumerate(rows, 1)]
                except (CsvError, UnicodeDecodeError) as e:
                    out = [(name, None, None, None, str(e))]
                for at in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out[at : at + 10_000], strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row_id long, headers array<string>, cells array<string>, error string")


def suggest_mapping(headers: Sequence[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, str]:
    """logical field -> header: its own name before other names, and only where exactly one header fits."""
    normal = {h: re.sub("^_|_$", "", re.sub("[^a-z0-9]+", "_", h.strip().lower())) for h in headers}
    out = {}
    for field, others in aliases.items():
        own = [h for h, x in normal.items() if x == field]
        found = own or [h for h, x in normal.items() if x in others]
        if len(found) == 1:
            out[field] = found[0]
    return out


def preview(documents: DataFrame, rows: int = 5) -> DataFrame:
    """(path, n_rows, headers, first) of parsed documents: their first rows in order."""
    first = F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("row_id") <= rows, F.struct("row_id", "cells")))), 1, rows), lambda x: x["cells"])
    return documents.where("error IS NULL").groupBy("path").agg(F.count("*").alias("n_rows"), F.any_value("headers").alias("headers"), first.alias("first"))


def typed_contacts(documents: DataFrame, headers: Sequence[str], mapping: dict[str, str]) -> DataFrame:
    """Contacts of parsed rows under a mapping, with the defaults of missing fields, the flags that the file supplies, and row_fault: a contact id used before (repeated_id: with the row that had it first) or skip data that can't be (skip_data)."""
    at = {h: i for i, h in enumerate(headers)}
    cell = lambda f: T.trimmed(F.get("cells", F.lit(at[mapping[f]]))) if f in mapping else F.lit("")
    default = lambda f, v: F.when(cell(f) != "", cell(f)).otherwise(v)
    or_null = lambda f: F.when(cell(f) != "", cell(f))
    own_id = default("contact_id", F.concat(F.lit("CSV-"), F.lpad(F.col("row_id").cast("string"), 3, "0")))
    joined = F.concat_ws(" ", or_null("first_name"), or_null("last_name"))
    stage = T.stage(default("lifecycle_stage", F.lit("lead")))
    merged = F.lower(cell("record_status")) == "merged"
    skip = (cell("skip_reason") != "") | (cell("skipped_at") != "")
    valid_skip = ~merged & F.length(cell("skip_reason")).between(1, 500) & cell("skipped_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z$")
    rows = documents.where("error IS NULL").select(
        "path", "row_id", own_id.alias("contact_id"), F.when(cell("full_name") != "", cell("full_name")).when(joined != "", joined).otherwise(own_id).alias("full_name"), cell("first_name").alias("first_name"), cell("last_name").alias("last_name"),
        cell("raw_email").alias("raw_email"), T.email(default("normalized_email", cell("raw_email"))).alias("normalized_email"), cell("company").alias("company"), or_null("phone").alias("phone"), or_null("job_title").alias("job_title"), or_null("website").alias("website"), or_null("state").alias("state"),
        default("region", F.lit("Unassigned")).alias("region"), default("segment", F.lit("Unassigned")).alias("segment"), stage.alias("lifecycle_stage"), F.when(cell("expected_lifecycle_stage") != "", T.stage(cell("expected_lifecycle_stage"))).otherwise(stage).alias("expected_lifecycle_stage"),
        cell("owner_id").alias("owner_id"), or_null("canonical_contact_id").alias("canonical_contact_id"), F.when(merged, "merged").otherwise("active").alias("record_status"), default("last_action", F.lit("csv_imported")).alias("last_action"),
        T.flags(cell("quality_flags")).alias("quality_flags"), skip.alias("excluded"), or_null("skip_reason").alias("skip_reason"), or_null("skipped_at").alias("skipped_at"), (skip & ~valid_skip).alias("__bad"),
    )
    first = rows.groupBy("path", "contact_id").agg(F.min("row_id").alias("__first"))
    rows = rows.join(first, ["path", "contact_id"])
    fault = F.when(F.col("row_id") != F.col("__first"), F.concat(F.lit("repeated_id:"), F.col("__first").cast("string"))).when(F.col("__bad"), "skip_data")
    return rows.withColumn("row_fault", fault).drop("__first", "__bad")


def cleanup_proposals(documents: DataFrame, email_column: int | None = None) -> DataFrame:
    """(path, row_id, col, before, after) of every cell that trimming, or a normal email, would change."""
    rows = documents.where("error IS NULL").select("path", "row_id", F.posexplode("cells").alias("col", "before"))
    after = T.trimmed(F.col("before"))
    if email_column is not None:
        after = F.when(F.col("col") == email_column, F.coalesce(T.email(F.col("before")), after)).otherwise(after)
    return rows.withColumn("after", after).where("before <> after")


def review_groups(documents: DataFrame, email_column: int | None = None) -> DataFrame:
    """(path, kind, key, first, row_id) of rows of one file that a person should look at together, a row each: equal rows but for white space (kind row), and rows of one normal email that aren't all equal (kind email). key is a digest, first the group's smallest row id. Groups are counted, never gathered."""
    cells = F.transform("cells", lambda c: T.trimmed(c))
    rows = documents.where("error IS NULL").select("path", "row_id", F.sha2(F.to_json(cells), 256).alias("whole"), (T.email(F.get("cells", F.lit(email_column))) if email_column is not None else F.lit(None).cast("string")).alias("e"))
    marks = rows.select("path", "row_id", "whole", F.explode(F.array_compact(F.array(F.struct(F.lit("row").alias("kind"), F.col("whole").alias("key")), F.when(F.col("e").isNotNull(), F.struct(F.lit("email").alias("kind"), F.sha2("e", 256).alias("key")))))).alias("m")).select("path", "row_id", "whole", "m.*")
    sizes = marks.groupBy("path", "kind", "key").agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("differ"), F.min("row_id").alias("first"))
    sizes = sizes.where(((F.col("kind") == "row") & (F.col("n") > 1)) | ((F.col("kind") == "email") & F.col("differ")))
    return marks.join(sizes, ["path", "kind", "key"]).select("path", "kind", "key", "first", "row_id")


def _quoted(cell: Column) -> Column:
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_lines(df: DataFrame, columns: Sequence[str], guard: bool = True) -> DataFrame:
    """One CSV line per row (column line), cells that a spreadsheet would run guarded, and how many were. A lone empty cell is quoted, since a bare one would be no row."""
    cells = [F.coalesce(F.array_join(c, "|") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string"), F.lit("")) for c in columns]
    safe = [T.formula_guard(c) if guard else c for c in cells]
    escaped = sum((s != c).cast("int") for s, c in zip(safe, cells, strict=True))
    line = F.concat_ws(",", *map(_quoted, safe))
    return df.select((F.when(line == "", '""').otherwise(line) if len(columns) == 1 else line).alias("line"), escaped.alias("guarded"))


def export_contacts(df: DataFrame) -> DataFrame:
    """The contact export's lines: all fields of ALIASES in order (missing ones empty), flags joined, no guard, since a later import must read what was there."""
    empty = F.lit("")
    out = df.select(*(F.col(c) if c in df.columns else empty.alias(c) for c in ALIASES))
    return csv_lines(out, tuple(ALIASES), guard=False).select("line")


def export_header() -> str:
    return ",".join(EXPORT_NAMES.get(c, c) for c in ALIASES)


def write_lines(lines: DataFrame, path: str, header: str, crlf: bool = False) -> None:
    """Lines (a column line) as text files of a path, each with the header first; documents end their rows with CRLF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    lines.select("line").mapInArrow(run, "value string").write.mode("errorifexists").option("lineSep", "\r\n" if crlf else "\n").text(path)


def audit_markdown(row: dict[str, object], title: str = "Contact audit") -> str:
    """A one-row report as Markdown."""
    return "\n".join([f"# {title}", "", "| measure | value |", "| --- | ---: |", *(f"| {k} | {v} |" for k, v in row.items()), ""])


REVISIONS = 20


def save_revision(df: DataFrame, root: str, revision: int, keep: int = REVISIONS) -> str:
    """A new revision beside the older ones, of which the newest stay; readers switch by path."""
    path = f"{root}/revision={revision:08d}"
    df.write.mode("errorifexists").parquet(path)
    jvm = df.sparkSession._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    found = sorted((f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("revision=")), key=lambda p: p.getName())
    for old in found[: max(0, len(found) - keep)]:
        fs.delete(old, True)
    return path
