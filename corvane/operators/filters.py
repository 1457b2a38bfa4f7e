"""Metadata filters: equality and list filters, number and time comparisons, all as one Column.

A filter that names a field that a row lacks is false, as is one whose stored value can't be
read; literals that can't be read are an error when the filter is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, trim_controls

LIST, NUMBER, TIME = ("EQ", "IN"), ("GT", "GTE", "LT", "LTE"), ("BEFORE", "AFTER")
KEY = re.compile(r"[A-Za-z0-9_.]+")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class FilterPlan:
    """Checked filters: equals by field, and comparisons as (field, op, literal)."""

    equals: dict[str, tuple[str, ...]] = field(default_factory=dict)
    compares: tuple[tuple[str, str, object], ...] = ()

    @property
    def empty(self) -> bool:
        return not self.equals and not self.compares

    @property
    def early(self) -> bool:
        """Whether some of it is equality, which stores can apply while they search."""
        return bool(self.equals)

    @property
    def late(self) -> bool:
        """Whether some of it is comparison, which holds only after rows are loaded."""
        return bool(self.compares)


def _flat(value: object) -> list[str]:
    if isinstance(value, (list, tuple, set, frozenset)):
        return [x for v in value for x in _flat(v)]
    return [str(value).strip()] if value is not None and str(value).strip() else []


def parse_instant(text: str) -> datetime:
    """An instant from a date-time with or without offset, a date, or milliseconds since 1970."""
    s = text.strip()
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d(:\d\d)?)?", s):
        s = re.sub(r"(\.\d{6})\d+", r"\1", s)
        t = datetime.fromisoformat(s)
        return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    if re.fullmatch(r"\d{4}-\d\d-\d\d", s):
        return datetime.combine(date.fromisoformat(s), datetime.min.time(), timezone.utc)
    if re.fullmatch(r"[+-]?\d{1,18}", s):
        return datetime.fromtimestamp(int(s) / 1000, timezone.utc)
    raise ValueError(f"not a date, a time or milliseconds: {text!r}")


def build_plan(equals: Mapping[str, object] | None = None, conditions: Iterable[Condition] = ()) -> FilterPlan:
    """Checks and normalises filters; raises ValueError for what can't be one."""
    merged: dict[str, list[str]] = {}
    compares = []

    def key(name: str) -> str:
        name = (name or "").strip()
        if not KEY.fullmatch(name):
            raise ValueError(f"not a metadata field: {name!r}")
        return name

    for name, value in (equals or {}).items():
        if values := _flat(value):
            merged.setdefault(key(name), []).extend(values)
    for c in conditions:
        name, op = key(c.field), c.op.upper()
        if op in LIST:
            many = isinstance(c.value, (list, tuple, set, frozenset))
            values = _flat(c.value)
            if many != (op == "IN") or not values:
                raise ValueError(f"{op} of {c.field} can't take {c.value!r}")
            compares.append((name, "IN", tuple(dict.fromkeys(values))))
        elif op in NUMBER:
            try:
                compares.append((name, op, Decimal(str(c.value).strip())))
            except InvalidOperation:
                raise ValueError(f"{op} of {c.field} needs a number, not {c.value!r}") from None
        elif op in TIME:
            compares.append((name, op, parse_instant(str(c.value))))
        else:
            raise ValueError(f"no such operator: {c.op}")
    equal = {k: tuple(dict.fromkeys(v)) for k, v in merged.items()}
    more = [c for c in compares if c[1] != "IN"]
    # EQ and IN conditions are equality as well, and AND with the map's
    for name, _, values in (c for c in compares if c[1] == "IN"):
        if name in equal:
            more.append((name, "IN", values))
        else:
            equal[name] = values
    return FilterPlan(equal, tuple(more))


def instant(value: Column) -> Column:
    """A stored value as a timestamp, null where it is none; each form is guarded by its pattern."""
    s = trim_controls(value)
    stamp = s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d)?$")
    day = s.rlike(r"^\d{4}-\d\d-\d\d$")
    millis = s.rlike(r"^[+-]?\d{1,18}$")
    return F.when(stamp | day, F.try_to_timestamp(s)).when(millis, F.timestamp_millis(s.try_cast("bigint")))


def compare(value: Column, op: str, literal: object) -> Column:
    """One condition on a stored value, false where it can't be read."""
    if op in LIST:
        held = trim_controls(value).isin(*(literal if isinstance(literal, tuple) else (literal,)))
    elif op in NUMBER:
        number, than = trim_controls(value).try_cast("decimal(38,10)"), F.lit(literal).cast("decimal(38,10)")
        held = {"GT": number > than, "GTE": number >= than, "LT": number < than, "LTE": number <= than}[op]
    else:
        held = instant(value) < F.lit(literal) if op == "BEFORE" else instant(value) > F.lit(literal)
    return F.coalesce(held, F.lit(False))


def native_compare(value: Column, op: str, literal: object) -> Column:
    """One condition on a column of a fitting type, as it is, so that scans can take it; null where the column is."""
    if op in LIST:
        return value.isin(*(literal if isinstance(literal, tuple) else (literal,)))
    if isinstance(literal, Decimal):
        literal = int(literal) if literal == literal.to_integral_value() else float(literal)
    than = F.lit(literal)
    return {"GT": value > than, "GTE": value >= than, "LT": value < than, "LTE": value <= than, "BEFORE": value < than, "AFTER": value > than}[op]


def to_column(plan: FilterPlan, metadata: Column | str = "metadata", columns: Mapping[str, Column] | None = None, native: bool = False) -> Column:
    """The whole plan as a condition.

    Fields in `columns` are columns of their own: with native, ones of fitting types whose texts need no stripping,
    and their conditions reach the scan.
    """
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    columns = columns or {}

    def part(field: str, op: str, literal: object) -> Column:
        if field in columns:
            return (native_compare if native else compare)(columns[field], op, literal)
        return compare(F.try_element_at(m, F.lit(field)), op, literal)

    parts = [part(f, "IN", v) for f, v in plan.equals.items()] + [part(f, op, x) for f, op, x in plan.compares]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_rows(rows: DataFrame, plan: FilterPlan, metadata: str = "metadata") -> DataFrame:
    return rows if plan.empty else rows.where(to_column(plan, metadata))


# --- text noise -------------------------------------------------------------------------------

#: Lines that are no content, as patterns.
PAGE_NUMBER = r"^(?:[-_\x{2013}\x{2014}\x{2015}\s]*)\d+(?:\s*/\s*\d+)?(?:[-_\x{2013}\x{2014}\x{2015}\s]*)$"
HAN_PAGE_NUMBER = r"^第\s*\d+\s*页(?:\s*/\s*共?\s*\d+\s*页)?$"
CONTENTS_TITLE = r"^目\s*录$"
PARSER_NOISE = r"(?i)^text[_\s-]*list\s+text$"
CONTENTS_ENTRY = r"^[\p{IsHan}A-Za-z0-9一二三四五六七八九十百千万章节篇部卷条款目()（）《》【】、，,:：;；\-\s]+[.．·•…]{2,}\s*\d+$"
RULE = r"^[._·•…\-\x{2013}\x{2014}\x{2015}\s]{3,}$"
#: Marks that a page's running text has and its chrome lacks.
SENTENCE_MARKS = r"[。！？.!?:：,，;；\n]"


def is_noise(line: Column) -> Column:
    """Page numbers, tables of contents, rules and parser noise; blank lines are none."""
    s = strip(line)
    compact = F.regexp_replace(F.lower(s), r"\s+", "")
    found = s.rlike(PARSER_NOISE) | s.rlike(CONTENTS_TITLE) | s.rlike(PAGE_NUMBER) | compact.rlike(HAN_PAGE_NUMBER) | s.rlike(CONTENTS_ENTRY) | s.rlike(RULE)
    return (s != "") & found


def content_lines(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Each document's lines that are content: id, pos, line."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\r?\n")).alias("pos", "line"))
    return lines.where((strip("line") != "") & ~is_noise(F.col("line")))


def page_chrome(blocks: DataFrame, pages: int = 3, most: int = 32) -> DataFrame:
    """Short texts without sentence punctuation that stand on several pages of a document: document_id, text, pages."""
    short = blocks.select("document_id", strip("text").alias("text"), "page_no").where((F.col("text") != "") & (F.char_length("text") <= most) & ~F.col("text").rlike(SENTENCE_MARKS))
    return short.where("page_no IS NOT NULL").groupBy("document_id", "text").agg(F.countDistinct("page_no").alias("pages")).where(F.col("pages") >= pages)


def without_page_chrome(blocks: DataFrame, pages: int = 3, most: int = 32) -> DataFrame:
    chrome = page_chrome(blocks, pages, most).select(F.col("document_id").alias("__d"), F.col("text").alias("__t"))
    return blocks.join(chrome, (blocks["document_id"] == F.col("__d")) & (strip(blocks["text"]) == F.col("__t")), "left_anti")


def repair_ocr(text: Column | str) -> Column:
    """An escaped percent sign unescaped, no space before it, words broken by a hyphen at a line's end rejoined."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.replace(c, F.lit("\\%"), F.lit("%"))
    c = F.regexp_replace(c, r"(?<=\d)\s+%", "%")
    return F.regexp_replace(c, r"(?<=[A-Za-z]{2})-\n(?=[A-Za-z]{2})", "")
