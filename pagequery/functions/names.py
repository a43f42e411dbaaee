"""Names of outputs: sanitised parts, templates and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequery.plans.template import described, literal_parts

from .text import SPACES, collapse, trim_ws


def sanitize_filename(text: Column, most: int = 50) -> Column:
    """A part of a file name: amounts lose currency signs and commas, all else but letters, digits, . and - becomes -."""
    bare = trim_ws(F.coalesce(text, F.lit("")))
    amount = F.regexp_replace(F.regexp_replace(bare, "[$£€¥,]", ""), r"\.", "-")
    name = F.regexp_replace(bare, r"(?U)[^\w.\-]", "-")
    out = F.regexp_replace(F.when(bare.rlike(r"(?U)^[$£€¥]?[\d,]+"), amount).otherwise(name), "-+", "-")
    out = F.regexp_replace(out, r"^[-.]+|[-.]+$", "")
    out = F.when(F.length(out) > most, F.regexp_replace(F.left(out, F.lit(most)), r"[-.]+$", "")).otherwise(out)
    return F.when(out == "", "unknown").otherwise(out)


def sanitize_content(content: Column, kind: str = "text") -> Column:
    """Content for a file name; kind is text, number or date."""
    bare = trim_ws(F.coalesce(content, F.lit("")))
    if kind == "number":
        out = F.regexp_replace(bare, r"(?U)[^\d.\-]", "-")
    elif kind == "date":
        out = F.regexp_replace(F.regexp_replace(bare, r"[/\\]", "-"), rf"(?:,|{SPACES})+", "-")
    else:
        return F.when(bare == "", "empty").otherwise(sanitize_filename(bare, 30))
    out = F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-+|-+$", "")
    return F.when(bare == "", "empty").when(out == "", "content").otherwise(out)


def sanitize_description(text: Column) -> Column:
    """Unsafe characters and white space become one _."""
    out = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), SPACES, "_")
    return F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_+|_+$", "")


def clean_cell(value: Column) -> Column:
    """A cell of a TSV file: one line, white space collapsed, numbers without spaces; null is empty."""
    flat = collapse(F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[\t\n]", " "), "\r", ""))
    return F.when(looks_like_number(flat), F.replace(flat, F.lit(" "), F.lit(""))).otherwise(flat)


def looks_like_number(value: Column) -> Column:
    """Whether it reads as a number without commas, spaces and dollar signs."""
    return F.coalesce(F.translate(value, ", $", "").rlike(r"(?i)^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?$|^[+-]?(?:inf|infinity|nan)$"), F.lit(False))


def fill_template(template: str, variables: dict[str, Column], built_in: dict[str, Column] | None = None) -> Column:
    """A template with its variables filled in: the variable's own value, else the built-in, else the fallback, else NO-NAME."""
    values = {**(built_in or {}), **variables}
    parts = []
    for literal, name, fallback in literal_parts(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            missing = F.lit(fallback or f"NO-{name.upper()}")
            parts.append(sanitize_filename(F.coalesce(values[name].cast("string"), missing) if name in values else missing, 40))
    return F.concat(*parts) if parts else F.lit("")


def template_name(template: str, variables: dict[str, Column], stem: Column, page_range: Column, page_count: Column | None = None) -> Column:
    """A file name by a template; .pdf is added where it is missing."""
    built_in = {"original_name": stem, "range": page_range} | ({"page_count": page_count} if page_count is not None else {})
    out = fill_template(template, variables, built_in)
    return F.when(F.lower(out).endswith(".pdf"), out).otherwise(F.concat(out, F.lit(".pdf")))


def smart_name(template: str | None, variables: dict[str, Column], stem: Column, page_range: Column, page_count: Column | None = None) -> Column:
    """The template's name; without a template, or where all variables are null, the stem and the pages."""
    plain = F.concat(stem, F.lit("_pages"), page_range, F.lit(".pdf"))
    if not template or not variables:
        return plain
    return F.when(F.coalesce(*variables.values()).isNull(), plain).otherwise(template_name(template, variables, stem, page_range, page_count))


def extraction_name(stem: Column, description: Column, mode: str = "single", prefix: Column | None = None) -> Column:
    """prefix_stem_mode_description.pdf, of 80 characters at most unless the description alone can be cut."""
    kind = {"separate": "pages", "grouped": "groups"}.get(mode, "extracted")
    clean = sanitize_description(description)
    has = (clean != "") & (clean != "all")
    front = F.concat_ws("_", *([] if prefix is None else [prefix]), stem, F.lit(kind))
    full = F.when(has, F.concat_ws("_", front, clean)).otherwise(front)
    parts = F.when(has, 3 if prefix is None else 4).otherwise(2 if prefix is None else 3)
    cut = F.when(parts > 3, F.concat_ws("_", front, F.concat(F.left(clean, F.lit(20)), F.lit("...")))).otherwise(F.left(full, F.lit(80)))
    return F.concat(F.when(F.length(full) > 80, cut).otherwise(full), F.lit(".pdf"))


def selection_description(arguments: list[str], total_pages: Column, most: int = 50) -> Column:
    """A short description of a selection of so many pages."""
    text, counts = described(arguments, most)
    return F.concat(F.lit(f"{text}_"), total_pages.cast("string"), F.lit("pg")) if counts else F.lit(text)


def missing_value(name: str, preview: bool = False) -> Column:
    """What stands for a variable without a value: in a preview that it would be extracted, else that there is none."""
    return F.lit(f"{'PREVIEW' if preview else 'NO'}_{name.upper()}")


def template_variables(values: dict[str, Column], stem: Column, page_range: Column, preview: bool = False) -> dict[str, Column]:
    """All variables of a template: built-in ones, and extracted ones or what stands for them."""
    built_in = {"original_name": stem, "range": page_range, "page_count": estimated_pages(page_range)}
    return built_in | {k: F.coalesce(v, missing_value(k, preview)) for k, v in values.items()}


def estimated_pages(description: Column) -> Column:
    """How many pages a description names: those of a range a-b, the numbers of a list, else one."""
    span = description.rlike(r"^\d+-\d+$")
    a, b = (F.regexp_extract(description, r"^(\d+)-(\d+)$", i).try_cast("int") for i in (1, 2))
    listed = F.size(F.filter(F.split(description, ","), lambda x: trim_ws(x).rlike(r"^\d+$")))
    return F.when(span, b - a + 1).when(F.contains(description, F.lit(",")), listed).otherwise(1)


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)
