"""Names that are made when a query is planned: variables, templates and descriptions of selections."""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pagequery.errors import SelectionError

from . import lexer
from .ast import All, First, Last, Span, Step
from .parser import FILE, is_pattern, parse_argument

VARIABLE = re.compile(r"\{([^{}|]+)(?:\|([^{}]*))?\}")
#: Names that templates fill in themselves (fixed values).
RESERVED = {"range", "original_name", "page_count", "pages", "file", "path"}


def variable_name(text: str, most: int = 25) -> str:
    """A variable's name from a keyword: its words in lower case and without punctuation, as many leading ones as fit."""
    words = re.findall(r"[^\s_]+", re.sub(r"[^\w\s]", "", (text or "").lower()))
    if not words:
        return "unknown"
    if words[0][0].isdigit():
        words.insert(0, "var")
    ends = [*accumulate(map(len, words), lambda end, n: end + 1 + n)]
    return "_".join(words[: bisect_right(ends, most)]) or words[0][:most]


def auto_variable_name(keyword: str) -> str:
    return variable_name(keyword, 20)


def validate_variable(name: str) -> tuple[bool, str]:
    if not isinstance(name, str) or not name:
        return False, "a variable needs a name"
    if not name.isidentifier():
        return False, f"not an identifier: '{name}'"
    if name in RESERVED:
        return False, f"'{name}' is reserved"
    return True, ""


def parse_template(template: str) -> list[tuple[str, str | None]]:
    """(variable, fallback) of each {variable} or {variable|fallback}."""
    return [(m[1].strip(), m[2] or None) for m in VARIABLE.finditer(template)]


def required_variables(template: str) -> set[str]:
    return {name for name, _ in parse_template(template)}


def literal_parts(template: str) -> list[tuple[str, str | None, str | None]]:
    """(text before, variable, fallback) in order; the last has no variable."""
    out, at = [], 0
    for m in VARIABLE.finditer(template):
        out.append((template[at : m.start()], m[1].strip(), m[2] or None))
        at = m.end()
    return [*out, (template[at:], None, None)]


def validate_template(template: str) -> tuple[bool, str]:
    if not template.strip():
        return False, "a template is empty"
    if len(template) > 200:
        return False, "a template is longer than 200 characters"
    if "{{" in template or "}}" in template:
        return False, "braces are doubled"
    if template.count("{") != template.count("}"):
        return False, "braces are not balanced"
    if re.search(r"[{}]", VARIABLE.sub("", template)):
        return False, "a brace stands alone"
    for name, _ in parse_template(template):
        if name not in RESERVED and not name.isidentifier():
            return False, f"not an identifier: '{name}'"
    return True, ""


def missing_variables(template: str, given: set[str]) -> list[str]:
    """Variables without a fallback that are neither given nor built in."""
    return sorted(n for n, fallback in parse_template(template) if not fallback and n not in given | RESERVED)


def default_template(variables: list[str]) -> str:
    """The variables in order, each with a fallback, and the pages."""
    return "_".join([*("{%s|NO-%s}" % (v, v.upper()) for v in variables), "pages{range}"]) + ".pdf" if variables else "{original_name}_pages{range}.pdf"


#: Sample values for previews, by what the keyword contains (fixed values).
SAMPLES = (
    (("invoice", "inv"), "INV-2024-001"),
    (("company", "vendor", "supplier"), "ACME-Corp"),
    (("amount", "total", "sum"), "1250-00"),
    (("date",), "2024-01-15"),
    (("po", "purchase"), "PO-98765"),
    (("reference", "ref"), "REF-ABC123"),
    (("account", "acct"), "ACCT-456789"),
    (("order",), "ORD-789456"),
)


def sample_value(keyword: str) -> str:
    found = (value for terms, value in SAMPLES if any(t in keyword.lower() for t in terms))
    return next(found, f"SAMPLE-{variable_name(keyword).upper()}")


def preview(template: str, variables: dict[str, str]) -> str:
    """The template with sample values, as plain text."""
    values = {k: sample_value(k) for k in required_variables(template)} | variables
    return "".join(text + ("" if name is None else values.get(name) or fallback or f"NO-{name.upper()}") for text, name, fallback in literal_parts(template))


# --- descriptions -----------------------------------------------------------------------------------------------------


def plain(text: str) -> str:
    text = re.sub(r'[<>:"/\\|?*]', "_", text)
    return re.sub("_+", "_", re.sub(r"\s+", "_", text)).strip("_")


#: The kinds that arguments are counted by, in the order in which they are named (fixed values).
CATEGORIES = ("files", "patterns", "booleans", "ranges", "keywords")


#: Where a text alone decides, whatever the parser makes of it: prefixes that make a pattern, and what makes a boolean.
PATTERNS, BOOLEANS = ("contains:", "regex:"), "&|"


def category(argument: str) -> str:
    """What an argument is counted as. One that holds a contains or regex pattern anywhere counts as a pattern, booleans included."""
    if any(p in argument for p in PATTERNS):
        return "patterns"
    if any(c in argument for c in BOOLEANS):
        return "booleans"
    if argument.startswith("file:"):
        return "files"
    try:
        node = parse_argument(argument).node
    except SelectionError:
        return "patterns"
    if isinstance(node, Span) and node.start is not None and node.stop is not None:
        return "ranges"
    return "keywords" if isinstance(node, (All, First, Last)) or (isinstance(node, Step) and argument.isalpha()) else "patterns"


def words_for(argument: str) -> str:
    """A word or two for an argument. One that begins with a pattern's prefix is described by it, whatever follows."""
    if argument.startswith("contains:"):
        value = argument.removeprefix("contains:").strip("\"'")
        return "contains_" + plain(value if len(value) <= 15 else f"{value[:12]}...")
    if argument.startswith("regex:"):
        return "regex_pattern"
    if any(c in argument for c in BOOLEANS):
        return "boolean_expr"
    if argument.startswith("file:"):
        return plain(os.path.splitext(argument[5:])[0])
    try:
        node = parse_argument(argument).node
    except SelectionError:
        return plain(argument)[:10]
    match node:
        case Span(start=int(), stop=int()) if re.fullmatch(r"\d+(?:-\d+)?", argument):
            return f"pages{argument}"
        case All() | First() | Last() as found:
            return f"{type(found).__name__.lower()}_pages"
        case Step(start=first, stop=None, step=2) if argument.isalpha():
            return "odd_pages" if first == 1 else "even_pages"
    return plain(argument)[:10]


def described(arguments: list[str], most: int = 50) -> tuple[str, bool]:
    """A short description of a list of arguments, of many or long ones how many there are of each kind; and whether the number of pages belongs behind it."""
    texts = [a.strip() for a in arguments]
    listed = ", ".join(map(words_for, texts))
    if len(texts) < 2 or (len(texts) <= 3 and len(listed) <= most):
        return listed or "empty", False
    counted = Counter(map(category, texts))
    named = [f"{counted[c]}{c}" for c in CATEGORIES if c in counted]
    mixed = f"mixed_{len(texts)}args_" if len(named) > 2 else ""
    return f"{mixed}{'-'.join(named[:2])}", True


def describe(arguments: list[str], total_pages: int, most: int = 50) -> str:
    text, counts = described(arguments, most)
    return f"{text}_{total_pages}pg" if counts else text


def safe(text: str, most: int = 20) -> str:
    return re.sub(r"[^\w\-]", "-", text)[:most]


def pattern_description(expression: str) -> str:
    return "pattern-match" if len(expression) > 15 else safe(expression, 15)


def boolean_description(expression: str, most: int = 20) -> str:
    if len(expression) > most:
        return "boolean-match"
    return safe(expression.replace(" & ", "-and-").replace(" | ", "-or-").replace("!", "not-"), most)


def query_description(expression: str, group_start: str | None = None, group_end: str | None = None, filter_matches: str | None = None, n_groups: int = 0) -> str:
    """What a whole query is called: its expression and a word for each step; long ones by their number of groups."""
    if lexer.is_boolean(expression):
        base = boolean_description(expression, 30)
    else:
        base = pattern_description(expression) if is_pattern(expression) else plain(expression)
    steps = ["bounded" if group_start and group_end else "start-split" if group_start else "end-split" if group_end else None]
    steps.append(None if not filter_matches else "filtered" if re.fullmatch(r"[\d,\-\s]+", filter_matches) else "criteria")
    steps.append(f"{n_groups}groups" if n_groups > 1 and any(steps) else None)
    out = "-".join([base, *filter(None, steps)])
    return f"advanced-{n_groups}groups" if any(steps) and len(out) > 30 else out


def batch_scheme(names: list[str]) -> dict:
    """What a batch of files has in common."""
    stems = [os.path.splitext(os.path.basename(n))[0] for n in names]
    prefix = os.path.commonprefix(stems).rstrip("_-") if len(stems) > 1 else ""
    suffix = os.path.commonprefix([s[::-1] for s in stems])[::-1].lstrip("_-") if len(stems) > 1 else ""
    return {"common_prefix": prefix, "common_suffix": suffix, "suggested_base": prefix or suffix or "batch", "count": len(names)}


def has_file(expression: str) -> bool:
    return bool(FILE.search(lexer.mask(expression)))
