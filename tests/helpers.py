"""Small documents, and a plain evaluator of selections that shares no code with the engine's plans."""

import re

from pagequery.plans import ast
from pagequery.sources.relations import text_pages

FOUR = ["Chapter 1\nThis is the first chapter with text content.", "Chapter 2\nThis has mixed content with some text.", "Summary\nThis is the summary section.", ""]


def document(spark, texts, doc_id="d", images=None):
    return text_pages(spark, [(doc_id, i, t, (images or {}).get(i, 0)) for i, t in enumerate(texts, 1)])


def blank_pages(spark, n):
    return document(spark, [f"page {i}" for i in range(1, n + 1)])


def evaluate(node, texts):
    """The set of page numbers of a node: text predicates, positions, operators, offsets and sections."""
    n = len(texts)
    every = set(range(1, n + 1))
    if isinstance(node, ast.All):
        return every
    if isinstance(node, ast.Span):
        a, b = sorted((node.start or 1, node.stop or n))
        return {i for i in every if a <= i <= b}
    if isinstance(node, ast.Step):
        return set(range(node.start, (node.stop or n) + 1, node.step)) & every
    if isinstance(node, ast.First):
        return set(range(1, node.count + 1)) & every
    if isinstance(node, ast.Last):
        return set(range(n - node.count + 1, n + 1)) & every
    if isinstance(node, ast.Match):
        test = {"contains": lambda t: node.value in t, "regex": lambda t: bool(re.search(node.value, t)), "line-starts": lambda t: any(x.strip().startswith(node.value) for x in t.split("\n"))}[node.kind]
        return {i for i, t in enumerate(texts, 1) if t and test(t)}
    if isinstance(node, ast.Shift):
        return {i + node.by for i in evaluate(node.node, texts)} & every
    if isinstance(node, ast.Not):
        return every - evaluate(node.node, texts)
    if isinstance(node, ast.And):
        return evaluate(node.left, texts) & evaluate(node.right, texts)
    if isinstance(node, ast.Or):
        return evaluate(node.left, texts) | evaluate(node.right, texts)
    return {p for s, e in section_ends(node, texts) for p in range(s, e + 1)}


def section_ends(node, texts):
    ends = sorted(evaluate(node.end, texts))
    out = []
    for s in sorted(evaluate(node.start, texts)):
        after = [e for e in ends if e >= s]
        if after:
            out.append((s, after[0]))
    return out
