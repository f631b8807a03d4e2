"""Newick trees as node tables."""

from __future__ import annotations

import re


def without_comments(text: str) -> str:
    """The text outside square brackets, nested to any depth; brackets in quoted labels are text."""
    out, depth, quoted = [], 0, False
    for c in text:
        if c == "'" and depth == 0:
            quoted = not quoted
        if c == "[" and not quoted:
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif depth == 0:
            out.append(c)
    return "".join(out)


def parse_newick(text: str) -> list[tuple[int, int, str]]:
    """(node, parent or -1, label) of each node, parents before children; comments and branch lengths are dropped."""
    tokens = re.findall(r"'(?:[^']|'')*'|[(),;]|:[^(),;]*|[^(),;:'\s]+", without_comments(text))
    nodes: list[list] = [[-1, ""]]
    at = 0
    for t in tokens:
        if t == "(":
            nodes.append([at, ""])
            at = len(nodes) - 1
        elif t == ",":
            nodes.append([nodes[at][0], ""])
            at = len(nodes) - 1
        elif t == ")":
            at = nodes[at][0]
        elif t == ";":
            break
        elif not t.startswith(":"):
            nodes[at][1] = t[1:-1].replace("''", "'") if t.startswith("'") else t
    return [(k, p, name) for k, (p, name) in enumerate(nodes)]
