"""A generalised LL parser: every context-free grammar, left recursion and ambiguity included, in cubic time.

Alternatives are followed in parallel by descriptors (slot, stack, position); the stacks of all of them share one graph.
Errors are recovered by grammar: a nonterminal that derives any token skips what fits no production.
"""

from __future__ import annotations

Grammar = dict[str, list[tuple[str, ...]]]


def parse(grammar: Grammar, start: str, tokens: str) -> set[tuple[str, int, int]]:
    """All (nonterminal, begin, end) that are derived on the way from `start` at 0; nonterminals are longer than one character."""
    n, derived = len(tokens), set()
    edges: dict[tuple, set] = {}  # stack node (nonterminal, begin) -> {(slot to return to, its stack node)}
    done: dict[tuple, set] = {}  # stack node -> ends already found
    todo, seen = [], set()

    def add(slot: tuple, node: tuple, i: int) -> None:
        if (slot, node, i) not in seen:
            seen.add((slot, node, i))
            todo.append((slot, node, i))

    def call(name: str, i: int, slot: tuple, node: tuple) -> None:
        child = (name, i)
        new = child not in edges
        back = edges.setdefault(child, set())
        if (slot, node) not in back:
            back.add((slot, node))
            for end in done.get(child, ()):
                add(slot, node, end)
        if new:
            for k in range(len(grammar[name])):
                add((name, k, 0), child, i)

    root = ("", 0)
    call(start, 0, ("", 0, 0), root)
    while todo:
        (name, k, at), node, i = todo.pop()
        if name == "":
            continue
        rule = grammar[name][k]
        if at == len(rule):
            derived.add((name, node[1], i))
            if i not in done.setdefault(node, set()):
                done[node].add(i)
                for slot, parent in list(edges[node]):
                    add(slot, parent, i)
        elif len(rule[at]) > 1:
            call(rule[at], i, (name, k, at + 1), node)
        elif i < n and (tokens[i] == rule[at] or rule[at] == "?"):
            add((name, k, at + 1), node, i + 1)
    return derived
