"""Grammars as productions in text: the token pairs they derive, and a recogniser for what stands inside brackets.

A grammar is a list of `name = production ;`. In productions 'x' is a token, ID or any upper-case word a class of tokens,
x.name a bracketed group (p round, s square, b curly, and what a language adds) whose contents derive `name`; [ ] may be
left out, { } may be repeated, ( | ) are alternatives. Productions must not be left-recursive.

Brackets are reduced from the inside: the contents of a group, inner groups being one symbol each, are read by an automaton
whose states are sets of places in the productions with the productions they return to. States are made when first
needed and kept, so a token costs one look-up. A group's symbol says which contents it derives; none is an error.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"'[^']+'|\w+\.\w+|\w+|[=;{}\[\]()|]")
#: The brackets that all languages share.
BRACKETS = {"p": "()", "s": "[]", "b": "{}"}
#: Characters of the token string: no token, merge mark, line end, begin and end of the text.
NONE, MERGE, LINE, BEGIN, END = "\x01", "\x02", "\n", "^", "$"
_GROUPS, _DEAD, _MOST_STATES, _MOST_PLACES = 0xE000, -1, 100_000, 2_000


class _TooManyPlaces(Exception):
    """So many ways to read a text are open that the shared stacks of `Grammar.read` are due."""


class Grammar:
    """productions: text as above; `file` derives a whole text. brackets: letter to opening and closing character.
    soft: line ends may stand for semicolons, as they may before a closing curly bracket and at the end."""

    def __init__(self, productions: str, brackets: dict[str, str] | None = None, soft: bool = False):
        self.brackets, self.soft = BRACKETS | (brackets or {}), soft
        self.close = {v[0]: v[1] for v in self.brackets.values()}
        self.code: dict[str, str] = {}  # tokens and classes to characters
        self.term: list[dict[str, list[int]]] = []
        self.group: list[list[tuple[str, str, int]]] = []
        self.calls: list[list[tuple[str, int]]] = []
        self.eps: list[list[int]] = []
        self.rules: dict[str, tuple[int, int]] = {}
        rules = [r.split("=", 1) for r in re.split(r"(?<!');(?!')", re.sub(r"(?m)--[^\n]*$", "", productions)) if r.strip()]
        for name, body in {name.strip(): body for name, body in rules}.items():  # of two productions of a name the later holds
            self._rule(name, body)
        self._close_eps()
        self._sets()
        self.contents: dict[str, list[str]] = {}  # opening bracket to the names its contents may derive
        for q in self.group:
            for o, name, _ in q:
                if name not in self.contents.setdefault(o, []):
                    self.contents[o].append(name)
        self.contents[BEGIN] = ["file"]
        self.bit = {(o, n): 1 << i for o, ns in self.contents.items() for i, n in enumerate(ns)}
        self.bracket_re = re.compile("[" + re.escape("".join(self.brackets.values())) + "]")
        self._forget()

    def char(self, token: str) -> str:
        if token not in self.code:
            self.code[token] = token if len(token) == 1 and token.isascii() and token not in "^$\n" else chr(0x100 + len(self.code))
        return self.code[token]

    # productions to a network of states

    def _state(self) -> int:
        self.term.append({})
        self.group.append([])
        self.calls.append([])
        self.eps.append([])
        return len(self.term) - 1

    def _rule(self, name: str, body: str) -> None:
        tokens = _LEX.findall(body)
        first, last = self._state(), self._state()
        self.rules[name] = (first, last)
        self._at, self._tokens = 0, tokens
        end = self._either(first)
        self.eps[end].append(last)
        if self._at != len(tokens):
            raise ValueError(f"{name}: {tokens[self._at :]}")

    def _either(self, begin: int) -> int:
        out = self._state()
        while True:
            q = self._state()
            self.eps[begin].append(q)
            while self._at < len(self._tokens) and self._tokens[self._at] not in "|)]}":
                q = self._one(q)
            self.eps[q].append(out)
            if self._at < len(self._tokens) and self._tokens[self._at] == "|":
                self._at += 1
                continue
            return out

    def _one(self, q: int) -> int:
        t = self._tokens[self._at]
        self._at += 1
        if t in "([{":
            begin = self._state()
            self.eps[q].append(begin)
            end = self._either(begin)
            self._at += 1
            out = self._state()
            self.eps[end].append(out)
            if t == "{":
                self.eps[end].append(begin)
            if t != "(":
                self.eps[begin].append(out)
            return out
        out = self._state()
        if t[0] == "'":
            self.term[q].setdefault(self.char(t[1:-1]), []).append(out)
        elif "." in t:
            kind, name = t.split(".")
            self.group[q].append((self.brackets[kind][0], name, out))
        elif t == "LINE":
            self.term[q].setdefault(LINE, []).append(out)
        elif t.isupper():
            self.term[q].setdefault(self.char(t), []).append(out)
        else:
            self.calls[q].append((t, out))
        return out

    def _close_eps(self) -> None:
        n = len(self.eps)
        finals = {last: name for name, (_, last) in self.rules.items()}
        term, group, calls, final = [], [], [], [False] * n
        for q in range(n):
            seen, work = {q}, [q]
            t: dict[str, list[int]] = {}
            g, c = [], []
            while work:
                x = work.pop()
                final[q] |= x in finals
                for ch, outs in self.term[x].items():
                    t.setdefault(ch, []).extend(outs)
                g += self.group[x]
                c += self.calls[x]
                for y in self.eps[x]:
                    if y not in seen:
                        seen.add(y)
                        work.append(y)
            term.append(t)
            group.append(g)
            calls.append(c)
        self.term, self.group, self.calls, self.final = term, group, calls, final
        self.bare = [final[q] and not term[q] and not group[q] and not calls[q] for q in range(n)]
        reached, work = set(), [first for first, _ in self.rules.values()]
        while work:
            q = work.pop()
            if q not in reached:
                reached.add(q)
                work += [o for outs in term[q].values() for o in outs] + [o for *_, o in group[q]] + [o for _, o in calls[q]]
        self.states = reached
        missing = {n for q in reached for n, _ in calls[q]} | {n for q in reached for _, n, _ in group[q]}
        if missing - set(self.rules):
            raise ValueError(f"no productions for {missing - set(self.rules)}")

    def _sets(self) -> None:
        """nullable, and the first and last tokens of what a name derives."""
        names = list(self.rules)
        self.nullable = {n: False for n in names}
        reach: dict[str, set[int]] = {}
        for n in names:
            seen, work = set(), [self.rules[n][0]]
            while work:
                q = work.pop()
                if q not in seen:
                    seen.add(q)
                    work += [o for outs in self.term[q].values() for o in outs] + [o for *_, o in self.group[q]] + [o for _, o in self.calls[q]]
            reach[n] = seen
        self.reach = reach

        def skip(q: int) -> set[int]:
            seen, work = {q}, [q]
            while work:
                for n, o in self.calls[work.pop()]:
                    if self.nullable[n] and o not in seen:
                        seen.add(o)
                        work.append(o)
            return seen

        moved = True
        while moved:
            moved = False
            for n in names:
                if not self.nullable[n] and any(self.final[q] for q in skip(self.rules[n][0])):
                    self.nullable[n] = moved = True
        self.first = {n: set() for n in names}
        self.first_groups = {n: set() for n in names}
        self.last = {n: set() for n in names}
        moved = True
        while moved:
            moved = False
            for n in names:
                f, g, size = self.first[n], self.first_groups[n], len(self.first[n]) + len(self.first_groups[n]) + len(self.last[n])
                for q in skip(self.rules[n][0]):
                    f.update(self.term[q])
                    g.update((o, k) for o, k, _ in self.group[q])
                    for m, _ in self.calls[q]:
                        f |= self.first[m]
                        g |= self.first_groups[m]
                for q in reach[n]:
                    for elems, o in self._edges(q, self.last):
                        if any(self.final[x] for x in skip(o)):
                            self.last[n] |= elems
                moved |= len(f) + len(g) + len(self.last[n]) != size
        self.skip = skip

    def _edges(self, q: int, ends: dict[str, set[str]]) -> list[tuple[set[str], int]]:
        """(tokens at the wanted end of an element, state after it) of each element that leaves a state."""
        side = self.close if ends is self.last else {o: o for o in self.close}
        out = [({c}, o) for c, outs in self.term[q].items() for o in outs]
        out += [({side[b]}, o) for b, _, o in self.group[q]]
        return out + [(ends[m], o) for m, o in self.calls[q]]

    def pairs(self) -> set[str]:
        """The pairs of tokens that stand side by side in some text that the productions derive."""
        begins = {n: self.first[n] | {o for o, _ in self.first_groups[n]} for n in self.rules}
        out: set[str] = set()
        for n in self.rules:
            before: dict[int, set[str]] = {q: set() for q in self.reach[n]}
            moved = True
            while moved:
                moved = False
                for q in self.reach[n]:
                    for elems, o in self._edges(q, self.last):
                        size = len(before[o])
                        before[o] |= elems
                        moved |= len(before[o]) != size
                    for m, o in self.calls[q]:
                        if self.nullable[m] and not before[q] <= before[o]:
                            before[o] |= before[q]
                            moved = True
            for q in self.reach[n]:
                for elems, _ in self._edges(q, begins):
                    out |= {a + b for a in before[q] for b in elems}
        for (o, n), _ in self.bit.items():
            close = END if o == BEGIN else self.close[o]
            out |= {o + b for b in begins[n]} | {a + close for a in self.last[n]} | ({o + close} if self.nullable[n] else set())
        if self.soft:
            every = set("".join(out))
            out |= {LINE + LINE} | {LINE + c for c in every} | {c + LINE for c in every}
            # a semicolon may be left out at a group's end
            out |= {a[0] + c for a in out if a[1] == ";" for c in ("}", END)}
        return out

    # the automaton

    def _forget(self) -> None:
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.step: list[dict[str, int]] = []
        self.accepts: dict[int, int] = {}
        self.stacks: list[tuple[int, int]] = []
        self.stack_number: dict[tuple[int, int], int] = {}
        self.symbols: dict[tuple[str, int], str] = getattr(self, "symbols", {})
        self.symbol_of: dict[str, tuple[str, int, frozenset]] = getattr(self, "symbol_of", {})
        self.known: dict[str, str] = {}
        self.start = {o: self._number(frozenset((self.rules[n][0], -self.bit[o, n]) for n in ns)) for o, ns in self.contents.items()}

    def _number(self, places: frozenset) -> int:
        if not places:
            return _DEAD
        k = self.number.get(places)
        if k is None:
            k = self.number[places] = len(self.sets)
            self.sets.append(places)
            self.step.append({})
        return k

    def _after(self, places: frozenset, c: str) -> set:
        """Places after one more token, from places (state, stack); a negative stack is the contents' own name."""
        out, seen, work = set(), set(places), list(places)
        symbol = self.symbol_of.get(c)
        while work:
            q, stack = work.pop()
            if symbol is None:
                for o in self.term[q].get(c, ()):
                    out.add((o, stack))
            else:
                for b, n, o in self.group[q]:
                    if (b, n) in symbol[2]:
                        out.add((o, stack))
            for n, o in self.calls[q]:
                if c in self.first[n] if symbol is None else not self.first_groups[n].isdisjoint(symbol[2]):
                    inner = stack if self.bare[o] else self._stack(o, stack)
                    new = (self.rules[n][0], inner)
                    if new not in seen:
                        seen.add(new)
                        work.append(new)
                if self.nullable[n] and (o, stack) not in seen:
                    seen.add((o, stack))
                    work.append((o, stack))
            if self.final[q] and stack >= 0 and self.stacks[stack] not in seen:
                seen.add(self.stacks[stack])
                work.append(self.stacks[stack])
            if len(seen) > _MOST_PLACES:
                raise _TooManyPlaces
        return out

    def _stack(self, back: int, below: int) -> int:
        k = self.stack_number.get((back, below))
        if k is None:
            k = self.stack_number[back, below] = len(self.stacks)
            self.stacks.append((back, below))
        return k

    def _next(self, state: int, c: str) -> int:
        places = self.sets[state]
        if c == LINE and self.soft:
            new = places | self._after(places, ";")
        else:
            new = self._after(places, c)
        k = self.step[state][c] = self._number(frozenset(new))
        return k

    def _derived(self, state: int, soft: bool) -> int:
        key = state * 2 + soft
        got = self.accepts.get(key)
        if got is None:
            got, places = 0, self.sets[state]
            places = places | self._after(places, ";") if soft else places
            seen, work = set(places), list(places)
            while work:
                q, stack = work.pop()
                nexts = [(o, stack) for n, o in self.calls[q] if self.nullable[n]]
                if self.final[q]:
                    if stack < 0:
                        got |= -stack
                    else:
                        nexts.append(self.stacks[stack])
                for x in nexts:
                    if x not in seen:
                        seen.add(x)
                        work.append(x)
            self.accepts[key] = got
        return got

    def derives(self, opening: str, contents: str) -> int:
        """Bits of the names that the contents of a bracket derive."""
        if self.soft and opening in "([":
            contents = contents.replace(LINE, "")
        if len(self.sets) > _MOST_STATES:
            self._forget()
        state, step = self.start[opening], self.step
        try:
            for c in contents:
                after = step[state].get(c)
                if after is None:
                    after = self._next(state, c)
                if after < 0:
                    return 0
                state = after
        except _TooManyPlaces:
            return self.read(opening, contents)
        return self._derived(state, self.soft and opening in "{^")

    def read(self, opening: str, contents: str) -> int:
        """As `derives`, with one graph of stacks that all readings share (generalised LL): polynomial for any text."""
        names = self.contents[opening]
        soft = self.soft and opening in "{^"
        back: dict[tuple, set] = {(n, 0, None): set() for n in names}  # (name, begin) to the places it returns to
        ends: dict[tuple, set[int]] = {}
        n, got, seen = len(contents), 0, set()
        work = [(self.rules[name][0], (name, 0, None), 0) for name in names]
        while work:
            place = work.pop()
            if place in seen:
                continue
            seen.add(place)
            q, node, i = place
            steps = [(contents[i], i + 1)] if i < n else []
            if self.soft and (i < n and contents[i] == LINE or i == n and soft):
                steps = ([] if i == n else [("", i + 1)]) + [(";", min(i + 1, n) if i < n else n)]
            for c, j in steps:
                if c == "":
                    work.append((q, node, j))
                    continue
                symbol = self.symbol_of.get(c)
                if symbol is None:
                    work += [(o, node, j) for o in self.term[q].get(c, ())]
                else:
                    work += [(o, node, j) for b, m, o in self.group[q] if (b, m) in symbol[2]]
                for m, o in self.calls[q]:
                    if c in self.first[m] if symbol is None else not self.first_groups[m].isdisjoint(symbol[2]):
                        self._call(m, o, node, i, back, ends, work)
            if steps and steps[0][0] == "":  # a call may begin before a line end that counts for nothing
                for m, o in self.calls[q]:
                    self._call(m, o, node, i, back, ends, work)
            work += [(o, node, i) for m, o in self.calls[q] if self.nullable[m]]
            if self.final[q]:
                if node[2] is None and node in back and not back[node] and node[1] == 0 and node[0] in names and i == n:
                    got |= self.bit[opening, node[0]]
                ends.setdefault(node, set()).add(i)
                work += [(o, parent, i) for o, parent in back[node]]
        return got

    def _call(self, name: str, o: int, node: tuple, i: int, back: dict, ends: dict, work: list) -> None:
        inner = (name, i, True)
        if (o, node) not in back.setdefault(inner, set()):
            back[inner].add((o, node))
            work += [(o, node, j) for j in ends.get(inner, ())]
            work.append((self.rules[name][0], inner, i))

    def symbol(self, opening: str, contents: str) -> str:
        """One character for a group with these contents; NONE if they derive nothing."""
        key = opening + contents
        got = self.known.get(key)
        if got is None:
            bits = self.derives(opening, contents)
            got = NONE
            if bits:
                got = self.symbols.get((opening, bits))
                if got is None:
                    got = self.symbols[opening, bits] = chr(_GROUPS + len(self.symbols))
                    self.symbol_of[got] = (opening, bits, frozenset((opening, n) for n in self.contents[opening] if self.bit[opening, n] & bits))
            if len(self.known) > _MOST_STATES:
                self.known.clear()
            self.known[key] = got
        return got

    def errors(self, s: str) -> list[str]:
        """The contents that derive nothing, innermost first, each behind its opening bracket; empty where the text as a
        whole derives `file`, and where brackets do not match, which is another check's case."""
        bad, stack, parts, last = [], [], [], 0
        for m in self.bracket_re.finditer(s):
            i = m.start()
            c = s[i]
            if i > last:
                parts.append(s[last:i])
            last = i + 1
            if c in self.close:
                stack.append((c, parts))
                parts = []
            elif not stack or self.close[stack[-1][0]] != c:
                return []
            else:
                contents = "".join(parts)
                opening, parts = stack.pop()
                got = self.symbol(opening, contents)
                if got == NONE:
                    bad.append(opening + contents)
                parts.append(got)
        if stack:
            return []
        parts.append(s[last:])
        whole = "".join(parts)
        if not bad and not self.derives(BEGIN, whole):
            bad.append(BEGIN + whole)
        return bad
