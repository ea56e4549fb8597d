"""Chart parsing of short token strings with edits of least cost.

``Grammar`` compiles rules in a small notation (``|``, ``?``, ``*``, ``+``,
parentheses; names with a capital are rules, all else is a token) and parses
token strings by an Earley chart. ``repair`` first parses without edits; if
that fails, chart items carry the cost of inserted, deleted and replaced
tokens, each 1, and the edits that led to them. ``Ahead`` knows for every item
how many edits the rest of the string needs at least; items are taken in the
order of both together until the whole string is repaired, however long that takes.
"""

from __future__ import annotations

import gc
import re
from collections import defaultdict

import numpy as np


class Grammar:
    def __init__(self, text: str):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        for line in re.sub(r"\n\s+", " ", text.strip()).splitlines():
            name, body = line.split(" : ", 1)
            self._add(name.strip(), body.split())
        self.nullable: set[str] = set()
        while True:
            more = {n for n, alts in self.rules.items() if any(all(x in self.nullable for x in a) for a in alts)} - self.nullable
            if not more:
                break
            self.nullable |= more
        # a state is a rule with a dot; states of one rule follow one another
        self.after: list[str | None] = []  # the symbol after the dot
        self.head: list[str] = []
        self.begin: dict[str, list[int]] = defaultdict(list)
        for name, alts in self.rules.items():
            for alt in alts:
                self.begin[name].append(len(self.after))
                for symbol in (*alt, None):
                    self.after.append(symbol)
                    self.head.append(name)
        self.reach = {n: self._reach(n) for n in self.rules}
        self.first = {n: self._first(n) for n in self.rules}
        self.last = self._lasts()
        self._pairs: dict[str, tuple[set[str], set[tuple[str, str]]]] = {}
        self._ahead: dict[str, Ahead] = {}

    def _add(self, name: str, words: list[str]) -> None:
        alts, at = self._alternatives(name, words, 0)
        assert at == len(words), (name, words[at:])
        self.rules.setdefault(name, []).extend(alts)

    def _alternatives(self, name: str, words: list[str], at: int) -> tuple[list[tuple[str, ...]], int]:
        alts: list[tuple[str, ...]] = []
        now: list[str] = []
        while at < len(words) and words[at] != "⟩":
            w = words[at]
            at += 1
            if w == "¦":
                alts.append(tuple(now))
                now = []
                continue
            if w == "⟨":
                inner, at = self._alternatives(name, words, at)
                at += 1
                symbol = f"{name}.{len(self.rules)}"
                self.rules[symbol] = inner
            else:
                symbol = w
            mark = words[at] if at < len(words) and words[at] in ("⁇", "⁎", "⁺") else ""
            if mark:
                at += 1
                aux = f"{name}.{len(self.rules)}"
                self.rules[aux] = {"⁇": [(), (symbol,)], "⁎": [(), (aux, symbol)], "⁺": [(symbol,), (aux, symbol)]}[mark]
                symbol = aux
            now.append(symbol)
        alts.append(tuple(now))
        return alts, at

    def _reach(self, name: str) -> list[str]:
        """Rules that are predicted where ``name`` is expected."""
        seen, todo = {name}, [name]
        while todo:
            for alt in self.rules[todo.pop()]:
                for x in alt:
                    if x in self.rules and x not in seen:
                        seen.add(x)
                        todo.append(x)
                    if x not in self.nullable:
                        break
        return sorted(seen)

    def _first(self, name: str) -> frozenset[str]:
        """Tokens that can begin ``name``."""
        out = set()
        for r in self.reach[name]:
            for alt in self.rules[r]:
                for x in alt:
                    if x not in self.rules:
                        out.add(x)
                    if x not in self.nullable:
                        break
        return frozenset(out)

    def parse(self, start: str, tokens: list[str]) -> int:
        """-1 if ``start`` derives the tokens, else the place of the first token that can't follow."""
        after, head, rules, nullable = self.after, self.head, self.rules, self.nullable
        waiting: list[dict[str, list[tuple[int, int]]]] = []
        items = [(s, 0) for s in self.begin[start]]
        done = False
        for at in range(len(tokens) + 1):
            token = tokens[at] if at < len(tokens) else None
            here: dict[str, list[tuple[int, int]]] = {}
            waiting.append(here)
            seen, todo, scanned, predicted = set(items), list(items), [], set()
            done = False
            while todo:
                state, origin = todo.pop()
                symbol = after[state]
                if symbol is None:
                    name = head[state]
                    if origin == 0 and name == start:
                        done = True
                    for s, o in waiting[origin].get(name, ()):
                        new = (s + 1, o)
                        if new not in seen:
                            seen.add(new)
                            todo.append(new)
                elif symbol in rules:
                    here.setdefault(symbol, []).append((state, origin))
                    if symbol in nullable:
                        new = (state + 1, origin)
                        if new not in seen:
                            seen.add(new)
                            todo.append(new)
                    if symbol not in predicted:
                        predicted.add(symbol)
                        if token in self.first[symbol]:
                            for s in self.begin[symbol]:
                                if (s, at) not in seen:
                                    seen.add((s, at))
                                    todo.append((s, at))
                    # a rule that was completed here already without a token is nullable and handled above
                elif symbol == token:
                    scanned.append((state + 1, origin))
            if token is None:
                return -1 if done else at
            if not scanned:
                return at
            items = scanned
        return len(tokens)

    def _lasts(self) -> dict[str, set[str]]:
        """Tokens that can end each rule."""
        out: dict[str, set[str]] = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                size = len(out[n])
                for alt in alts:
                    for x in reversed(alt):
                        out[n] |= out[x] if x in self.rules else {x}
                        if x not in self.nullable:
                            break
                changed |= len(out[n]) > size
        return out

    def pairs(self, start: str) -> tuple[set[str], set[tuple[str, str]]]:
        """The tokens of all sentences of ``start``, and which of them can be neighbours."""
        if start not in self._pairs:
            seen, todo = {start}, [start]
            tokens: set[str] = set()
            near: set[tuple[str, str]] = set()
            while todo:
                for alt in self.rules[todo.pop()]:
                    for i, x in enumerate(alt):
                        if x not in self.rules:
                            tokens.add(x)
                        elif x not in seen:
                            seen.add(x)
                            todo.append(x)
                        for y in alt[i + 1 :]:
                            near.update((u, v) for u in (self.last[x] if x in self.rules else (x,)) for v in (self.first[y] if y in self.rules else (y,)))
                            if y not in self.nullable:
                                break
            self._pairs[start] = tokens, near
        return self._pairs[start]

    def least(self, start: str, tokens: list[str]) -> list[int]:
        """For each place a number of edits that the tokens from there on need at least."""
        known, near = self.pairs(start)
        need = [0] * (len(tokens) + 2)
        for i in range(len(tokens) - 1, -1, -1):
            need[i] = need[i + 1] + (tokens[i] not in known)
            if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) not in near:
                need[i] = max(need[i], 1 + need[i + 2])
        return need

    def repair(self, start: str, tokens: list[str], effort: float = float("inf")) -> tuple[int, bool, list[tuple[str, int, str]]]:
        """(cost, exact, edits): the least number of edits and one such repair, in the order of the text.

        An edit is (``insert``, ``delete`` or ``replace``, the place of the
        token, the token that comes in, or goes when it is deleted). Only a
        caller that gives ``effort`` can have the search end after so many
        chart items: the cost is then the greatest number below which there is
        proven to be no repair, exact is false, and the edits are the tokens
        and neighbours that need one at least.
        """
        if self.parse(start, tokens) < 0:
            return 0, True, []
        if start not in self._ahead:
            self._ahead[start] = Ahead(self, start)
        need = self._ahead[start].least(tokens)
        collects = gc.isenabled()
        gc.disable()  # the search makes very many tuples, none of them in a cycle
        try:
            level, found = self._search(start, tokens, need, effort)
        finally:
            if collects:
                gc.enable()
        if found is None:
            near = self.least(start, tokens)
            return max(1, level), False, [("replace", i, tokens[i]) for i in range(len(tokens)) if near[i] > near[i + 1]] or [("replace", 0, tokens[0] if tokens else "")]
        edits, todo = [], [found]
        while todo:
            t = todo.pop()
            if t is None:
                continue
            if len(t) == 2:  # two repairs one after the other
                todo += [t[0], t[1]]
            else:
                edits.append(t[1:])
                todo.append(t[0])
        edits.sort(key=lambda e: (e[1], e[0] != "insert"))
        return len(edits), True, edits

    def _search(self, start: str, tokens: list[str], need: list[list[int]], effort: float):
        """(cost, edits of a cheapest repair as nested tuples), the edits None if more than ``effort`` items are taken.

        Items are taken by the cost of the text up to their place and what the
        rest needs at least, the latest found first. No step lowers that sum,
        and items that expect the same rule at one place need the same for the
        rest, so that an item's cost is the least when it is taken.
        """
        after, head, rules, begin = self.after, self.head, self.rules, self.begin
        size = len(tokens)
        waiting: list[dict[str, list[tuple]]] = [{} for _ in range(size + 1)]  # per place, items that expect a rule
        complete: list[dict[str, dict[int, tuple]]] = [{} for _ in range(size + 1)]  # per place, the rules that begin there: their ends and costs
        before: list[dict[str, int]] = [{} for _ in range(size + 1)]  # per place, least cost of the text before each rule that is expected there
        before[0][start] = 0
        best: list[dict[tuple[int, int], int]] = [{} for _ in range(size + 1)]
        queue: dict[int, list[tuple]] = defaultdict(list)
        for s in begin[start]:
            best[0][s, 0] = 0
            queue[need[0][s]].append((0, s, 0, 0, None))
        level = min(queue)
        while True:
            while not queue[level]:
                del queue[level]
                level += 1
            at, state, origin, cost, trace = queue[level].pop()
            if best[at][state, origin] != cost:
                continue  # found cheaper, or taken before
            best[at][state, origin] = -1
            effort -= 1
            if effort < 0:
                return level, None
            symbol, name = after[state], head[state]
            total = before[origin][name] + cost
            moves = []
            if symbol is None:
                if origin == 0 and name == start:
                    if at == size:
                        return cost, trace if trace is not None else ()
                    moves.append((at + 1, state, origin, cost + 1, (trace, "delete", at, tokens[at])))  # what comes after the end
                held = complete[origin].setdefault(name, {})
                if at not in held:
                    held[at] = cost, trace
                    for s, o, c, t in waiting[origin].get(name, ()):
                        moves.append((at, s + 1, o, c + cost, t if trace is None else trace if t is None else (t, trace)))
            elif symbol in rules:
                waiting[at].setdefault(symbol, []).append((state, origin, cost, trace))
                if symbol not in before[at]:
                    before[at][symbol] = total
                    moves = [(at, s, at, 0, None) for s in begin[symbol]]
                for end, (c, t) in complete[at].get(symbol, {}).items():
                    moves.append((end, state + 1, origin, cost + c, t if trace is None else trace if t is None else (trace, t)))
            else:
                moves.append((at, state + 1, origin, cost + 1, (trace, "insert", at, symbol)))
                if at < size:
                    token = tokens[at]
                    moves.append((at + 1, state, origin, cost + 1, (trace, "delete", at, token)))
                    moves.append((at + 1, state + 1, origin, cost, trace) if symbol == token else (at + 1, state + 1, origin, cost + 1, (trace, "replace", at, symbol)))
            for move in moves:
                to, s, o, c, _ = move
                known = best[to].get((s, o))
                if known is None or c < known:
                    best[to][s, o] = c
                    queue[before[o][head[s]] + c + need[to][s]].append(move)


class Ahead:
    """How many edits the rest of a string needs at least, for every state of the rules that ``start`` holds.

    Taken from the finite automaton of these rules' states in which a rule that
    ends goes on after any place that expects it. It holds every sentence of
    the grammar (and more), so the edits that it needs are never too many.
    """

    def __init__(self, grammar: Grammar, start: str):
        held, todo = {start}, [start]
        while todo:
            for alt in grammar.rules[todo.pop()]:
                for x in alt:
                    if x in grammar.rules and x not in held:
                        held.add(x)
                        todo.append(x)
        after, rules = grammar.after, grammar.rules
        self.width = len(after)
        self.states = [s for s, name in enumerate(grammar.head) if name in held]
        place = {s: i for i, s in enumerate(self.states)}
        ends: dict[str, list[int]] = defaultdict(list)
        for s in self.states:
            if after[s] is None:
                ends[grammar.head[s]].append(place[s])
        # sets of states as bits of one number each
        free = [1 << i for i in range(len(self.states))]
        for s in self.states:
            if after[s] in rules:
                free[place[s]] |= sum(1 << place[b] for b in grammar.begin[after[s]])
                for e in ends[after[s]]:
                    free[e] |= 1 << place[s] + 1
        edges = [_members(x) for x in free]
        changed = True
        while changed:  # all states that are reached without a token
            changed = False
            for i, to in enumerate(edges):
                more = free[i]
                for j in to:
                    more |= free[j]
                if more != free[i]:
                    free[i], changed = more, True
        by_token: dict[str, list[int]] = defaultdict(list)
        for s in self.states:
            if after[s] is not None and after[s] not in rules:
                by_token[after[s]].append(place[s])
        steps = [i for v in by_token.values() for i in v]
        mask = sum(1 << i for i in steps)
        rows: dict[int, np.ndarray] = {}
        for x in set(free):  # least number of tokens from there to each state
            row, seen, new, n = np.full(len(free), 1 << 13, np.int16), x, x, 0
            while new:
                row[_members(new)] = n
                reached = 0
                for i in _members(new & mask):
                    reached |= free[i + 1]
                new, seen, n = reached & ~seen, seen | reached, n + 1
            rows[x] = row
        kinds = {x: i for i, x in enumerate(rows)}
        self.far = np.stack(list(rows.values()))
        self.kind = np.array([kinds[x] for x in free])
        self.by_token = {t: np.array(v) for t, v in by_token.items()}
        self.before_token = np.array(sorted(steps))
        self.final = np.array(ends[start])

    def least(self, tokens: list[str]) -> list[list[int]]:
        """For each place and state (of the whole grammar) the least number of edits of the tokens from there on."""
        out = np.zeros((len(tokens) + 2, self.width), np.int16)
        now = self.far[:, self.final].min(axis=1)[self.kind]
        none = np.zeros(0, np.int64)
        for at in range(len(tokens), -1, -1):
            if at < len(tokens):
                base = now + 1  # the token is deleted
                base[self.before_token] = np.minimum(base[self.before_token], now[self.before_token + 1] + 1)
                same = self.by_token.get(tokens[at], none)
                base[same] = np.minimum(base[same], now[same + 1])
                now = (self.far + base).min(axis=1)[self.kind]
            out[at, self.states] = now
        return out.tolist()


def _members(bits: int) -> list[int]:
    data = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little")).tolist()


def compile_rules(text: str) -> Grammar:
    """Grammar of rules with ``|``, ``( )``, ``?``, ``*`` and ``+``; these marks as tokens are written in quotes."""
    out = []
    for word in text.replace("\n", " \n ").split(" "):
        if word in ("|", "(", ")", "?", "*", "+"):
            out.append({"|": "¦", "(": "⟨", ")": "⟩", "?": "⁇", "*": "⁎", "+": "⁺"}[word])
        elif len(word) > 2 and word[0] == word[-1] == "'":
            out.append(word[1:-1])
        else:
            out.append(word)
    return Grammar(" ".join(out).replace(" \n ", "\n"))
