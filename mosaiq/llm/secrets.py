"""Secret scans with one combined deterministic automaton.

The rules are regexes over bytes (literals, classes, groups, alternatives, ? * + {m} {m,}).  Each regex is parsed and
becomes a nondeterministic automaton (Thompson's construction), a deterministic one (subset construction) and a
minimal one (partition refinement).  The combined automaton of all rules runs over the bytes once: texts are laid out in pieces of equal
length that run side by side in numpy, and pieces that should not have begun in the start state run again up to where they
agree with what is known.  States that last through whole pieces are looked up from runs of all pieces side by side, so no piece waits for the one
before, whatever the text: at most as many runs as the automaton has states, and two or three where one byte fills megabytes.  It reports where a rule's match has become
long enough to be kept.  Around such places the rule's own automaton, anchored, reads off the spans: between
bytes that no match of the rule can hold, the leftmost longest matches from left to right, of which those
that are long enough are kept.

Null text counts as empty; an empty table gives an empty result; repeated rows are scanned alike.
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm.common import encoded, small, table


@dataclass(frozen=True)
class Rule:
    """kind; a regex, whose matches are kept if `group` has `least` characters or more; and how much of that the combined
    automaton waits for.  Any wait gives the same spans: a short one saves states where a rule's first characters are rare."""

    kind: str
    regex: str
    group: int
    least: int
    wait: int | None = None


#: The contract's kinds, in its order.
BASE = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, 6),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What the method adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 24, 5),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, 6),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
RULES = BASE + MORE

# ---- from a regex to a minimal automaton --------------------------------------------------------
# A tree is ("set", bytes), ("cat", trees), ("or", trees), ("rep", tree, least, most or None) or ("group", tree).


def parse(regex: str) -> tuple:
    """The tree of a regex over ASCII.  What this language lacks raises ValueError."""
    at = 0

    def peek() -> str:
        return regex[at:at + 1]

    def escaped() -> str:
        nonlocal at
        at += 1
        if peek() == "x":
            at += 3
            return chr(int(regex[at - 2:at], 16))
        if not peek() or peek().isalnum():
            raise ValueError(f"escape at {at} in {regex}")
        at += 1
        return regex[at - 1]

    def one() -> str:
        nonlocal at
        if peek() == "\\":
            return escaped()
        at += 1
        return regex[at - 1]

    def letters(chars: set[str], fold: bool) -> tuple:
        if fold:
            chars = {x for c in chars for x in (c.lower(), c.upper())}
        return "set", frozenset("".join(sorted(chars)).encode("ascii"))

    def union(fold: bool) -> tuple:
        nonlocal at
        options = [chain(fold)]
        while peek() == "|":
            at += 1
            options.append(chain(fold))
        return options[0] if len(options) == 1 else ("or", tuple(options))

    def chain(fold: bool) -> tuple:
        nonlocal at
        items = []
        while peek() and peek() not in "|)":
            item = atom(fold)
            if (m := re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}").match(regex, at)):
                at = m.end()
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(m[0]) or (int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
                item = ("rep", item, least, most)
            items.append(item)
        return "cat", tuple(items)

    def atom(fold: bool) -> tuple:
        nonlocal at
        if peek() == "(":
            marked = not regex.startswith("(?", at)
            if not marked:
                m = re.compile(r"\(\?(ai|)?:").match(regex, at)
                if not m:
                    raise ValueError(f"group at {at} in {regex}")
                at, fold = m.end(), fold or m[1] == "ai"
            else:
                at += 1
            inner = union(fold)
            if peek() != ")":
                raise ValueError(f"open group in {regex}")
            at += 1
            return ("group", inner) if marked else inner
        if peek() == "[":
            at += 1
            chars: set[str] = set()
            if peek() == "^":
                raise ValueError(f"negated class in {regex}")
            while peek() != "]":
                a = one()
                if peek() == "-" and regex[at + 1:at + 2] != "]":
                    at += 1
                    chars |= set(map(chr, range(ord(a), ord(one()) + 1)))
                else:
                    chars.add(a)
            at += 1
            return letters(chars, fold)
        if peek() in ".^$?*+{})":
            raise ValueError(f"{peek()} at {at} in {regex}")
        return letters({one()}, fold)

    tree = union(False)
    if at < len(regex):
        raise ValueError(f"unread: {regex[at:]}")
    return tree


def width(tree: tuple) -> int:
    """The number of characters of every match; ValueError if matches differ in it."""
    kind, body = tree[:2]
    if kind == "set":
        return 1
    if kind == "group":
        return width(body)
    if kind == "cat":
        return sum(map(width, body))
    if kind == "or" and len({width(t) for t in body}) == 1:
        return width(body[0])
    if kind == "rep" and tree[2] == tree[3]:
        return tree[2] * width(body)
    raise ValueError("matches of unlike length")


def at_least(tree: tuple, group: int, least: int) -> tuple:
    """The tree of the matches whose group (0: all, 1: the marked one) has `least` characters or more.

    The regex must end with the group, and the group with a repeated class that its remainder, of fixed length, can't run into."""
    kind, body = tree[:2]
    if kind == "cat" and body:
        rest = width(("cat", body[:-1])) if group == 0 else 0
        return "cat", (*body[:-1], at_least(body[-1], group, max(0, least - rest)))
    if kind == "group":
        return "group", at_least(body, 0, least)
    if kind == "rep" and group == 0 and tree[3] is None:
        return "rep", body, max(tree[2], -(-least // width(body))), None
    if group == 0 and width(tree) >= least:
        return tree
    raise ValueError("no repeated class to lengthen")


@dataclass(frozen=True)
class Automaton:
    """step[state, byte], and a bit mask of rules per state.  State 0 starts.  If anchored, a byte that no match goes on with leads to dead."""

    step: np.ndarray
    masks: np.ndarray
    dead: int | None = None

    @cached_property
    def resets(self) -> np.ndarray:
        """Bytes that lead every state to the start: no match holds them."""
        return (self.step == 0).all(axis=0)

    @cached_property
    def loops(self) -> list[bytes]:
        """The bytes that leave each state as it is."""
        return [bytes(np.flatnonzero(row == k).tolist()) for k, row in enumerate(self.step)]

    @cached_property
    def rows(self) -> list[list[int]]:
        return self.step.tolist()

    def end(self, data: bytes, at: int, stop: int) -> int:
        """The end of the longest match from a place on; -1 if there is none."""
        state, best, rows = 0, -1, self.rows
        while at < stop:
            to = rows[state][data[at]]
            if to == self.dead:
                break
            at += 1
            if to == state:  # the run of bytes that change nothing is passed at once
                wide = 64
                while at < stop:
                    part = data[at:min(at + wide, stop)]
                    rest = len(part.lstrip(self.loops[state]))
                    at, wide = at + len(part) - rest, 2 * wide
                    if rest:
                        break
            state = to
            if self.masks[state]:
                best = at
        return best


def _thompson(trees: list[tuple]) -> tuple[list[list[tuple[frozenset[int], int]]], list[list[int]], dict[int, int]]:
    """Moves on bytes, empty moves, and the tree that a state accepts.  State 0 is the start."""
    moves: list[list] = [[]]
    empty: list[list[int]] = [[]]

    def new() -> int:
        moves.append([])
        empty.append([])
        return len(moves) - 1

    def build(at: int, tree: tuple) -> int:
        kind, body = tree[:2]
        if kind == "set":
            to = new()
            moves[at].append((body, to))
            return to
        if kind == "group":
            return build(at, body)
        if kind == "cat":
            for part in body:
                at = build(at, part)
            return at
        if kind == "or":
            end = new()
            for part in body:
                begin = new()
                empty[at].append(begin)
                empty[build(begin, part)].append(end)
            return end
        for _ in range(tree[2]):
            at = build(at, body)
        end = new()
        if tree[3] is None:
            begin = new()
            empty[at].append(begin)
            empty[build(begin, body)].append(begin)
            empty[begin].append(end)
        else:
            for _ in range(tree[3] - tree[2]):
                empty[at].append(end)
                at = build(at, body)
            empty[at].append(end)
        return end

    accepts = {}
    for k, tree in enumerate(trees):
        begin = new()
        empty[0].append(begin)
        accepts[build(begin, tree)] = k
    return moves, empty, accepts


def compile_trees(trees: list[tuple], anchored: bool = False) -> Automaton:
    """The minimal automaton of all trees.  Unless anchored, a match may begin at any byte."""
    moves, empty, accepts = _thompson(trees)

    def close(states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    # Bytes that no rule tells apart share a class.
    sets = {on for row in moves for on, _ in row}
    signs = [tuple(b in on for on in sets) for b in range(256)]
    classes = {s: k for k, s in enumerate(dict.fromkeys(signs))}
    byte_class = np.array([classes[s] for s in signs])
    sample = {k: next(b for b in range(256) if byte_class[b] == k) for k in classes.values()}
    start = close({0})
    ids, rows, todo = {start: 0}, [], [start]
    while todo:
        states = todo.pop(0)
        row = []
        for k in range(len(classes)):
            to = close({*(() if anchored else (0,)), *(t for s in states for on, t in moves[s] if sample[k] in on)})
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    masks = np.array([sum(1 << k for s, k in accepts.items() if s in states) for states in ids], np.int64)
    step = np.array(rows)
    # Minimise: split blocks of states until all of a block agree on the blocks that they lead to.
    block = np.unique(masks, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    swap = np.arange(len(first))
    swap[[0, block[0]]] = swap[[block[0], 0]]  # the start is state 0
    small_step = np.empty((len(first), len(classes)), np.int64)
    small_step[swap] = swap[block[step[first]]]
    small_masks = np.empty(len(first), np.int64)
    small_masks[swap] = masks[first]
    dead = np.flatnonzero((small_masks == 0) & (small_step == np.arange(len(first))[:, None]).all(axis=1))
    return Automaton(small_step[:, byte_class].astype(np.uint16), small_masks, int(dead[0]) if anchored and len(dead) else None)


@dataclass(frozen=True)
class Scanner:
    """The combined automaton; and for each rule the anchored automata of its matches and of those that are kept, and the bytes that no match holds."""

    rules: tuple[Rule, ...]
    combined: Automaton
    matches: list[Automaton]
    kept: list[Automaton]
    outside: list[np.ndarray]

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> Scanner:
        trees = [parse(r.regex) for r in rules]
        seen = [at_least(t, r.group, r.least if r.wait is None else min(r.wait, r.least)) if r.least else t for t, r in zip(trees, rules, strict=True)]
        kept = [at_least(t, r.group, r.least) if r.least else t for t, r in zip(trees, rules, strict=True)]
        alone = [compile_trees([t], anchored=True) for t in trees]
        if any(a.masks[0] for a in alone):
            raise ValueError("a rule matches nothing at all")
        return cls(rules, compile_trees(seen), alone, [compile_trees([t], anchored=True) for t in kept], [compile_trees([t]).resets for t in trees])

    def spans(self, data: bytes, mask: int, where: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, end, kind) in bytes of one text's kept matches, by start; where: places at which the combined automaton reported a rule of the mask."""
        found, codes = [], np.frombuffer(data, np.uint8)
        for k, rule in enumerate(self.rules):
            if not mask >> k & 1:
                continue
            walls = np.concatenate([[-1], np.flatnonzero(self.outside[k][codes]), [len(data)]])
            opens = self.matches[k].step[0] != (self.matches[k].dead if self.matches[k].dead is not None else -1)
            for wall in np.unique(np.searchsorted(walls, where)).tolist():  # the stretches between walls that hold reported places
                a, z = int(walls[wall - 1]) + 1, int(walls[wall])
                at = a
                for i in (a + np.flatnonzero(opens[codes[a:z]])).tolist():
                    if i >= at and (end := self.matches[k].end(data, i, z)) >= 0:
                        at = end
                        if self.kept[k].end(data, i, end) == end:
                            found.append((i, k, end, rule.kind))
        return [(s, e, kind) for s, _, e, kind in sorted(found)]


def _rerun(flat: np.ndarray, grid: np.ndarray, trail: np.ndarray, lanes: np.ndarray, state: np.ndarray, write: bool) -> np.ndarray:
    """Where the lanes end if they begin in the given states.  Each runs up to where it agrees with its trail; with write, the trail is put right."""
    ends = trail[-1, lanes].astype(np.int64)
    at = np.arange(len(lanes))
    for i in range(len(grid)):
        if not len(at):
            break
        state = flat[(state << 8) | grid[i, lanes[at]]].astype(np.int64)
        new = state != trail[i, lanes[at]]
        at, state = at[new], state[new]
        if write:
            trail[i, lanes[at]] = state
    ends[at] = state
    return ends


def hits(data: np.ndarray, automaton: Automaton, piece: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places after whose byte a rule is accepted, and their rule masks."""
    n = len(data)
    lanes = max(1, -(-n // piece))
    grid = np.zeros(lanes * piece, np.uint8)
    grid[:n] = data
    grid = np.ascontiguousarray(grid.reshape(lanes, piece).T)
    flat = np.ascontiguousarray(automaton.step.reshape(-1))
    trail = np.empty((piece, lanes), np.uint16)
    state = np.zeros(lanes, np.int64)
    for i in range(piece):
        state = flat[(state << 8) | grid[i]].astype(np.int64)
        trail[i] = state
    # A piece begins where the one before ends.  Those that were begun in another state run again, up to where nothing changes.
    begun = np.zeros(lanes, np.int64)
    right = np.concatenate([[0], trail[-1, :-1].astype(np.int64)])
    again = np.flatnonzero(right != begun)
    _rerun(flat, grid, trail, again, right[again], write=True)
    begun[again] = right[again]
    again = np.flatnonzero(np.concatenate([[0], trail[-1, :-1].astype(np.int64)]) != begun)
    if len(again):
        # Pieces whose state goes on through the next one would wait for each other.  So all pieces run from each state that goes on
        # (until no further one does), which gives where a piece ends for where it begins; a walk over the pieces looks that up.
        known: dict[int, np.ndarray] = {}
        todo = set(trail[-1, again - 1].tolist())
        every, last = np.arange(lanes), trail[-1].astype(np.int64)
        while todo:
            state = todo.pop()
            known[state] = _rerun(flat, grid, trail, every, np.full(lanes, state), write=False)
            todo |= set(known[state][known[state] != last].tolist()) - known.keys()
        state, wrong = int(last[again[0] - 1]), []
        for k, (was, end) in enumerate(zip(begun[again[0]:].tolist(), last[again[0]:].tolist(), strict=True), int(again[0])):
            if state == was:
                state = end
            else:
                wrong.append((k, state))
                state = int(known[state][k])
        fix, states = np.array(wrong, np.int64).reshape(-1, 2).T
        _rerun(flat, grid, trail, fix, states, write=True)
    where = np.flatnonzero((automaton.masks > 0)[trail].T.reshape(-1))
    where = where[where < n]
    return where, automaton.masks[trail[where % piece, where // piece]]


def _scan(rules: tuple[Rule, ...]):
    scanner = Scanner.of(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            texts = encoded(b.column("text"))
            begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
            where, what = hits(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), scanner.combined)
            spans: list[list] = [[] for _ in texts]
            rows = np.searchsorted(begin, where, "right") - 1
            edges = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                r = rows[a]
                found = scanner.spans(texts[r], int(np.bitwise_or.reduce(what[a:z])), where[a:z] - begin[r])
                if found:
                    points = np.concatenate([[0], np.cumsum(np.frombuffer(texts[r], np.uint8) & 0xC0 != 0x80)]) if not texts[r].isascii() else range(len(texts[r]) + 1)
                    spans[r] = [{"start": int(points[s]), "end": int(points[e]), "kind": k} for s, e, k in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], ["doc_id", "spans"])

    return scan


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (start, end, kind), for each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(rules), f"doc_id {kind}, spans array<struct<start: long, end: long, kind: string>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = "cast(size(filter(spans, s -> s.kind = '{0}')) AS long) AS n_{0}"
    base = "filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))"
    return scan_secrets(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", *(count.format(r.kind) for r in BASE), f"sha2({listed.format(base)}, 256) AS base_sha256", f"{listed.format('spans')} AS spans")


def exact_spans(text: str, rules: list[Rule]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the matches that are long enough, in order, from the regex engine; for tests."""
    found = [(m.start(), k, m.end(), r.kind) for k, r in enumerate(rules) for m in re.finditer(r.regex, text) if len(m[r.group]) >= r.least]
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def brute(text: str | None) -> tuple[int, int, int, str]:
    """The contract's base columns for one text, from the regexes alone; for tests."""
    spans = exact_spans(text or "", list(BASE))
    kinds = [k for _, _, k in spans]
    return (*(kinds.count(r.kind) for r in BASE), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest())
