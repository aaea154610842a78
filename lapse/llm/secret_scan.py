"""Secret scan with one combined deterministic automaton.

The rules are regular expressions over bytes.  Each is parsed to an NFA; subset
construction over all rules, with a restart at every byte, and Moore minimisation
give one transition array ``next[state, byte class]`` and one bit mask of accepting
rules per state.  All rules are scanned in one pass over the bytes: a batch of texts
is cut into lanes that step through the array together (NumPy gathers), each lane
starting from the start state; where that guess differs from the state the previous
lane ends in, the lane is run again from the right one until none differs.  Texts are
parted by a byte that no rule holds, so no match crosses texts.

The pass yields the ends where a rule accepts.  Starts come from the rule's reversed
automaton and full (greedy) ends from its forward one, only at those few places;
matches are then taken leftmost and non-overlapping per rule, and only afterwards
those below the rule's least length are dropped.  Only the run rule has its length
bound in the expression, where it can't change which matches are found: counting a
tail that may hold the rule's own prefix would multiply the subsets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lapse.llm.common import column_bytes, map_batches, slices, texts


@dataclass(frozen=True)
class Rule:
    """``pattern`` is scanned for; ``tail`` is the class whose run ends a match; a match
    stays if its tail, or all of it with ``whole``, has at least ``least`` bytes."""

    kind: str
    pattern: str
    tail: str
    least: int = 0
    whole: bool = False


# The base rules, then the added ones (published key formats).
_VALUE = "[A-Za-z0-9+/_.=\\-]"
_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE_RULES = (
    Rule("assign", f"{_KEYWORD}[\"']?\\x20*[:=]\\x20*[\"']?{_VALUE}", _VALUE, 12),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]", 18, True),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]", 16, True),
)
MORE_RULES = (
    Rule("github", "gh[opusr]_[A-Za-z0-9]", "[A-Za-z0-9]", 40, True),
    Rule("slack", "xox[abprs]-[A-Za-z0-9\\-]", "[A-Za-z0-9\\-]", 15, True),
    Rule("google", "AIza[A-Za-z0-9_\\-]", "[A-Za-z0-9_\\-]", 39, True),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+[.]eyJ[A-Za-z0-9_\\-]+[.][A-Za-z0-9_\\-]", "[A-Za-z0-9_\\-]", 36, True),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", "", 27, True),
)
PART = 0xFF                               # never a byte of UTF-8


# Regular expressions to NFAs: nodes are (edges by byte set, empty edges).

class Nfa:
    def __init__(self):
        self.moves: list[list[tuple[np.ndarray, int]]] = []
        self.empty: list[list[int]] = []

    def node(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1


def byte_set(text: str) -> np.ndarray:
    """The bytes of a class like ``[A-Z0-9_\\-]``."""
    out, items, i = np.zeros(256, bool), [], 1
    while text[i] != "]":
        if text[i] == "\\":
            i += 1
            items.append((text[i], True))
        else:
            items.append((text[i], False))
        i += 1
    k = 0
    while k < len(items):
        if k + 2 < len(items) and items[k + 1] == ("-", False):
            out[ord(items[k][0]):ord(items[k + 2][0]) + 1] = True
            k += 3
        else:
            out[ord(items[k][0])] = True
            k += 1
    return out


def parse(pattern: str):
    """A tree of ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, low, high)."""
    at = 0

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(counted(single()))
        return ("cat", parts)

    def single():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        one = np.zeros(256, bool)
        if c == "[":
            end = at + 1
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            one = byte_set(pattern[at:end + 1])
            at = end + 1
        elif c == "\\":
            width = 4 if pattern[at + 1] == "x" else 2
            one[int(pattern[at + 2:at + 4], 16) if width == 4 else ord(pattern[at + 1])] = True
            at += width
        else:
            one[ord(c)] = True
            at += 1
        return ("set", one)

    def counted(part):
        nonlocal at
        if at < len(pattern) and pattern[at] in "*+?{":
            c = pattern[at]
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c, (0, 0))
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, top = pattern[at:end].partition(",")
                low, high = int(low), (int(top) if top else None if comma else int(low))
                at = end + 1
            return ("rep", part, low, high)
        return part

    return alternatives()


def reverse(tree):
    if tree[0] == "cat":
        return ("cat", [reverse(p) for p in tree[1][::-1]])
    if tree[0] == "alt":
        return ("alt", [reverse(p) for p in tree[1]])
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return tree


def build(nfa: Nfa, tree, start: int) -> int:
    """Add the tree's paths from ``start``; returns their end."""
    if tree[0] == "set":
        end = nfa.node()
        nfa.moves[start].append((tree[1], end))
        return end
    if tree[0] == "cat":
        for part in tree[1]:
            start = build(nfa, part, start)
        return start
    if tree[0] == "alt":
        end = nfa.node()
        for part in tree[1]:
            nfa.empty[build(nfa, part, start)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = build(nfa, part, start)
    if high is None:
        loop = nfa.node()
        nfa.empty[start].append(loop)
        nfa.empty[build(nfa, part, loop)].append(loop)
        return loop
    end = nfa.node()
    nfa.empty[start].append(end)
    for _ in range(high - low):
        start = build(nfa, part, start)
        nfa.empty[start].append(end)
    return end


class Automaton:
    """``step[state * n_classes + class_of[byte]]`` and ``accepts[state]`` (bit per rule).

    State 0 is the start.  With ``anywhere`` a match may begin at every byte; else state
    ``dead`` is entered when none can follow.
    """

    def __init__(self, trees: list, anywhere: bool):
        nfa = Nfa()
        start = nfa.node()
        ends = {}
        for k, tree in enumerate(trees):
            first = nfa.node()
            nfa.empty[start].append(first)
            ends[build(nfa, tree, first)] = 1 << k
        self.class_of, samples = self._classes(nfa)
        self._subsets(nfa, start, ends, samples, anywhere)
        self._minimise()

    @staticmethod
    def _classes(nfa: Nfa) -> tuple[np.ndarray, np.ndarray]:
        sets = [s for moves in nfa.moves for s, _ in moves]
        table = np.unique(np.array(sets), axis=0).T if sets else np.zeros((256, 1), bool)
        _, samples, class_of = np.unique(table, axis=0, return_index=True, return_inverse=True)
        return class_of.reshape(-1).astype(np.uint8), samples

    def _subsets(self, nfa: Nfa, start: int, ends: dict[int, int], samples: np.ndarray, anywhere: bool) -> None:
        def closed(nodes) -> frozenset:
            seen, todo = set(nodes), list(nodes)
            while todo:
                for m in nfa.empty[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            return frozenset(seen)

        first = closed([start])
        number, order, step = {first: 0}, [first], []
        for nodes in order:               # grows while it is read
            for byte in samples:
                after = {to for n in nodes for s, to in nfa.moves[n] if s[byte]}
                target = closed(after | {start}) if anywhere else closed(after)
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                step.append(number[target])
        self.n_classes = len(samples)
        self.step = np.array(step, np.int32).reshape(-1, self.n_classes)
        self.accepts = np.array([sum({ends[n] for n in nodes if n in ends}) for nodes in order], np.int32)
        self._dead = number.get(frozenset(), -1)

    def _minimise(self) -> None:
        """Moore: split blocks of states by the blocks they go to until none splits."""
        block = np.unique(self.accepts, return_inverse=True)[1].reshape(-1)
        while True:
            rows = np.column_stack([block, block[self.step]])
            finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        swap = np.arange(block.max() + 1)
        swap[[0, block[0]]] = swap[[block[0], 0]]                    # the start becomes 0
        block = swap[block]
        keep = np.unique(block, return_index=True)[1]
        self.step = block[self.step[keep]].astype(np.int32)
        self.accepts = self.accepts[keep]
        self.dead = int(block[self._dead]) if self._dead >= 0 else -1
        # One flat array over bytes: next state times 256, so that a step is one gather.
        self.by_byte = (self.step[:, self.class_of] * 256).astype(np.int32).reshape(-1)

    def run(self, data: np.ndarray, lane: int = 1024) -> np.ndarray:
        """The mask of accepting rules after each byte, zeros elsewhere."""
        n = len(data)
        lanes = -(-n // lane)
        grid = np.full((lanes, lane), PART, np.uint8)
        grid.reshape(-1)[:n] = data
        columns = np.ascontiguousarray(grid.T)
        states = np.zeros((lane, lanes), np.int32)
        begin = np.zeros(lanes, np.int32)
        todo = np.arange(lanes)
        while len(todo):
            state = begin[todo]
            whole = len(todo) == lanes
            for i in range(lane):
                state = self.by_byte[state + (columns[i] if whole else columns[i, todo])]
                if whole:
                    states[i] = state
                else:
                    states[i, todo] = state
            right = np.concatenate([np.zeros(1, np.int32), states[-1, :-1]])
            todo = np.flatnonzero(right != begin)
            begin = right
        return self.accepts[states.T.reshape(-1)[:n] >> 8]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.all = Automaton(trees, anywhere=True)
        self.back = [Automaton([reverse(t)], anywhere=False) for t in trees]
        self.tail = [byte_set(r.tail) if r.tail else np.zeros(256, bool) for r in rules]

    def start_of(self, rule: int, text: bytes, end: int, first: int) -> int:
        """The leftmost start, not before ``first``, of a match of the rule that ends at ``end``; -1 if none."""
        back, state, at, best = self.back[rule], 0, end, -1
        while at > first:
            state = int(back.by_byte[(state << 8) + text[at - 1]]) >> 8
            if state == back.dead:
                break
            at -= 1
            if back.accepts[state]:
                best = at
        return best

    def spans(self, text: bytes, masks: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) by start of all matches that stay, in bytes."""
        found, places = [], np.flatnonzero(masks)
        codes = np.frombuffer(text, np.uint8)
        for k, rule in enumerate(self.rules):
            taken = 0
            for end in places[(masks[places] >> k & 1).astype(bool)] + 1:
                if end <= taken:
                    continue
                start = self.start_of(k, text, int(end), taken)
                if start < 0:
                    continue
                stop = int(end)
                if self.tail[k].any():
                    rest = codes[stop:]
                    step = 256
                    while stop < len(text):                          # to the end of the tail's run
                        run = np.flatnonzero(~self.tail[k][rest[:step]])
                        if len(run) or step >= len(rest):
                            stop = int(end) + (int(run[0]) if len(run) else len(rest))
                            break
                        step *= 8
                taken = stop
                size = stop - start if rule.whole else stop - (int(end) - 1)
                if size >= rule.least:
                    found.append((start, k, stop))
        return sorted(found)

    def scan(self, offsets: np.ndarray, data: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Spans per text, in code points."""
        n = len(offsets) - 1
        if n <= 0:
            return []
        parted = np.full(len(data) + n, PART, np.uint8)              # a parting byte after each text
        parted[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
        at = offsets + np.arange(n + 1)
        masks = self.all.run(parted)
        hit = np.unique(np.searchsorted(at, np.flatnonzero(masks), side="right") - 1)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for i in hit:
            a, b = int(at[i]), int(at[i + 1]) - 1
            text = parted[a:b]
            spans = self.spans(text.tobytes(), masks[a:b])
            if spans and (text >= 128).any():
                points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                spans = [(int(points[s]), k, int(points[e])) for s, k, e in spans]
            out[i] = spans
        return out


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def batch_spans(rules: tuple[Rule, ...], column: pa.Array, block: int = 1 << 20):
    offsets, data = column_bytes(column)
    for a, b in slices(offsets, block):
        yield from scanner(rules).scan(offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, n_base: int = len(BASE_RULES),
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256, spans (kind:start:end by start, then
    rule order; code points, end exclusive), one row per input row in one narrow pass.

    Null and empty texts have no spans (digest of the empty string); repeated rows and null
    ids each get a row; a very long text is one block of its own; extra columns are ignored.
    """
    counted = [r.kind for r in rules[:n_base]]

    def run(batch):
        rows = []
        for spans in batch_spans(rules, batch.column(1)):
            named = [(k, f"{rules[k].kind}:{s}:{e}") for s, k, e in spans]
            base = ",".join(t for k, t in named if k < n_base)
            rows.append((*(sum(k == i for k, _ in named) for i in range(n_base)),
                         hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in named)))
        columns = list(zip(*rows))
        types = [pa.int64()] * n_base + [pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                                          ["doc_id", *(f"n_{k}" for k in counted), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in counted)
    return map_batches(texts(docs, id_col, text_col), run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text",
           mask: str = "[{kind}]") -> DataFrame:
    """``docs`` with each secret in ``text_col`` replaced by a mark of its kind (spans that
    touch or overlap become one, under the first kind).  All columns and rows stay; null
    text stays null."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batch):
        column = batch.column(at)
        out = []
        for value, spans in zip(column, batch_spans(rules, column.fill_null(""))):
            text = value.as_py()
            if spans:
                parts, end = [], 0
                for s, k, e in spans:
                    if s >= end:
                        parts += [text[end:s], mask.format(kind=rules[k].kind)]
                    end = max(end, e)
                text = "".join(parts) + text[end:]
            out.append(text)
        arrays = batch.columns
        arrays[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return map_batches(docs, run, schema)
