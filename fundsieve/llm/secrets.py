r"""Secret scans through a trigram inverted index (operator 1).

From each rule's regular expression a Boolean query over trigrams is derived: a disjunction of conjunctions, one of
which every match satisfies. Documents are indexed block by block (4 MB of texts are a block, so a block's postings
lie in one task and nothing is shuffled): postings map a trigram to the sorted row numbers that hold it, and only
trigrams that some query names are posted. Intersecting and uniting postings gives each rule's candidate rows, and
the regular expression is run on those only. A rule without a mandatory trigram scans every row.

The index folds A-Z to lower case, so one index serves rules of either case; it may only add candidates.

Defined results: a null text is empty. Rows are independent: repeated rows and null ids come out as they went in.
Extra columns are not read. Empty tables give empty tables. Texts are read whole; positions are code points.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, tidy

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as parser


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base kinds, (kind, expression, least length of the group, group).
BASE_RULES = (
    ("assign", "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]+", 24, 0),
)
#: What may stand between the runs of a key: line ends as they are or escaped, quotes, marks of comments.
BETWEEN = r"(?:\\[nrt]|[^A-Za-z0-9])"
#: A private key from BEGIN through END, up to which no other run of five hyphens stands; without END the base64 runs
#: that follow, the last of which may be short, and a short one only if it starts the next line.
PRIVATE_KEY = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:[^\S\n]*\n\s*(?:Proc-Type|DEK-Info):[^\n]*)*(?:{BETWEEN}{{1,64}}[A-Za-z0-9+/]{{20,}}={{0,2}})+(?:(?:\\[nrt]|[^A-Za-z0-9\n])*\n?(?:\\[nrt]|[^A-Za-z0-9\n])*[A-Za-z0-9+/]+={{0,2}})?"
    r"|[\x20\t\r]*(?:\n|\\n)[\x20\t]*[A-Za-z0-9+/]+={0,2})?"
)
#: Public formats of further credentials.
MORE_RULES = (
    ("private_key", PRIVATE_KEY, 0, 0),
    ("forge", "gh[oprsu]_[A-Za-z0-9]+", 40, 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", 20, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
    ("bearer", either_case("bearer") + r"\x20+([A-Za-z0-9._~+/=-]+)", 20, 1),
)
RULES = BASE_RULES + MORE_RULES
#: The runs of a jwt with the dots between them.
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")


def dotted_spans(text: str) -> list[tuple[int, int]]:
    """The matches of the jwt rule, in one pass: a run that the expression gives up at would be read again from each eyJ."""
    out = []
    for m in DOTTED.finditer(text):
        runs, start, k = m[0].split("."), m.start(), 0
        while k + 2 < len(runs):
            at = runs[k].find("eyJ")
            end = start + sum(map(len, runs[k : k + 3])) + 2
            if 0 <= at < len(runs[k]) - 3:
                out.append((start + at, end))
                start, k = end + 1, k + 3
            else:
                start, k = start + len(runs[k]) + 1, k + 1
    return out


def finder(rule):
    """A function from a text to the spans of a rule."""
    kind, expression, least, group = rule
    if kind == "jwt" and rule in MORE_RULES:
        return lambda text: [x for x in dotted_spans(text) if x[1] - x[0] >= least]
    found = re.compile(quick(expression, least, group)).finditer
    return lambda text: [m.span() for m in found(text) if m.end(group) - m.start(group) >= least]


#: Alternatives that one query keeps apart; more of them are widened to "any text", never dropped.
BRANCHES = 64


class Text:
    """What a part of an expression can match: some exact strings, or strings known by their ends and trigrams."""

    def __init__(self, exact=None, head=("",), tail=("",), grams=(frozenset(),)):
        self.exact = exact
        self.head, self.tail, self.grams = (exact, exact, None) if exact is not None else (frozenset(head), frozenset(tail), grams)

    def opened(self) -> "Text":
        """The same without exact strings: a clause of trigrams for each."""
        if self.exact is None:
            return self
        return Text(None, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact}, simplify([frozenset(trigrams(s)) for s in self.exact]))


def trigrams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


def simplify(clauses) -> tuple[frozenset[str], ...]:
    """A disjunction without clauses that others imply."""
    kept: list[frozenset[str]] = []
    for c in sorted(set(clauses), key=len):
        if not any(k <= c for k in kept):
            kept.append(c)
    return tuple(kept) if len(kept) <= BRANCHES else (frozenset(),)


def then(a: Text, b: Text) -> Text:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= BRANCHES:
        return Text(frozenset(x + y for x, y in product(a.exact, b.exact)))
    whole = lambda x: x.exact if x.exact is not None else None
    left, right = a.opened(), b.opened()
    across = simplify([frozenset(trigrams(x[-2:] + y[:2])) for x, y in product(a.tail, b.head)])
    grams = simplify([x | y | z for x, y, z in product(left.grams, across, right.grams)])
    head = frozenset(x + y[:2] for x, y in product(whole(a), b.head)) if whole(a) else a.head
    tail = frozenset(x[-2:] + y for x, y in product(a.tail, whole(b))) if whole(b) else b.tail
    short = lambda s, cut: frozenset(map(cut, s)) if len(s) <= BRANCHES else frozenset({""})
    return Text(None, short(head, lambda s: s[:2]), short(tail, lambda s: s[-2:]), grams)


def either(parts: list[Text]) -> Text:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= BRANCHES:
        return Text(frozenset().union(*(p.exact for p in parts)))
    opened = [p.opened() for p in parts]
    return Text(None, frozenset().union(*(p.head for p in opened)), frozenset().union(*(p.tail for p in opened)), simplify([g for p in opened for g in p.grams]))


ANY = Text()
EMPTY = Text(frozenset({""}))


def of_items(items) -> Text:
    out = EMPTY
    for op, arg in items:
        out = then(out, of_item(op, arg))
    return out


def of_item(op, arg) -> Text:
    if op is C.LITERAL:
        return Text(frozenset({fold(chr(arg))}))
    if op is C.IN:
        chars = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(x)
            elif kind is C.RANGE and x[1] - x[0] < BRANCHES:
                chars |= set(range(x[0], x[1] + 1))
            else:
                return ANY
        folded = frozenset(fold(chr(c)) for c in chars)
        return Text(folded) if len(folded) <= 5 else ANY
    if op is C.SUBPATTERN:
        return of_items(arg[3])
    if op is C.BRANCH:
        return either([of_items(x) for x in arg[1]])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = arg
        if (least, most) == (0, 1):
            return either([EMPTY, of_items(inner)])
        out = EMPTY
        for _ in range(min(least, 3)):
            out = then(out, of_items(inner))
        return out if least == most and least <= 3 else then(out, ANY)
    if op is C.AT:
        return EMPTY
    return ANY


def fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def trigram_query(expression: str) -> tuple[frozenset[bytes], ...]:
    """Clauses of UTF-8 trigrams, one of which holds wholly in every text with a match; empty: no trigram is mandatory."""
    clauses = of_items(parser.parse(expression)).opened().grams
    packed = simplify([frozenset(g.encode() for g in c if g.isascii()) for c in clauses])
    return () if frozenset() in packed else packed


class Postings:
    """The inverted index of one block: trigram to the sorted numbers of the rows that hold it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: list[bytes]):
        self.rows = len(offsets) - 1
        codes = np.array([g[0] << 16 | g[1] << 8 | g[2] for g in wanted], np.int64)
        mark = np.zeros(1 << 24, bool)
        mark[codes] = True
        self.lists: dict[int, np.ndarray] = {int(c): np.zeros(0, np.int64) for c in codes}
        found_code, found_row = [], []
        step = 1 << 20  # so many bytes at once, two more for the trigrams that cross
        for at in range(0, max(len(data) - 2, 0), step):
            part = data[at : at + step + 2]
            low = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.int32)
            code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
            hit = np.flatnonzero(mark[code])
            row = np.searchsorted(offsets, at + hit, side="right") - 1
            inside = at + hit + 3 <= offsets[row + 1]
            found_code.append(code[hit][inside])
            found_row.append(row[inside])
        if found_code:
            both = np.unique(np.concatenate(found_code).astype(np.int64) << 32 | np.concatenate(found_row))
            code, row = both >> 32, both & 0xFFFFFFFF
            cuts = np.flatnonzero(np.diff(code)) + 1
            for c, r in zip(np.split(code, cuts), np.split(row, cuts)):
                if len(c):
                    self.lists[int(c[0])] = r

    def find(self, query: tuple[frozenset[bytes], ...]) -> np.ndarray:
        if not query:
            return np.arange(self.rows)
        found = []
        for clause in query:
            lists = sorted((self.lists[g[0] << 16 | g[1] << 8 | g[2]] for g in clause), key=len)
            rows = lists[0]
            for more in lists[1:]:
                rows = np.intersect1d(rows, more, assume_unique=True)
            found.append(rows)
        return np.unique(np.concatenate(found))


def quick(expression: str, least: int, group: int) -> str:
    """An expression of one repeated class finds its long runs directly: shorter runs would be dropped anyway."""
    one = list(parser.parse(expression))
    if group == 0 and len(one) == 1 and one[0][0] is C.MAX_REPEAT and one[0][1][:2] == (1, C.MAXREPEAT) and len(one[0][1][2]) == 1 and expression.endswith("+"):
        return expression[:-1] + f"{{{max(least, 1)},}}"
    return expression


class Scanner:
    """Rules with their queries; finds the spans of a block of texts through the block's postings."""

    def __init__(self, rules):
        self.rules = tuple(rules)
        self.queries = [trigram_query(r[1]) for r in self.rules]
        self.wanted = sorted(set().union(*(c for q in self.queries for c in q)))

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, end, number of the rule) by start, then by the rules' order."""
        finders = list(map(finder, self.rules))
        whole = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset :][: len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        index = Postings(data, offsets - offsets[0], self.wanted)
        strings = column.to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in strings]
        for k, query in enumerate(self.queries):
            for row in index.find(query).tolist():
                if strings[row]:
                    found[row] += [(*span, k) for span in finders[k](strings[row])]
        return [sorted(x, key=lambda s: (s[0], s[2], s[1])) for x in found]


def scan(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, found: array of (kind, start, end) by start, then by the rules' order."""
    scanner = Scanner(rules)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in (part for whole in batches for part in in_slices(whole, 1)):
            out = [[{"kind": scanner.rules[k][0], "start": s, "end": e} for s, e, k in x] for x in scanner.spans(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(kind))], ["doc_id", "found"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rules=RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows of docs with every found span of the text replaced by a mark; overlapping spans become one mark."""
    scanner, names, at = Scanner(rules), docs.columns, docs.columns.index(text)

    def run(batches):
        for b in (part for whole in batches for part in in_slices(whole, at)):
            strings = [masked(t, s, mark) if s else t for t, s in zip(b.column(at).to_pylist(), scanner.spans(b.column(at)))]
            yield pa.RecordBatch.from_arrays([pa.array(strings, b.column(at).type) if i == at else b.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(tidy(run), docs.schema)


def masked(text: str, spans, mark: str) -> str:
    out, last = [], 0
    for start, end, _ in spans:
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join(out) + text[last:]
