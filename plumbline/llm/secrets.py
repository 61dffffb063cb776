"""Secret scans behind a trigram inverted index."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship_package, text_or_empty

#: Rules: kind, regex, the group whose length counts, its least length. The first BASE ones are the base kinds.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("hub", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
BASE = 3
#: Alternatives that are followed letter by letter before the derivation gives up on them.
MOST = 64

# A query is None (every text may match), ("all", parts) or ("any", parts) of queries, or a trigram.


def _join(kind: str, parts: list):
    if kind == "any" and any(p is None for p in parts):
        return None
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]):
    """Texts that hold one of the strings hold all trigrams of one of them."""
    return _join("any", [_join("all", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _one(p: str, i: int) -> tuple[str | None, int]:
    """The character that stands at i of a pattern, escaped or not, and where it ends; None for a class such as \\d."""
    if p[i] != "\\":
        return p[i], i + 1
    if p[i + 1] == "x":
        return chr(int(p[i + 2 : i + 4], 16)), i + 4
    return (None if p[i + 1].isalnum() else p[i + 1]), i + 2


def parse(p: str, i: int = 0) -> tuple[list[list], int]:
    """Alternatives of a regex from i to its end or closing bracket, each a list of items.

    Items are ("chars", set of characters, or None for too many to tell), ("any", alternatives) and
    ("repeat", least, most or None, item). Of groups, plain and (?:...) ones are known; others are refused.
    """
    out: list[list] = [[]]
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            out.append([])
            i += 1
            continue
        if p[i] == "(":
            i += 3 if p.startswith("(?:", i) else 1
            if p[i] == "?":
                raise ValueError(f"unknown group in {p!r}")
            inner, i = parse(p, i)
            item: tuple = ("any", inner)
            i += 1
        elif p[i] == "[":
            chars: set[str] | None = set()
            i += 1
            if p[i] == "^":
                raise ValueError(f"negated class in {p!r}")
            while p[i] != "]":
                c, i = _one(p, i)
                if c is not None and p[i] == "-" and p[i + 1] != "]":
                    end, i = _one(p, i + 1)
                    if chars is not None:
                        chars |= {chr(k) for k in range(ord(c), ord(end) + 1)}
                elif c is None:
                    chars = None
                elif chars is not None:
                    chars.add(c)
            item = ("chars", chars)
            i += 1
        elif p[i] in ".^$":
            item = ("chars", None) if p[i] == "." else ("any", [[]])
            i += 1
        else:
            c, i = _one(p, i)
            item = ("chars", None if c is None else {c})
        if i < len(p) and p[i] in "?*+{":
            if p[i] == "{":
                low, _, high = p[i + 1 : p.index("}", i)].partition(",")
                least, most = int(low), int(high or low) if high or "," not in p[i : p.index("}", i)] else None
                i = p.index("}", i) + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[p[i]]
                i += 1
            item = ("repeat", least, most, item)
        out[-1].append(item)
    return out, i


def _any(alternatives: list[list]) -> tuple[set[str] | None, object]:
    parts = [_walk(a) for a in alternatives]
    if all(e is not None for e, _ in parts):
        return set().union(*(e for e, _ in parts)), None
    return None, _join("any", [_of_strings(e) if e is not None else q for e, q in parts])


def _walk(items: list) -> tuple[set[str] | None, object]:
    """The exact set of strings that items match, lower-cased, if it is small; else a query that its texts meet."""
    known: set[str] = {""}
    needed: list = []

    def end() -> None:
        if known != {""}:
            needed.append(_of_strings(known))

    whole = True
    for kind, *arg in items:
        exact, query = None, None
        if kind == "chars":
            exact = {c.lower() for c in arg[0]} if arg[0] is not None else None
            exact = exact if exact is not None and len(exact) <= 8 else None
        elif kind == "any":
            exact, query = _any(arg[0])
        else:
            low, high, inner = arg
            e, q = _walk([inner])
            if e is not None and high is not None and high <= 2:
                exact, power = set(), {""}
                for k in range(high + 1):
                    if k >= low:
                        exact |= power
                    power = {a + b for a in power for b in e}
            elif low:
                query = _of_strings(e) if e is not None else q
        joined = {a + b for a in known for b in exact} if exact is not None else None
        if joined is not None and len(joined) <= MOST:
            known = joined
            continue
        end()
        whole = False
        needed.append(query)
        known = exact if exact is not None and len(exact) <= MOST else {""}
    if whole:
        return known, None
    end()
    return None, _join("all", needed)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regex over lower-cased text; None if it has no mandatory trigrams."""
    exact, query = _any(parse(pattern)[0])
    return _of_strings(exact) if exact is not None else query


def _trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class Index:
    """Postings of the trigrams that some rules ask for, over a batch of texts as lower-cased bytes."""

    WINDOW = 1 << 22

    def __init__(self, wanted: set[str]):
        self.number = {t.encode(): i + 1 for i, t in enumerate(sorted(wanted))}
        self.table = np.zeros(1 << 24, np.uint8 if len(self.number) < 256 else np.uint16)
        for t, i in self.number.items():
            if len(t) == 3:
                self.table[t[0] << 16 | t[1] << 8 | t[2]] = i

    def build(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        joined = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
        found = []
        for a in range(0, max(0, len(joined) - 2), self.WINDOW):
            b = joined[a : a + self.WINDOW + 2].astype(np.uint32)
            which = self.table[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            at = np.flatnonzero(which)
            found.append(np.unique(which[at].astype(np.int64) << 40 | np.searchsorted(starts, at + a, "right") - 1))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        self.keys, self.docs = keys >> 40, keys & ((1 << 40) - 1)

    def find(self, query) -> np.ndarray:
        """Numbers of the texts that meet a query."""
        if query is None:
            return np.arange(self.n)
        if isinstance(query, str):
            i = self.number[query.encode()]
            return self.docs[np.searchsorted(self.keys, i) : np.searchsorted(self.keys, i + 1)]
        parts = [self.find(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "all" else np.union1d(out, p)
        return out


def matches(rule, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; those whose group is too short are dropped after they are found."""
    _, pattern, group, least = rule
    return [m.span() for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]


def joined_spans(spans: list[tuple[int, int, int]]) -> str:
    """Spans (start, number of the kind, end) as kind:start:end, by start and then kind as listed."""
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Each batch of texts gets a trigram index of its own, in the task that reads it: no shuffle and no state
    beyond a batch. A rule's Boolean query gives its candidates, which the regex verifies; `hex` has no
    mandatory trigram and scans every text. Whole texts are scanned; null and empty ones have no spans.
    Spans are in code points, end exclusive, of the rule's whole match.
    """
    ship_package(docs.sparkSession)
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("doc_id", LongType()), *(StructField(f"n_{RULES[k][0]}", LongType()) for k in range(BASE)), StructField("base_sha256", StringType()), StructField("spans", StringType())])

    def scan(batches):
        asked = [trigram_query(r[1]) for r in RULES]
        index = Index(set().union(*map(_trigrams, asked)))

        def done(ids, texts):
            index.build([t.encode() for t in texts])
            spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, query) in enumerate(zip(RULES, asked, strict=True)):
                for i in index.find(query).tolist():
                    spans[i] += [(a, k, b) for a, b in matches(rule, texts[i])]
            base = [[s for s in x if s[1] < BASE] for x in spans]
            counts = [[sum(s[1] == k for s in x) for x in base] for k in range(BASE)]
            shas = [hashlib.sha256(joined_spans(x).encode()).hexdigest() for x in base]
            arrays = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(map(joined_spans, spans), pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= batch_bytes:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield done(ids, texts)

    return docs.select(F.col(id_col).cast("bigint"), text_or_empty(F.col(text_col))).mapInArrow(scan, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return find_secrets(table(spark, sf_dir, "documents"))
