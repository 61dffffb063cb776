"""N-gram Jaccard join with signature trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import caches
from plumbline.llm.common import hinted, input_bytes, materialise, ship_package, text_or_empty
from plumbline.llm.graph import components

WINDOW_BYTES = 8 << 20  # text that a task contracts at once
KEY_BYTES = 8 << 20  # text whose keys meet in a task
CHUNK_BYTES = 12 << 20  # sets that are tested together
BLOCK_NODES = 2048  # nodes of a block that are compared in one task; a larger one is compared by pairs of its parts
FREQUENT = 32  # sets that make a shingle frequent
LISTED = 1 << 20  # frequent shingles, at most, that travel to all tasks, the most frequent ones; with more of them only higher powers of two count as frequent
RUN_KEYS = 1 << 21  # shingles that a task counts at once
LEAF, FANOUT = 16, 4
SHARP = 8  # times wider than a node's are the signatures of sets that are tested: few pairs below the threshold then pass them


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets have in common."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of percent or more; empty ones never do."""
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < percent * high:
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (low + high - both)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """One less the Jaccard similarity, which obeys the triangle inequality."""
    both = overlap(a, b)
    return 1 - both / (len(a) + len(b) - both)


def prefix(s: np.ndarray, frequent: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in one order for all sets, by level and then by hash, so many that two linked
    sets have one of them in common. frequent has the keys (see count_key) of shingles with a level above 0."""
    n = len(s)
    p = n - -(-percent * n // 100) + 1
    if len(frequent) and n:
        key = count_key(s)
        at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
        often = np.where(frequent[at] == key, level[at], 0)
        return s[np.argsort(often, kind="stable")[:p]]
    return s[:p]


def count_key(s: np.ndarray) -> np.ndarray:
    """The upper 32 of a shingle's 48 bits, by which it is counted: two with the same key add up, which only orders them."""
    return (s >> np.uint64(16)).astype(np.uint32)


def width_of(n: int) -> int:
    """Bits of a signature: a power of two that keeps about half of them clear."""
    return max(64, 1 << max(0, int(0.8 * n) - 1).bit_length())


def signature(s: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of the set's shingles, by the low bits of the 48 that travel, in words of 64 bits; halves fold onto each other."""
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def fold(words: np.ndarray, width: int, both=np.bitwise_or) -> np.ndarray:
    """A row of signatures reduced to width bits: numbers modulo a smaller power of two."""
    while words.shape[-1] * 64 > width:
        half = words.shape[-1] // 2
        words = both(words[..., :half], words[..., half:])
    return words


class Nodes:
    """Tree nodes over rows with sizes in [low, high]: `some` has the bits that any of their sets has, `every`
    those that all have. The overlap of a set in x with one in y is at most x's size less the bits that all
    in x have and none in y: each such bit stands for a shingle or more."""

    def __init__(self, low, high, some, every):
        self.low, self.high, self.some, self.every = low, high, some, every

    def take(self, i) -> Nodes:
        return Nodes(self.low[i], self.high[i], self.some[i], self.every[i])

    def parents(self, fanout: int) -> Nodes:
        at = np.arange(0, len(self.low), fanout)
        return Nodes(np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.bitwise_or.reduceat(self.some, at), np.bitwise_and.reduceat(self.every, at))

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """For pairs of nodes, whether some two sets in them may be linked."""
        low, high = self.low[i] + self.low[j], np.minimum(self.high[i], self.high[j])
        ok = (100 * self.high[i] >= percent * self.low[j]) & (100 * self.high[j] >= percent * self.low[i])
        ok &= (100 + percent) * high >= percent * low
        at = np.flatnonzero(ok)
        step = max(1, (1 << 18) // self.some.shape[1])
        for a in range(0, len(at), step):
            k = at[a : a + step]
            x, y = i[k], j[k]
            alone_x = np.bitwise_count(self.every[x] & ~self.some[y]).sum(axis=1, dtype=np.int64)
            alone_y = np.bitwise_count(self.every[y] & ~self.some[x]).sum(axis=1, dtype=np.int64)
            most = np.minimum(self.high[x] - alone_x, self.high[y] - alone_y)
            ok[k] = (100 + percent) * most >= percent * low[k]
        return ok


def tree_pairs(rows: Nodes, percent: int, apart=None, group=None):
    """Pairs i < j of rows that may be linked, in pieces, by dual traversal of a signature tree over the rows by size.

    The traversal goes depth first and takes few pairs of nodes at a time, so what it holds does not grow
    with the number of pairs. apart(i, j) tells, at the time of asking, which pairs of rows are wanted, and
    group() gives each row's group, a new array after each change: nodes of one group are not descended into.
    """
    n = len(rows.low)
    order = np.lexsort((rows.some[:, 0], rows.high))
    levels = [rows.take(order)]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].parents(LEAF if len(levels) == 1 else FANOUT))
    known, spans = None, []  # of each level's nodes, the smallest and largest group
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))] if n > 1 else []
    while stack:
        depth, i, j = stack.pop()
        if not depth:
            a, b = order[i], order[j]
            keep = np.ones(len(a), bool) if apart is None else apart(a, b)
            keep[keep] = levels[0].may_link(i[keep], j[keep], percent)
            if keep.any():
                yield np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
            continue
        if group is not None:
            if (now := group()) is not known:
                known, spans = now, [(now[order], now[order])]
                while len(spans) < len(levels):
                    at = np.arange(0, len(spans[-1][0]), LEAF if len(spans) == 1 else FANOUT)
                    spans.append((np.minimum.reduceat(spans[-1][0], at), np.maximum.reduceat(spans[-1][1], at)))
            first, last = spans[depth]
            keep = (first[i] != last[j]) | (first[j] != last[i])
            i, j = i[keep], j[keep]
        keep = levels[depth].may_link(i, j, percent) | (i == j)
        i, j = i[keep], j[keep]
        fan, below = (LEAF if depth == 1 else FANOUT), len(levels[depth - 1].low)
        a, b = np.divmod(np.arange(fan * fan), fan)
        step = 256 if depth == 1 else 1024
        for k in range((len(i) - 1) // step * step, -1, -step):  # the first is taken from the stack first
            x, y = (i[k : k + step, None] * fan + a).ravel(), (j[k : k + step, None] * fan + b).ravel()
            good = (x < below) & (y < below) & ((x < y) if depth == 1 else (x <= y))
            stack.append((depth - 1, x[good], y[good]))


class Groups:
    """Numbers below n in groups, each known by its smallest."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def tops(self) -> np.ndarray:
        return np.array([self.top(x) for x in range(len(self.root))], np.int64)

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)
        return x != y


def by_width(low: np.ndarray, high: np.ndarray, width: np.ndarray, percent: int):
    """Each width of signatures with the rows that it has, and the wider ones whose sets are small enough to be linked with one of its own."""
    for w in np.unique(width):
        own = np.flatnonzero((width == w) | ((width > w) & (percent * low <= 100 * high[width == w].max())))
        yield int(w), own


def connect(sets: list[np.ndarray], groups: Groups, percent: int) -> list[tuple[int, int]]:
    """Joins the groups of linked sets; returns links that did so. Pairs already in one group need no test."""
    n = np.array([len(s) for s in sets], np.int64)
    width = np.array([SHARP * width_of(k) for k in n])
    signs = [signature(s, w) for s, w in zip(sets, width, strict=True)]
    out = []
    for w, own in by_width(n, n, width, percent):
        if len(own) < 2:
            continue
        bits, wide = np.stack([fold(signs[k], w) for k in own]), width[own] > w
        tops = groups.tops()

        def apart(i, j, own=own, wide=wide):
            return (tops[own[i]] != tops[own[j]]) & ~(wide[i] & wide[j])

        mine = tops[own]
        for i, j in tree_pairs(Nodes(n[own], n[own], bits, bits), percent, apart, lambda: mine):
            joined = False
            for x, y in zip(own[i].tolist(), own[j].tolist(), strict=True):
                if groups.top(x) != groups.top(y) and linked(sets[x], sets[y], percent):
                    groups.join(x, y)
                    out.append((x, y))
                    joined = True
            if joined:
                tops = groups.tops()
                mine = tops[own]
    return out


def _key_rows(batches):
    """Of sets: their shingles' keys, sorted, in a row for each run and value of the upper 9 bits: how many have each value of the next 7 bits, and the lower 16 bits."""
    from plumbline.llm.words import unpack48

    caches.only("none")
    held: list[np.ndarray] = []
    n = 0

    def rows() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        top = np.bincount(keys >> np.uint32(16), minlength=1 << 16).astype("<u4").reshape(512, 128)
        ends = np.cumsum(top.sum(axis=1, dtype=np.int64))
        low = (keys & np.uint32(0xFFFF)).astype("<u2")
        data = [top[b].tobytes() + x.tobytes() for b, x in enumerate(np.split(low, ends[:-1]))]
        full = [b for b, d in enumerate(data) if len(d) > 512]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([data[b] for b in full], pa.binary())], names=["bucket", "keys"])

    for batch in batches:
        for x in batch.column(0):
            held.append(count_key(unpack48(x.as_buffer())))
            n += len(held[-1])
            if n >= RUN_KEYS:
                yield rows()
                held, n = [], 0
    if n:
        yield rows()


def _count_keys(batches):
    """Of a task's rows of keys: those that FREQUENT sets or more have, and the floor of their number's logarithm to base 2."""
    keys = []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_buffer()
            top = np.repeat(np.arange(128, dtype=np.uint32) + np.uint32(bucket << 7), np.frombuffer(data, "<u4", 128))
            keys.append(top << np.uint32(16) | np.frombuffer(data, "<u2", -1, 512))
    if not keys:
        return
    keys = np.sort(np.concatenate(keys))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    times = np.diff(np.r_[starts, len(keys)])
    often = times >= FREQUENT
    level = np.frexp(times[often].astype(np.float64))[1] - 1
    yield pa.RecordBatch.from_arrays([pa.array(keys[starts[often]].astype(np.int64)), pa.array(level.astype(np.int32))], names=["key", "level"])


def frequent_shingles(sets: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of frequent shingles and their levels, counted over all rows of sets (set): an order of shingles, which no result depends on."""
    rows = sets.select("set").mapInArrow(_key_rows, "bucket int, keys binary").repartition(min(tasks, 512), "bucket")
    found = materialise(rows.mapInArrow(_count_keys, "key bigint, level int"), "near-frequent")
    least, listed = 64, 0
    for row in sorted(found.groupBy("level").count().collect(), reverse=True):
        if listed + row["count"] > LISTED:
            break
        least, listed = row["level"], listed + row["count"]
    t = found.filter(F.col("level") >= least).toArrow()
    key, level = t.column("key").to_numpy().astype(np.uint32), t.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(key)
    return key[order], level[order]


_NODES = pa.schema([
    ("kind", pa.int8()), ("node", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("lead", pa.bool_()), ("radius", pa.float64()), ("set", pa.binary()),
    ("low", pa.int64()), ("high", pa.int64()), ("some", pa.binary()), ("every", pa.binary()), ("digest", pa.binary()),
])
_NODES_SQL = "kind tinyint, node bigint, id bigint, n bigint, lead boolean, radius double, set binary, low bigint, high bigint, some binary, every binary, digest binary"


class _Window:
    """Documents of a task, contracted to nodes: each is linked to an earlier one of its node, or leads it."""

    def __init__(self, percent: int):
        self.percent, self.held = percent, 0
        self.docs: list[tuple[int | None, int, int]] = []  # id, size, place among the sets
        self.sets: list[np.ndarray] = []
        self.digests: list[bytes] = []
        self.node: list[int] = []  # of each set
        self.members: list[list[int]] = []
        self.radius: list[float] = []  # the largest distance of a member to its node's first
        self.same: dict[bytes, int] = {}
        self.met: dict[tuple[int, int], int] = {}

    def add(self, doc_id: int | None, s: np.ndarray, size: int) -> None:
        from xxhash import xxh3_128_digest

        self.held += size
        at = -1
        if len(s) and doc_id is not None:
            key = xxh3_128_digest(s.tobytes())
            at = self.same.get(key, -1)
            if at < 0:
                at = self.same[key] = len(self.sets)
                self.sets.append(s)
                self.digests.append(key)
                # Linked sets mostly agree in the first shingle of some quarter of all hashes. What is not found now is found later.
                places = np.searchsorted(s, _QUARTERS)
                keys = [(q, int(s[min(p, len(s) - 1)])) for q, p in enumerate(places)]
                tried = dict.fromkeys(self.met[k] for k in keys if k in self.met)
                near = next((k for k in tried if linked(self.sets[k], s, self.percent)), None)
                if near is None:
                    self.node.append(len(self.members))
                    self.members.append([at])
                    self.radius.append(0.0)
                else:
                    node = self.node[near]
                    self.node.append(node)
                    self.radius[node] = max(self.radius[node], distance(self.sets[self.members[node][0]], s))
                    self.members[node].append(at)
                self.met.update((k, at) for k in keys)
        self.docs.append((doc_id, len(s), at))

    def flush(self, first: int) -> pa.RecordBatch:
        """The window's rows; nodes are numbered from first."""
        from plumbline.llm.words import pack48

        rows: list[tuple] = []
        written: set[int] = set()
        for doc_id, n, at in self.docs:
            if at < 0:
                rows.append((0, None, doc_id, n, None, None, None, None, None, None, None, None))
                continue
            node, new = self.node[at], at not in written
            lead = new and self.members[node][0] == at
            rows.append((0, first + node, doc_id, n, lead, self.radius[node] if lead else None, pack48(self.sets[at]) if new else None, None, None, None, None, None))
            written.add(at)
        for k, members in enumerate(self.members):
            sizes = [len(self.sets[m]) for m in members]
            signs = [signature(self.sets[m] >> np.uint64(16), width_of(max(sizes))) for m in members]
            some = np.bitwise_or.reduce(signs).tobytes() if len(members) > 1 else signs[0].tobytes()
            every = np.bitwise_and.reduce(signs).tobytes() if len(members) > 1 else None
            rows.append((1, first + k, None, None, None, None, None, min(sizes), max(sizes), some, every, None if every else self.digests[members[0]]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES)


_QUARTERS = np.array([0, 1 << 62, 1 << 63, 3 << 62], np.uint64)


def _meet(batches):
    """Of a task's (token, node): a block for each list of two nodes or more that have a token in common.

    A block is known by a hash of its nodes, so that the tokens of one shared passage are one block.
    Should two lists have the same hash they are one block, which costs work and loses nothing.
    """
    from plumbline.llm.words import mixed

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    token, node = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
    del held
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]  # members of a node have tokens in common
    token, node = token[new], node[new]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    hashes = np.add.reduceat(mixed(node.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), starts).view(np.int64)
    many = np.flatnonzero(sizes > 1)
    _, once = np.unique(hashes[many], return_index=True)
    many = many[once]
    rows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[many].tolist(), sizes[many].tolist(), strict=True)]) if len(many) else many
    block, size = np.repeat(hashes[many], sizes[many]), np.repeat(sizes[many], sizes[many])
    for a in range(0, len(rows), 1 << 16):
        z = a + (1 << 16)
        yield pa.RecordBatch.from_arrays([pa.array(block[a:z]), pa.array(node[rows[a:z]]), pa.array(size[a:z])], names=["block", "node", "size"])


def _forest(percent: int):
    """Of a task's blocks: links that connect the nodes of each block of which some sets may be linked."""

    def forest(t: pa.Table) -> pa.Table:
        caches.only("none")
        block = np.unique(np.stack([t.column(c).to_numpy() for c in ("block", "lo", "hi")]), axis=1, return_inverse=True)[1].ravel()
        names, at = np.unique(t.column("node").to_numpy(), return_inverse=True)
        low, high, some, every = (t.column(c) for c in ("low", "high", "some", "every"))
        low, high = low.to_numpy(), high.to_numpy()
        some = [np.frombuffer(x.as_buffer(), "<u8") for x in some]
        every = [np.frombuffer(x.as_buffer(), "<u8") if x.is_valid else s for x, s in zip(every, some, strict=True)]
        width = np.array([len(x) * 64 for x in some])
        groups, out = Groups(len(names)), []

        def join(i, j) -> None:
            for x, y in zip(at[i].tolist(), at[j].tolist(), strict=True):
                if groups.join(x, y):
                    out.append((x, y))

        for w, own in by_width(low, high, width, percent):
            nodes = Nodes(low[own], high[own], np.stack([fold(some[k], w) for k in own]), np.stack([fold(every[k], w) for k in own]))
            wide = width[own] > w  # two of these meet at their own width, where signatures are sharper
            order = np.argsort(block[own], kind="stable")
            own_block = block[own][order]
            starts = np.flatnonzero(np.r_[True, own_block[1:] != own_block[:-1]])
            sizes = np.diff(np.r_[starts, len(order)])
            for size in range(2, LEAF + 1):  # blocks of one leaf, all of a size at once
                s = starts[sizes == size]
                a, b = np.triu_indices(size, 1)
                for k in range(0, len(s), 1024):
                    i, j = order[(s[k : k + 1024, None] + a).ravel()], order[(s[k : k + 1024, None] + b).ravel()]
                    apart = ~(wide[i] & wide[j])
                    i, j = i[apart], j[apart]
                    ok = nodes.may_link(i, j, percent)
                    join(own[i[ok]], own[j[ok]])
            for s, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
                inside = order[s : s + size]
                mine = at[own[inside]].tolist()
                tops = np.array([groups.top(x) for x in mine])

                beyond = wide[inside]

                def unknown(i, j):
                    return (tops[i] != tops[j]) & ~(beyond[i] & beyond[j])

                for i, j in tree_pairs(nodes.take(inside), percent, unknown, lambda: tops):
                    join(own[inside[i]], own[inside[j]])
                    tops = np.array([groups.top(x) for x in mine])
        return pa.table({"u": pa.array([names[x] for x, _ in out], pa.int64()), "v": pa.array([names[y] for _, y in out], pa.int64())})

    return forest


def _by_part(t: pa.Table, keys: list[str]):
    """The rows of each combination of keys."""
    part = np.unique(np.stack([t.column(c).to_numpy() for c in keys]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [x for x in np.split(order, cuts) if len(x)]


def _test_leaders(percent: int):
    """Links between nodes whose leaders are linked (u, v), and nodes (u, null) that have sets to be tested yet.

    A set of node u is at most u's radius from its leader. So u and v, when not connected, have sets to be
    tested where one of them has followers and their leaders are no further apart than a link and both radii.
    """

    def test(t: pa.Table) -> pa.Table:
        from plumbline.llm.words import unpack48

        caches.only("none")
        node, radius, out = t.column("node").to_numpy(), t.column("radius").to_numpy(), []
        sets = t.column("set")
        for rows in _by_part(t, ["component", "part"]):
            own = [unpack48(sets[int(k)].as_buffer()) for k in rows]
            groups = Groups(len(own))
            out += [(int(node[rows[x]]), int(node[rows[y]])) for x, y in connect(own, groups, percent)]
            tops, r, n = groups.tops(), radius[rows], np.array([len(s) for s in own])
            if (tops == tops[0]).all():
                continue
            opened = np.zeros(len(own), bool)
            for x in np.flatnonzero(r > 0).tolist():
                far = 1 - percent / 100 + r[x] + r + 1e-9
                others = np.flatnonzero((tops != tops[x]) & (np.minimum(n, n[x]) >= (1 - far) * np.maximum(n, n[x])))
                for y in others[np.argsort(opened[others], kind="stable")].tolist():
                    if opened[x] and opened[y]:
                        break  # as are all that follow
                    if distance(own[x], own[y]) <= far[y]:
                        opened[x] = opened[y] = True
            out += [(int(k), None) for k in node[rows[opened]]]
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return test


def _test_members(percent: int):
    """Links between nodes some of whose sets are linked. Nodes of one label are connected and need no test."""

    def test(t: pa.Table) -> pa.Table:
        from plumbline.llm.words import unpack48

        caches.only("none")
        node, label, out = t.column("node").to_numpy(), t.column("label").to_numpy(), []
        sets = t.column("set")
        for rows in _by_part(t, ["component", "lo", "hi"]):
            own = [unpack48(sets[int(k)].as_buffer()) for k in rows]
            groups = Groups(len(own))
            first: dict[int, int] = {}
            for k, x in enumerate(label[rows].tolist()):
                groups.join(k, first.setdefault(x, k))
            if len(first) > 1:
                out += [(int(node[rows[x]]), int(node[rows[y]])) for x, y in connect(own, groups, percent)]
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return test


def _in_parts(rows: DataFrame, test, schema: str, pairs: bool, label: str) -> tuple[DataFrame, DataFrame]:
    """test's rows for rows (component, node, n, set, ..) in tasks of about CHUNK_BYTES, written; and the components that were cut.

    A component with larger sets is cut into parts by a hash of the node: each is tested alone, or, for
    pairs, with each other one.
    """
    sizes = rows.groupBy("component").agg(F.sum(6 * F.col("n") + 64).alias("bytes")).withColumn("parts", F.ceil(F.col("bytes") / CHUNK_BYTES))
    sizes = materialise(sizes, f"{label}-sizes")
    cut = sizes.filter("parts > 1")
    total = sizes.agg(F.sum(F.col("bytes") * (F.col("parts") if pairs else F.lit(1))).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = (total["bytes"] or 0) // CHUNK_BYTES + total["n"] // 1000 + 1
    dealt = rows.join(hinted(sizes.drop("bytes")), "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    keys = ["component", "part"]
    if pairs:
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        dealt = dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
        keys = ["component", "lo", "hi"]
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int"))
    found = dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(test, schema)
    return materialise(found, label), cut.select("component")


def verify(reach: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect the nodes of reach (node, component) which hold linked sets, and no others.

    docs has rows (node, n, lead, radius, set). A node's first set travels to the task of its component,
    or of a part of it; the parts of a large component meet by one node of each connected group. Where
    not all are connected yet, nodes that may hold a linked set send all their sets.
    """
    links = None
    reach = materialise(reach.select("node", "component"), "near-reach")
    left = docs.filter("lead").join(hinted(reach), "node").select("component", "node", "n", "radius", "set")
    first_cut = opened = None
    while True:
        found, cut = _in_parts(left, _test_leaders(percent), "u bigint, v bigint", False, "near-tested")
        opened = found.filter("v IS NULL").select(F.col("u").alias("node")) if opened is None else opened
        found = found.filter("v IS NOT NULL")
        links = found if links is None else materialise(links.unionByName(found), "near-links")
        first_cut = cut if first_cut is None else first_cut
        labels = components(links).withColumnRenamed("component", "label")
        if not cut.limit(1).count():
            break
        before = left.join(cut, "component", "left_semi")
        left = materialise(before.join(labels, "node", "left").filter("label IS NULL OR label = node").drop("label"), "near-left")
        if 2 * left.count() > before.count():
            break  # what is left is not connected, for the most part

    labelled = materialise(reach.join(labels, "node", "left").select("node", "component", F.coalesce("label", "node").alias("label")), "near-labels")
    apart = labelled.groupBy("component").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("component")
    whole = labelled.join(first_cut, "component", "left_semi").select("node")
    open_nodes = labelled.join(apart, "component", "left_semi").join(opened.unionByName(whole).distinct(), "node", "left_semi")
    open_nodes = materialise(open_nodes, "near-open")
    if open_nodes.limit(1).count():
        sets = docs.filter("set IS NOT NULL").join(hinted(open_nodes), "node").select("component", "node", "label", "n", "set")
        found, _ = _in_parts(sets, _test_members(percent), "u bigint, v bigint", True, "near-members")
        links = links.unionByName(found)
    return links


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles and component_id, the smallest id that links lead to.

    Two documents are linked when their sets of 5-word shingles have a Jaccard similarity of percent / 100
    or more. A task first lets copies and near copies within its window of text be one node, so that a large
    group costs a node or few per window. Linked sets share a shingle of their prefixes: nodes that share one
    are a block, in which a signature tree's dual traversal finds those whose sets may overlap enough. They
    fall into components, in which sets are verified, again by signature trees and only where they are not
    connected yet. No link is missed but by a collision of 64-bit hashes; sets that are verified hold the
    upper 48 bits of each hash, so a set of a million shingles has about 0.002 chance collisions inside it.

    Null texts are empty; empty documents are linked with nothing. Rows with the same id are one node. A
    null id gets its n_shingles and a null component_id. An empty table gives an empty result.
    """
    from plumbline.llm.words import shingles

    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(F.col(text_col)).alias("text"))

    def contract(batches):
        from pyspark import TaskContext

        caches.only("words")
        first = TaskContext.get().partitionId() << 32
        w = _Window(percent)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                w.add(i, shingles(text), len(text))
                if w.held >= WINDOW_BYTES:
                    yield w.flush(first)
                    first += len(w.members)
                    w = _Window(percent)
        if w.docs:
            yield w.flush(first)

    contracted = materialise(rows.mapInArrow(contract, _NODES_SQL), "near-nodes")
    members = contracted.filter("kind = 0").select("id", "n", "node", "lead", "radius", "set")
    nodes = contracted.filter("kind = 1").select("node", "low", "high", "some", "every", "digest")
    # Nodes of one set, the same in several windows: the first of them stands for all.
    first_of = nodes.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest", "v")
    twins = nodes.select(F.col("node").alias("u"), "digest").join(first_of, "digest").filter("u <> v").select("u", "v")
    twins = materialise(twins, "near-twins")
    once = members.filter("set IS NOT NULL").select("node", "set").join(hinted(twins.select(F.col("u").alias("node"))), "node", "left_anti")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(rows) // KEY_BYTES))
    frequent = spark.sparkContext.broadcast(frequent_shingles(once, parts))  # 5 * LISTED bytes at most

    def tokens(batches):
        from plumbline.llm.words import unpack48

        caches.only("none")
        for batch in batches:
            found = [prefix(unpack48(x.as_buffer()), *frequent.value, percent) for x in batch.column(1)]
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            found = np.concatenate(found).view(np.int64) if found else owner
            for a in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[a : a + (1 << 16)]), pa.array(owner[a : a + (1 << 16)])], names=["token", "node"])

    keys = once.mapInArrow(tokens, "token bigint, node bigint").repartition(parts, "token")
    blocks = materialise(keys.mapInArrow(_meet, "block bigint, node bigint, size bigint").distinct(), "near-blocks")
    split = blocks.withColumn("parts", F.ceil(F.col("size") / BLOCK_NODES)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    split = split.select("block", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node")
    known = split.join(nodes.drop("digest"), "node")
    tasks = max(1, min(blocks.count() // 500 + 1, parts * 4))
    dealt = known.withColumn("bucket", F.pmod(F.xxhash64("block", "lo", "hi"), F.lit(tasks)).cast("int")).repartition(tasks, "bucket")
    reach = components(dealt.groupBy("bucket").applyInArrow(_forest(percent), "u bigint, v bigint"))

    links = verify(reach, members.select("node", "n", "lead", "radius", "set"), percent).unionByName(twins)
    label = components(links).withColumnRenamed("component", "label")
    grouped = members.filter("node IS NOT NULL").select("id", "node").join(label, "node", "left").select("id", F.coalesce("label", "node").alias("label")).distinct()
    stars = grouped.join(grouped.groupBy("label").agg(F.min("id").alias("least")), "label").filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    found = components(stars).withColumnRenamed("node", "id")
    return members.join(found, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with their columns as they are; rows with a null id stay."""
    found = near_components(docs, id_col, text_col, percent)
    drop = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs[id_col] == drop["_drop"], "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from plumbline.llm.common import table

    return near_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), e AS (
  SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS x FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), l AS (
  SELECT u, v FROM p UNION ALL SELECT v, u FROM p
), r AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), c AS (
  SELECT u, least(u, min(v)) AS component_id FROM r GROUP BY u
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.doc_id = c.u
"""
