"""SentencePiece encoding and decoding; sampled segmentations by Gumbel top-k without replacement.

A vocabulary's pieces span a lattice over each unit (blanks with the word after them, or a line feed; no piece
crosses into the next unit). Backward sums of piece weights give each edge its probability, so the segmentations of a text have a
product law. A* search over the tree of partial segmentations, each with the largest perturbed
log-probability below it as its exact bound, pops complete segmentations in falling order: a child that
carries its parent's bound is followed at once, its siblings wait as one group, a subtree with a Gumbel truncated at
that bound, of which one is drawn when the group is popped. The first k + 1 pops are a sample without replacement and its threshold, from which inclusion scores follow.
Every draw is a hash of the row's key, the sample and the place in the document.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .common import pieces as slices

SPACE = "▁"
SAMPLES, ZIPF, SEED = 2, 10.0, 17
MAX_BYTES, BUILD, SLICE = 48 << 20, 1 << 16, 1 << 19  # of lattices kept; symbols built, bytes of text sampled at a time
_B = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model: bytes) -> dict:
    """What sampling needs of a sentencepiece model: pieces, log weights and byte pieces.

    The model's scores are merge ranks; piece weights follow Zipf's law on them, 1 / (rank + ZIPF).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    text = [sp.id_to_piece(i) for i in range(n)]
    usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    if crossing := [p for p, u in zip(text, usable) if u and re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p)]:
        raise ValueError(f"pieces cross a blank or line feed: {crossing[:3]}")
    rank = np.array([max(0.0, -sp.get_score(i)) for i in range(n)])
    w = 1 / (rank + ZIPF)
    w = np.log(w / w.sum())
    return {"model": model, "text": text, "usable": usable, "weight": w, "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "trie": _trie(text, usable)}


def _trie(text: list[str], usable: list[bool]) -> tuple:
    """Longest piece, sorted hashes of all prefixes, the piece that each is or -1, and an open-addressing table of them: a prefix is in the first slots from its own on."""
    keep = [i for i, u in enumerate(usable) if u]
    hashes, prefixes = {}, set()
    for i in keep:
        h = 0
        for c in text[i]:
            h = (h * int(_B) + ord(c) + 1) % (1 << 64)
            prefixes.add(h)
        if h in hashes:
            raise ValueError("two pieces have one hash")
        hashes[h] = i
    prefix = np.array(sorted(prefixes), np.uint64)
    piece = np.array([hashes.get(int(h), -1) for h in prefix])
    bits = max(10, (8 * len(prefix)).bit_length())
    shift, slot = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
    for i, x in enumerate((prefix * _B >> shift).tolist()):
        while slot[x] >= 0:
            x = (x + 1) % len(slot)
        slot[x] = i
    return max((len(text[i]) for i in keep), default=1), prefix, piece, shift, slot


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Open (0, 1) numbers from 64-bit keys and integers."""
    x = key
    for p in parts:
        p = np.atleast_1d(np.asarray(p)).astype(np.uint64)
        x = _mix(x + _B * (p + np.uint64(1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts laid end to end, each with a blank before it and SPACE for blanks; where texts begin; where units begin.

    A unit is a run of blanks with what follows up to a blank or line feed, a line feed, or what stands between line feeds.
    """
    code = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    blank = code == 32
    code[blank] = ord(SPACE)
    blank |= code == ord(SPACE)
    feed = code == 10
    begin = feed.copy()
    begin[1:] |= feed[:-1] | (blank[1:] & ~blank[:-1])
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text = np.cumsum(size) - size
    begin[text] = True
    return code, text, np.flatnonzero(begin)


class Lattices:
    """Edges of units, kept as they come: node i's edges are first[i]:first[i + 1], cum their running probability (beyond 1 at a node's last)."""

    def __init__(self, vocab: dict):
        self.vocab = vocab
        self.longest, self.prefix, self.piece, self.shift, self.slot = vocab["trie"]
        self.end, self.edge_piece, self.lp, self.cum, self.first, self.code = (np.zeros(1 << 16, t) for t in (np.int32, np.int32, np.float64, np.float32, np.int32, np.uint32))
        self.base = _B
        self.clear()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the prefixes, -1 where there is none."""
        x = (h * _B >> self.shift).astype(np.int64)
        at = self.slot[x]
        on = np.flatnonzero(at >= 0)
        on = on[self.prefix[at[on]] != h[on]]
        while len(on):
            x[on] = (x[on] + 1) % len(self.slot)
            at[on] = self.slot[x[on]]
            on = on[at[on] >= 0]
            on = on[self.prefix[at[on]] != h[on]]
        return at

    def clear(self):
        self.unit: dict[int, int] = {}
        self.n = self.m = 0  # nodes and edges so far

    def bytes(self) -> int:
        """Of the arrays in use and, roughly, the units' dictionary."""
        return 8 * self.n + 20 * self.m + 150 * len(self.unit)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(values) > len(old):
            new = np.zeros(2 * (at + len(values)), old.dtype)  # pages not written yet take no memory
            new[:at] = old[:at]
            setattr(self, name, old := new)
        old[at : at + len(values)] = values

    def nodes(self, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """First nodes of the units that begin there; lattices not yet known are built, about BUILD symbols at a time.

        Units are known by hash, then compared symbol by symbol; should two differ, all are forgotten and hashed anew.
        """
        import pandas as pd

        size = np.diff(begin, append=len(code))
        place = np.arange(len(code)) - np.repeat(begin, size)
        while True:
            power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()) - 1, self.base, np.uint64)), dtype=np.uint64)
            h = _mix(np.add.reduceat((code + np.uint64(1)) * power[place], begin))
            which, known = pd.factorize(h)
            first = np.flatnonzero(which > np.maximum.accumulate(np.append(-1, which[:-1])))
            known = known.tolist()
            at = np.fromiter(map(self.unit.get, known, repeat(-1)), np.int64, len(known))
            new = np.flatnonzero(at < 0)
            total = np.cumsum(size[first[new]] + 1)
            a = 0
            while a < len(new):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BUILD, side="right")))
                at[new[a:b]] = self.add(code, begin[first[new[a:b]]], size[first[new[a:b]]])
                a = b
            self.unit.update(zip(map(known.__getitem__, new.tolist()), at[new].tolist()))
            at = at[which]
            if (self.code[np.repeat(at, size) + place] == code).all():
                return at
            self.clear()
            self.base += np.uint64(2)

    def add(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Build the lattices of the units of text that begin there, of size symbols each; returns their first nodes."""
        base = np.concatenate([[0], np.cumsum(size + 1)])
        code = text[np.minimum(np.repeat(begin - base[:-1], size + 1) + np.arange(base[-1]), len(text) - 1)].astype(np.uint64)
        code[base[1:] - 1] = 0
        self._put("code", self.n, code)
        total = len(code)
        room = np.repeat(base[1:] - 1, size + 1) - np.arange(total)  # symbols to the unit's end
        node = np.flatnonzero(room > 0)
        h = np.zeros(len(node), np.uint64)
        found = []
        for k in range(1, self.longest + 1):
            h = h * _B + code[node + (k - 1)] + np.uint64(1)
            at = self.find(h)
            live = at >= 0
            p = np.where(live, self.piece[at], -1) if len(self.prefix) else at
            hit = p >= 0
            found.append((node[hit], node[hit] + k, p[hit], self.vocab["weight"][p[hit]]))
            if k == 1:
                miss = node[~hit]
                cost = [sum(self.vocab["weight"][self.vocab["bytes"][b]] for b in chr(int(c)).encode("utf-8", "surrogatepass")) for c in code[miss]]
                plain = np.array([self.vocab["bytes"][int(c)] if c < 128 else -int(c) - 1 for c in code[miss]], np.int64)
                found.append((miss, miss + 1, plain, np.array(cost, float)))
            more = live & (room[node] > k)
            node, h = node[more], h[more]
            if not len(node):
                break
        a, e, p, w = (np.concatenate(x) for x in zip(*found[::-1]))
        order = np.argsort(a, kind="stable")  # longest edges first, as the likelier ones: drawing tries them in turn
        a, e, p, w = a[order], e[order], p[order], w[order]
        beta = np.zeros(total)
        level = room[a].astype(np.uint16 if size.max() < 1 << 16 else np.int64)  # short integers are sorted by radix
        back = np.argsort(level, kind="stable")
        r, at, to, cost = level[back], a[back], e[back], w[back]
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(r) != 0])), [len(r)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            v = cost[lo:hi] + beta[to[lo:hi]]
            first = np.flatnonzero(np.concatenate([[True], at[lo + 1 : hi] != at[lo : hi - 1]]))
            top = np.maximum.reduceat(v, first)
            size_of = np.diff(np.append(first, hi - lo))
            beta[at[lo:hi][first]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size_of)), first))
        lp = w + beta[e] - beta[a]
        first = np.searchsorted(a, np.arange(total + 1))
        run = np.cumsum(np.exp(lp))
        before = np.concatenate([[0.0], run])[first[:-1]]
        cum = run - before[a]
        cum[first[1:][first[1:] > first[:-1]] - 1] = 2.0
        for name, x in (("end", e + self.n), ("edge_piece", p), ("lp", lp), ("cum", cum)):
            self._put(name, self.m, x)
        self._put("first", self.n, first + self.m)  # one more than nodes: where the last one's edges stop
        self.n, self.m = self.n + total, self.m + len(e)
        return base[:-1] + self.n - total

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.first[node].astype(np.int64)
        on = np.flatnonzero(self.cum[e] <= u)
        while len(on):
            e[on] += 1
            on = on[self.cum[e[on]] <= u[on]]
        return e


def _descend(lat: Lattices, node, shift, key):
    """Follow one drawn child at a time from each node to its unit's end: (index, node, edge) in order of index and step.

    A node's place in its document is node + shift; each draw is a hash of the key and that place, so no two of a path are alike.
    """
    out, idx = [], np.arange(len(node))
    while len(idx):
        going = lat.first[node + 1] > lat.first[node]
        if not going.all():
            idx, node = idx[going], node[going]
        e = lat.draw(node, _uniform(key[idx], node + shift[idx]))
        out.append((idx, node, e))
        node = lat.end[e].astype(np.int64)
    i, n, e = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64) for _ in range(3))
    order = np.argsort(i, kind="stable")
    return i[order], n[order], e[order]


def _side_groups(lat: Lattices, node, edge, phi, doc, place, bound, key, keep: int):
    """The keep best groups of children not taken of each document's path: (document, token, perturbed log-probability).

    The children of a token's node but the one taken are one subtree, with the log of their summed probability as its
    location. Per token: node and edge taken, log-probability before it, document (rising) and place; per document: bound and
    key. A uniform of 53 bits gives a Gumbel between -3.7 and 37.5, so tokens whose location is too far below
    that of the document's first keep groups cannot be among the best, and are left out without loss.
    """
    many = np.flatnonzero(lat.first[node + 1] - lat.first[node] > 1)
    if not len(many):
        return []
    d, f = doc[many], phi[many]
    with np.errstate(divide="ignore"):
        loc = f + np.log(-np.expm1(np.minimum(lat.lp[edge[many]], 0.0)))
    first = np.flatnonzero(np.concatenate([[True], np.diff(d) != 0]))
    size = np.diff(np.append(first, len(d)))
    low = np.full(len(first), np.inf)
    for k in range(keep):
        low = np.where(size > k, np.minimum(low, loc[np.minimum(first + k, len(loc) - 1)]), -np.inf)
    on = np.flatnonzero(f >= np.repeat(low, size) - 41.5)
    many, d, loc = many[on], d[on], loc[on]
    g = loc - np.log(-np.log(_uniform(key[d], place[many])))  # rises with the truncated Gumbel's value, which only the best need
    out = []
    for _ in range(keep):
        first = np.flatnonzero(np.concatenate([[True], np.diff(d) != 0]))
        top = np.maximum.reduceat(g, first)
        hit = np.flatnonzero(g == np.repeat(top, np.diff(np.append(first, len(g)))))
        hit = hit[np.concatenate([[True], np.diff(d[hit]) != 0])]
        live = hit[g[hit] > -np.inf]
        b = bound[d[live]]
        out.append((d[live], many[live], b - np.logaddexp(0.0, b - g[live])))
        g[hit] = -np.inf
        if not len(live):
            break
    return out


def segmentations(lat: Lattices, texts: list[str], keys: list[int], samples: int = SAMPLES, seed: int = SEED) -> list[list[tuple[list[int], float, float, float]]]:
    """search() with piece ids."""
    found = search(lat, texts, keys, samples, seed)
    at, ids = expand(lat, [x[0] for rows in found for x in rows])
    each = iter(np.split(ids, at[1:-1]))
    return [[(next(each).tolist(), *x[1:]) for x in rows] for rows in found]


def _taken(lat: Lattices, node: int, out: list[int], u: float) -> int:
    """One of a node's edges but those out, by probability."""
    edges = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in out]
    p = np.exp(lat.lp[edges])
    return edges[min(int(np.searchsorted(np.cumsum(p), u * p.sum(), side="right")), len(edges) - 1)]


def search(lat: Lattices, texts: list[str], keys: list[int], samples: int = SAMPLES, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to samples distinct segmentations: (edges, log-probability, perturbed log-probability, inclusion score).

    Fewer come back if the text has fewer. Inclusion is the chance of a perturbed value above the threshold, the perturbed value of the next segmentation; 1 if there is none.
    A queue holds the groups of children passed by; the best is popped, one of its children is drawn and followed, and the rest of the group goes back with Gumbels truncated at the value popped.
    """
    if not texts:
        return []
    if lat.bytes() > MAX_BYTES:
        lat.clear()
    code, text, at = units(texts)
    start = lat.nodes(code, at)
    cut = np.append(np.searchsorted(at, text), len(at))  # units of each text
    shift = at - np.repeat(text, np.diff(cut)) - start  # of a unit: place in the document less node
    del code
    key = np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), seed) for k in keys], np.uint64)
    stream = lambda kind, sample: _mix(key + _B * np.array([64 * sample + kind], np.uint64))
    value = -np.log(-np.log(_uniform(stream(1, 0), 0)))
    todo = np.arange(len(texts))  # documents whose next path is to be drawn
    unit0 = cut[:-1].copy()  # the unit in which the path's drawn part begins
    head = start[unit0]
    prefix = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    out: list[list] = [[] for _ in texts]
    queue: list[list] = [[] for _ in texts]  # (value, path, token, edges out)
    for sample in range(1, samples + 1):
        size = cut[todo + 1] - unit0[todo]
        doc = np.repeat(todo, size)
        of = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + unit0[doc]
        node = start[of]
        node[np.cumsum(size) - size] = head[todo]
        i, n, e = _descend(lat, node, shift[of], stream(2, sample)[doc])
        ends = np.append(np.searchsorted(doc[i], todo), len(i))
        before = np.array([lat.lp[prefix[t][1]].sum() for t in todo.tolist()])
        lp = lat.lp[e]
        run = np.cumsum(lp) - lp
        base = np.concatenate([run, [0.0]])[ends[:-1]]
        total = np.concatenate([run, [lp.sum()]])[ends[1:]] - base + before if len(lp) else before
        which = np.repeat(np.arange(len(todo)), np.diff(ends))
        paths = []
        for j, t in enumerate(todo.tolist()):
            a, b = ends[j], ends[j + 1]
            paths.append((np.concatenate([prefix[t][0], n[a:b]]), np.concatenate([prefix[t][1], e[a:b]])) if len(prefix[t][1]) else (n[a:b], e[a:b]))
            out[t].append((paths[j][1], float(total[j]), float(value[t])))
        for d, token, g in _side_groups(lat, n, e, run - base[which] + before[which], which, n + shift[of[i]], value[todo], stream(3, sample)[todo], samples + 1 - sample):
            for x, p, v in zip(d.tolist(), token.tolist(), g.tolist()):
                queue[todo[x]].append((v, paths[x], p - int(ends[x]) + len(prefix[todo[x]][1]), [int(e[p])]))
        following = []
        choose, again = _uniform(stream(4, sample), 0), _uniform(stream(5, sample), 0)
        for t in todo.tolist():
            if not queue[t]:
                continue
            queue[t].sort(key=lambda x: x[0])
            if sample == samples:  # only its value is wanted, as the threshold
                value[t] = queue[t][-1][0]
                out[t].append(None)
                continue
            v, (nodes, edges), token, gone = queue[t].pop()
            o = _taken(lat, int(nodes[token]), gone, float(choose[t]))
            left = [x for x in range(int(lat.first[nodes[token]]), int(lat.first[nodes[token] + 1])) if x != o and x not in gone]
            if left:
                g = lat.lp[edges[:token]].sum() + np.log(np.exp(lat.lp[left]).sum()) - np.log(-np.log(again[t]))
                queue[t].append((float(v - np.logaddexp(0.0, v - g)), (nodes, edges), token, [*gone, o]))
            value[t] = v
            closed = lat.end[edges[:token]].astype(np.int64)
            unit0[t] = cut[t] + int(np.count_nonzero(lat.first[closed + 1] == lat.first[closed]))  # units ended before the branch
            prefix[t] = (nodes[: token + 1], np.append(edges[:token], o))
            head[t] = lat.end[o]
            following.append(t)
        todo = np.array(following, np.int64)
        if not len(todo):
            break
    done = []
    for t, rows in enumerate(out):
        bound = value[t] if rows and rows[-1] is None else None
        done.append([(e, lp, g, 1.0 if bound is None else float(-np.expm1(-np.exp(min(lp - bound, 700.0))))) for e, lp, g in rows[:samples]])
    return done


def expand(lat: Lattices, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths, one after the other, and where each begins (and the last ends). Characters without a piece give their UTF-8 bytes' pieces."""
    p = lat.edge_piece[np.concatenate(paths)] if paths else np.zeros(0, np.int64)
    at = np.cumsum([0, *map(len, paths)])
    lone = np.flatnonzero(p < 0)
    if not len(lone):
        return at, p.astype(np.int32)
    code = -p[lone] - 1
    width = 2 + (code >= 1 << 11) + (code >= 1 << 16)
    count = np.ones(len(p), np.int64)
    count[lone] = width
    begin = np.concatenate([[0], np.cumsum(count)])
    ids = np.repeat(p, count)
    byte_piece = np.array(lat.vocab["bytes"])
    for k in range(4):
        on = width > k
        part = code[on] >> 6 * (width[on] - 1 - k)
        ids[begin[lone[on]] + k] = byte_piece[part & 63 | 128 if k else part | (0xF00 >> width[on]) & 255]
    return begin[at], ids.astype(np.int32)


def decode_all(vocab: dict, at: np.ndarray, ids: np.ndarray) -> pa.Array:
    """decode() of many at once, as binary, with the blank put before every text."""
    if "raw" not in vocab:
        raw = [t.replace(SPACE, " ").encode() for t in vocab["text"]]
        for b, i in enumerate(vocab["bytes"]):
            raw[i] = bytes([b])
        vocab["raw"] = pa.array(raw, pa.large_binary())
    parts = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), vocab["raw"].take(pa.array(ids)))
    return pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))


def decode(vocab: dict, ids: list[int]) -> str:
    """Text of piece ids; byte pieces are joined to UTF-8, bad bytes replaced."""
    if "out" not in vocab:
        vocab["out"] = list(vocab["text"])
        for b, i in enumerate(vocab["bytes"]):
            vocab["out"][i] = chr(b) if b < 128 else chr(0xDC00 + b)  # lone surrogates stand for bytes
    t = "".join(map(vocab["out"].__getitem__, ids))
    try:
        t.encode()
    except UnicodeEncodeError:
        t = t.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return t.replace(SPACE, " ")[1:]


def row_key(doc_id) -> int:
    """The number that a row's draws hang on: a whole doc_id itself, -1 without one, else a 63-bit hash of its text."""
    if doc_id is None or isinstance(doc_id, int):
        return -1 if doc_id is None else doc_id
    return xxhash.xxh64_intdigest(str(doc_id).encode()) >> 1


def sample(docs: DataFrame, model_path: str, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(doc_id, sample, ids, log_prob, perturbed, inclusion, round_trip): up to samples rows for every row of docs.

    round_trip says that the ids decode to the text (a text that holds U+2581 itself comes back with blanks). A null or empty text has the one segmentation
    of the blank put before every text. Equal doc_ids draw alike; a null doc_id draws as -1, one that is no integer by a hash of its text. Very long words without blanks cost time and memory in proportion. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        vocab = vocabulary(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # a fixed vocabulary

    def run(batches):
        lat = Lattices(shared.value)
        for batch in batches:
            for b in slices(batch, 1, SLICE):
                texts = [t or "" for t in b.column(1).to_pylist()]
                found = search(lat, texts, list(map(row_key, b.column(0).to_pylist())), samples, seed)
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                at, ids = expand(lat, [x[0] for f in found for x in f])
                want = pa.array([b" " + t.encode() for t in texts], pa.large_binary()).take(pa.array(row))
                same = pc.equal(decode_all(lat.vocab, at, ids), want)
                rank = pa.array([k for f in found for k in range(1, len(f) + 1)], pa.int32())
                scores = [pa.array([x[k] for f in found for x in f], pa.float64()) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), rank, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), *scores, same], ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): the model's own single segmentation; a null text counts as empty."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            for b in slices(batch, 1):
                ids = sp.encode([t or "" for t in b.column(1).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded (ids, ...) with text added; null ids give a null text."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(f.read()))

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        return pd.Series([None if x is None else decode(shared.value, list(x)) for x in ids])

    return encoded.withColumn("text", text("ids"))
