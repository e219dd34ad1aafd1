"""N-gram Jaccard join: universe partition by token hash, segment signatures with one-deletion neighbourhoods, exact verification.

Two sets of sizes a and b with Jaccard similarity t % or more differ in at most H = (100 - t)(a + b) / (100 + t) tokens.
A scheme for a band of sizes deals all tokens to m > H segments by their hash, so at least m - H segments of two such sets
are equal. A set may skip m - H - 1 segments of its own (empty ones first, then those whose signatures many sets share) and
still meets each partner in one that is left. Allowing a segment one difference, by its one-deletion neighbourhood, pays for
one more skip: sum(allowed + 1) over the segments must stay H + 1, with -1 for a skipped one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import dropped, release, saved

SHINGLE, PERCENT = 5, 80
#: Postings that one task sorts, about, members of a hub that one task compares, and rows of small hubs that one call gets, about.
BUCKET, BLOCK, CELL = 1_000_000, 2048, 4_000
#: Bits a candidate, at least, and bits at least and at most, of the bitmap that finds candidates' texts.
SPARSE, BITMAP = 16, (1 << 20, 1 << 28)
#: Ratio of a band's sizes; sets of under SMALL tokens have one-deletion neighbourhoods of all segments, others of every sixteenth.
RATIO, SMALL = 1.5, 64
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of fewer words, the whole sequence; of none, nothing."""
    import xxhash

    # On bytes, lower() and split() know A-Z and the white space \x20\x09-\x0D alone.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, np.uint64(min(len(w), size)))
    for k in range(min(len(w), size)):
        h = _mix(h * _M + w[k : k + n])
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


class Schemes:
    """Bands of sizes and, for each, the differences allowed, the segments and how many of them have deletion neighbourhoods."""

    def __init__(self, percent: int = PERCENT):
        self.t, lo = percent, [1]
        while lo[-1] < 1 << 40:
            lo.append(max(lo[-1] + 1, math.ceil(lo[-1] * RATIO)))
        self.lo = lo
        self.h = [(100 - percent) * 2 * (hi - 1) // (100 + percent) for hi in lo[1:]]
        self.m = [h + 1 + max(1, h // 4) for h in self.h]
        self.q = [m if hi <= SMALL else -(-m // 16) for m, hi in zip(self.m, lo[1:], strict=True)]
        self._lo = np.array(lo)

    def of(self, n: int) -> list[int]:
        """The schemes in which a set of n tokens stands: that of its band, and the next one's where it has larger partners there."""
        b = int(np.searchsorted(self._lo, n, "right")) - 1
        return [s for s in (b, b + 1) if self.h[s] and (s == b or n * 100 >= self.lo[s] * self.t)]

    def spare(self, s: int, empty: int) -> int:
        """Segments that a set may skip in scheme s besides its empty ones; under 0: as many must take a deletion."""
        return self.m[s] - self.h[s] - 1 - empty

    def lacks(self, s: int, empty: int, able: int) -> bool:
        """Whether a set has too few segments of its own to be sure of meeting a partner."""
        return self.spare(s, empty) + able < 0

    def signatures(self, x: np.ndarray, s: int):
        """sig, segment, deletion flag of a sorted set's postings in scheme s; its empty segments; its segments that can take one deletion."""
        m, q = self.m[s], self.q[s]
        seg = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as x is
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        own, size = seg[starts], np.diff(np.r_[starts, len(x)])
        mixed = _mix(x + _M)
        total = np.add.reduceat(mixed, starts)
        base = np.uint64(s * 0xD6E8FEB86659FD93 % (1 << 64)) + own * np.uint64(0xA0761D6478BD642F)
        exact = _mix(total + base)
        able = (own < q) & (size >= 2)
        token = np.repeat(able, size)
        less = _mix(np.repeat(total + base, size)[token] - mixed[token])
        sig = np.concatenate([exact, less])
        return sig, np.concatenate([own, np.repeat(own, size)[token]]).astype(np.uint32), np.r_[np.zeros(len(exact), np.uint8), np.ones(len(less), np.uint8)], m - len(own), int(able.sum())


def sketch_bits(n):
    """Bits of the sketch of a set of n tokens: a power of two from 2 * n on, 512 at least. Works on arrays too."""
    return np.maximum(512, np.exp2(np.ceil(np.log2(2 * np.maximum(n, 1)))).astype(np.int64))


def sketch(x: np.ndarray) -> bytes:
    """Parities: bit k is the parity of the tokens whose hash ends in k. Two sets' sketches differ in no more bits than the sets in
    tokens, also after a longer one is folded: its halves, added, are the shorter sketch of the same set."""
    bits = int(sketch_bits(len(x)))
    return np.packbits(np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _squeezed(v: np.ndarray) -> bytes:
    """An array as bytes, the first byte of all numbers before the second: high bytes of small numbers then take no room."""
    import pyarrow as pa

    planes = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()
    small = len(planes).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)
    return b"z" + small if len(small) < len(planes) else b"-" + planes


def _plain(raw: bytes, kind: str) -> np.ndarray:
    import pyarrow as pa

    planes = raw[1:] if raw[:1] == b"-" else pa.decompress(raw[5:], int.from_bytes(raw[1:5], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, bytes]]]:
    """The columns' rows of each bucket, squeezed."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    for a, z in zip(starts, np.r_[starts[1:], len(b)].astype(int) if len(b) else [], strict=True):
        yield int(b[a]), {k: _squeezed(v[order[a:z]]) for k, v in columns.items()}


def _unpacked(table, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([np.zeros(0, t), *(_plain(x, t) for x in table.column(k).to_pylist() if x)]) for k, t in kinds.items()}


#: What a document has in each bucket that its postings come to: at 30 GB nearly every posting has a head of its own. The fingerprint
#: has FINGER bits here; equal ones by chance, of different sets under one signature, are one in 2 ** FINGER pairs.
FINGER = 48
_HEAD = {"h_doc": "<i8", "h_fp": "<u8", "h_scheme": "u1", "h_empty": "<u4", "h_able": "<u4", "h_count": "<u4"}
#: A signature within its bucket takes five bytes: equal ones by chance only add candidates. Segments without deletions are all _FAR.
_FAR = np.uint32(0xFFFFFFFF)
_POST = {"low": "<u4", "high": "u1", "seg": "<u4", "del_": "u1"}
_DOC = {"d_doc": "<i8", "d_n": "<u4", "d_fp": "<u8", "d_fp2": "<u8", "d_lacking": "u1"}
_SHARED = {"doc": "<i8", "fp": "<u8", "scheme": "u1", "empty": "<u4", "able": "<u4", "sig": "<u8", "seg": "<u4", "del_": "u1", "cx": "<u4", "cd": "<u4"}
_ASKED = {"sig": "<u8", "doc": "<i8", "probe": "u1"}


def _fields(kinds: Iterable[str]) -> str:
    return ", ".join(f"{k} binary" for k in kinds)


def _batch(rows: list[dict], names: list[str], ints: Iterable[str] = ()):
    import pyarrow as pa

    return pa.table({k: pa.array([r.get(k) for r in rows], pa.int64() if k in ints else pa.binary()) for k in names})


def _postings(documents: DataFrame, schemes: Schemes, size: int, buckets: int) -> DataFrame:
    names = ["bucket", *_HEAD, *_POST, *_DOC, "d_sketch"]

    def run(batches: Iterable) -> Iterator:
        heads: list[tuple] = []
        posts: list[tuple] = []
        docs: list[tuple] = []
        sketches: list[bytes] = []
        held = 0

        def flush():
            nonlocal heads, posts, docs, sketches, held
            out: list[dict] = []
            if docs:
                d = {k: np.array(c, t) for (k, t), c in zip(_DOC.items(), zip(*docs, strict=True), strict=True)}
                at = np.arange(len(docs), dtype=np.int64)
                for b, c in _packed(d["d_fp"] % np.uint64(buckets), d | {"at": at}):
                    out.append({"bucket": b, "d_sketch": b"".join(sketches[i] for i in _plain(c.pop("at"), "<i8").tolist()), **c})
            if posts:
                h = {k: np.array(c, t) for (k, t), c in zip(_HEAD.items(), zip(*heads, strict=True), strict=False)}
                of = np.repeat(np.arange(len(heads)), [len(p[0]) for p in posts])
                sig, seg, dele = (np.concatenate(c) for c in zip(*posts, strict=True))
                bucket, within = sig % np.uint64(buckets), sig // np.uint64(buckets)
                low, high = (within & np.uint64(0xFFFFFFFF)).astype("<u4"), (within >> np.uint64(32)).astype("u1")
                order = np.argsort(bucket, kind="stable")
                at = _starts(bucket[order])
                # Only buckets that occur here, however many there are.
                for a, z in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
                    o = order[a:z]
                    mine, count = np.unique(of[o], return_counts=True)
                    out.append({"bucket": int(bucket[o[0]]), "h_count": _squeezed(count.astype("<u4")), "low": _squeezed(low[o]), "high": _squeezed(high[o]), "seg": _squeezed(seg[o]), "del_": _squeezed(dele[o])} | {k: _squeezed(v[mine]) for k, v in h.items()})
            heads, posts, docs, sketches, held = [], [], [], [], 0
            table = _batch(out, names, ["bucket"])
            yield from table.to_batches()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                x = shingle_set(text.as_py(), size)
                fp, fp2 = (int(np.add.reduce(_mix(x * _M))), int(np.bitwise_xor.reduce(_mix(x + _M)))) if len(x) else (doc % (1 << 64), 0)
                lacking = False
                for s in schemes.of(len(x)) if len(x) else ():
                    sig, seg, dele, empty, able = schemes.signatures(x, s)
                    lacking |= schemes.lacks(s, empty, able)
                    heads.append((doc, fp >> (64 - FINGER), s, empty, able))
                    posts.append((sig, np.where(seg < schemes.q[s], seg, _FAR).astype(np.uint32), dele))
                    held += len(sig)
                docs.append((doc, len(x), fp, fp2, lacking))
                sketches.append(sketch(x))
                if held >= 500_000:
                    yield from flush()
        yield from flush()
        release()

    return documents.mapInArrow(run, "bucket long, " + _fields(names[1:]))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, the keys being sorted."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _share(buckets: int):
    """Of a bucket of postings: a row per document with the smallest id of its set, and the postings that other sets share, dealt by document."""

    def run(key, table):
        import pyarrow as pa

        release()
        d = _unpacked(table, _DOC)
        size = sketch_bits(d["d_n"]) // 8
        ends, raw = np.cumsum(size), b"".join(x for x in table.column("d_sketch").to_pylist() if x)
        order = np.lexsort((d["d_doc"], d["d_fp2"], d["d_fp"], d["d_n"]))
        bits = [raw[e - k : e] for e, k in zip(ends[order].tolist(), size[order].tolist(), strict=True)]
        doc, n, lacking = d["d_doc"][order], d["d_n"][order], d["d_lacking"][order]
        at = _starts(n, d["d_fp"][order], d["d_fp2"][order]) if len(doc) else np.zeros(0, int)
        rep = np.repeat(doc[at], np.diff(np.r_[at, len(doc)])) if len(doc) else doc
        rep = np.where(n == 0, doc, rep)
        h, p = _unpacked(table, _HEAD), _unpacked(table, _POST)
        of = np.repeat(np.arange(len(h["h_doc"])), h["h_count"])
        within = p["low"].astype(np.uint64) | (p["high"].astype(np.uint64) << np.uint64(32))
        order = np.argsort(within, kind="stable")
        s = within[order]
        at = _starts(s) if len(s) else np.zeros(0, int)
        some = order[np.repeat(np.diff(np.r_[at, len(s)]) > 1, np.diff(np.r_[at, len(s)]))]
        # Of equal sets only the one with the smallest id stays.
        fp, of, sig, dele = h["h_fp"][of[some]], of[some], within[some], p["del_"][some]
        order = np.lexsort((h["h_doc"][of], dele, fp, sig))
        first = order[_starts(sig[order], fp[order], dele[order])] if len(order) else order
        some, of, sig, dele = some[first], of[first], sig[first], dele[first]
        at = _starts(sig) if len(sig) else np.zeros(0, int)
        length = np.diff(np.r_[at, len(sig)])
        cd = np.add.reduceat(dele.astype(np.int64), at) if len(sig) else np.zeros(0, np.int64)
        cx = length - cd
        keep = np.repeat((cx > 1) | ((cx > 0) & (cd > 0)), length)
        whole = sig * np.uint64(buckets) + np.uint64(key[0].as_py())
        cols = {"doc": h["h_doc"][of], "fp": h["h_fp"][of], "scheme": h["h_scheme"][of], "empty": h["h_empty"][of], "able": h["h_able"][of], "sig": whole, "seg": p["seg"][some], "del_": dele, "cx": np.repeat(cx, length).astype("<u4"), "cd": np.repeat(cd, length).astype("<u4")}
        cols = {k: v[keep] for k, v in cols.items()}
        part = _mix(cols["doc"].astype(np.uint64)) % np.uint64(buckets)
        packed = [{"part": b, **c} for b, c in _packed(part, cols)]
        flat = pa.table({"kind": pa.array(np.zeros(len(doc), np.int64)), "doc_id": pa.array(doc), "n_shingles": pa.array(n.astype(np.int64)), "rep": pa.array(rep), "lacking": pa.array(lacking > 0), "sketch": pa.array(bits, pa.binary())})
        rest = _batch(packed, ["part", *_SHARED], ["part"]).append_column("kind", pa.array([1] * len(packed), pa.int64()))
        both = pa.concat_tables([flat, rest], promote_options="default")
        return both.select(["kind", "doc_id", "n_shingles", "rep", "lacking", "sketch", "part", *_SHARED])

    return run


def _allocate(schemes: Schemes, buckets: int):
    """Of a part's documents: which shared postings they probe with. Skips what they may, the postings that most sets share first."""

    def run(key, table):
        c = _unpacked(table, _SHARED)
        order = np.lexsort((c["del_"], c["scheme"], c["fp"], c["doc"]))
        c = {k: v[order] for k, v in c.items()}
        at = _starts(c["doc"], c["fp"], c["scheme"]) if len(order) else np.zeros(0, int)
        ends = np.r_[at[1:], len(order)].astype(int) if len(order) else at
        probe = np.zeros(len(order), np.uint8)
        lacking: list[int] = []
        for a, z in zip(at.tolist(), ends.tolist(), strict=True):
            s, empty, able = int(c["scheme"][a]), int(c["empty"][a]), int(c["able"][a])
            dele, seg, cx, cd = c["del_"][a:z], c["seg"][a:z], c["cx"][a:z].astype(np.int64), c["cd"][a:z].astype(np.int64)
            exact = np.flatnonzero(dele == 0)
            near = (dele == 1) | (cd > 0)
            touched = np.unique(seg[seg != _FAR])
            # Deletion segments that no other set comes near take one difference at no cost, and each pays for a skip.
            free = max(0, able - len(touched))
            skips = schemes.spare(s, empty) + free
            if skips < 0:
                cost = dict.fromkeys(touched.tolist(), 0)
                for g, k in zip(seg[near].tolist(), (cx + cd)[near].tolist(), strict=True):
                    cost[g] += k
                sized = set(np.unique(seg[dele == 1]).tolist())  # of at least two tokens for certain
                chosen = sorted((g for g in cost if g in sized), key=lambda g: (cost[g], g))[:-skips]
                if len(chosen) < -skips:
                    lacking.append(int(c["doc"][a]))
                probe[a:z][(dele == 1) & np.isin(seg, chosen)] = 1
                probe[a:z][exact] = 1
            else:
                worst = exact[np.argsort(-cx[exact], kind="stable")]
                probe[a:z][worst[skips:]] = 1
        bucket = c["sig"] % np.uint64(buckets)
        rows = [{"part": key[0].as_py(), "bucket": b, **x} for b, x in _packed(bucket, {"sig": c["sig"], "doc": c["doc"], "probe": probe})]
        rows += [{"part": d} for d in sorted(set(lacking))]  # no bucket: a document that must be looked up otherwise
        return _batch(rows, ["part", "bucket", *_ASKED], ["part", "bucket"])

    return run


def _hubs(key, table):
    """hub, doc: all sets under a signature that one of them probes with, each beside the one of the smallest id."""
    import pyarrow as pa

    c = _unpacked(table, _ASKED)
    order = np.lexsort((c["doc"], c["sig"]))
    sig, doc, probe = c["sig"][order], c["doc"][order], c["probe"][order]
    at = _starts(sig) if len(sig) else np.zeros(0, int)
    size = np.diff(np.r_[at, len(sig)]).astype(int)
    hub = np.repeat(doc[at], size)
    keep = (np.repeat(np.maximum.reduceat(probe, at), size) > 0) & (hub != doc) if len(at) else np.zeros(0, bool)
    both = np.unique(np.stack([hub[keep], doc[keep]], axis=1), axis=0)
    return pa.table({"hub": pa.array(both[:, 0], pa.int64()), "doc_id": pa.array(both[:, 1], pa.int64())})


def _folded(rows: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words, folded down to `width` words."""
    m = np.frombuffer(b"".join(rows), "<u8").reshape(len(rows), -1)
    while m.shape[1] > width:
        m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    return m


class _Group:
    """The members of a hub that stand in one block pair, by sketch length."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int):
        self.n, self.bits, self.percent = n.astype(np.int64), bits, percent
        self.width = sketch_bits(self.n) // 64

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs (x, y) of rows: whether sizes and sketches allow a link. They never rule one out."""
        n, t = self.n, self.percent
        ok = 100 * np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y])
        narrow = np.minimum(self.width[x], self.width[y])
        for w in np.unique(narrow[ok]).tolist():
            at = np.flatnonzero(ok & (narrow == w))
            used, of = np.unique(np.r_[x[at], y[at]], return_inverse=True)
            words = np.empty((len(used), w), np.uint64)
            for k in np.unique(self.width[used]).tolist():
                same = np.flatnonzero(self.width[used] == k)
                words[same] = _folded([self.bits[i] for i in used[same].tolist()], w)
            p, q = of[: len(at)], of[len(at) :]
            step = max(1, (1 << 21) // w)
            for i in range(0, len(at), step):
                differ = np.bitwise_count(words[p[i : i + step]] ^ words[q[i : i + step]]).sum(1, dtype=np.int64)
                some = at[i : i + step]
                ok[some] = differ * (100 + t) <= (100 - t) * (n[x[some]] + n[y[some]])
        return ok


def _runs(table, *columns: str):
    """The table sorted by integer columns, and the bounds of its runs of equal values."""
    keys = [table.column(k).to_numpy() for k in columns]
    order = np.lexsort(keys[::-1])
    at = _starts(*(k[order] for k in keys)) if len(order) else np.zeros(0, int)
    return table.take(order), at.tolist(), np.r_[at[1:], len(order)].astype(int).tolist() if len(order) else []


def _pairs(a: list, b: list):
    import pyarrow as pa

    a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (a, b))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _star_pairs(percent: int):
    """Candidates (a, b): each member of a hub with the hub itself, if their sizes and sketches allow a link."""

    def run(key, table):
        table, starts, ends = _runs(table, "hub", "block")
        hub, doc, n, bits = table.column("hub").to_numpy(), table.column("doc_id").to_numpy(), table.column("n").to_numpy(), table.column("sketch").to_pylist()
        a, b = [], []
        for s, z in zip(starts, ends, strict=True):
            g, d = _Group(n[s:z], bits[s:z], percent), doc[s:z]
            own = np.flatnonzero(d == hub[s])
            x, y = np.repeat(own, z - s), np.tile(np.arange(z - s), len(own))
            x, y = (v[d[x] != d[y]] for v in (x, y))
            ok = g.alike(x, y)
            a.append(d[x[ok]])
            b.append(d[y[ok]])
        return _pairs(a, b)

    return run


def _cross_pairs(percent: int):
    """Candidates (a, b): members of a hub in different components, if their sizes and sketches allow a link. Pairs with the hub
    were candidates before."""

    def run(key, table):
        table, starts, ends = _runs(table, "hub", "i", "j")
        hub, doc, n, label, block, i_, j_ = (table.column(k).to_numpy() for k in ("hub", "doc_id", "n", "label", "block", "i", "j"))
        bits = table.column("sketch").to_pylist()
        a, b = [], []
        for s, z in zip(starts, ends, strict=True):
            g, d, own = _Group(n[s:z], bits[s:z], percent), doc[s:z], label[s:z]
            left = np.flatnonzero((block[s:z] == i_[s]) & (d != hub[s]))
            right = np.flatnonzero((block[s:z] == j_[s]) & (d != hub[s]))
            step = max(1, 2_000_000 // max(1, len(right)))
            for k in range(0, len(left), step):
                x = left[k : k + step]
                p, q = np.nonzero((own[x][:, None] != own[right][None, :]) & ((i_[s] != j_[s]) | (x[:, None] < right[None, :])))
                p, q = x[p], right[q]
                ok = g.alike(p, q)
                a.append(d[p[ok]])
                b.append(d[q[ok]])
        return _pairs(a, b)

    return run


def _bitmap(ids: DataFrame) -> np.ndarray | None:
    """Packed bits, set at the hash of each id: a filter of bounded size (32 MB) before the join that decides. None where
    there are so many ids that most bits would be set."""
    wanted = SPARSE * ids.count()
    if wanted > SPARSE // 2 * BITMAP[1]:
        return None
    size = int(np.clip(1 << max(0, wanted - 1).bit_length(), *BITMAP))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_place(batch.column(0).to_numpy(), size)] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for r in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def _place(ids: np.ndarray, size: int) -> np.ndarray:
    return (_mix(ids.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _verified(documents: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Only candidates' texts become sets; rows of one id are all compared."""
    ids = saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-ids")
    bitmap = _bitmap(ids)
    if bitmap is None:
        documents = documents.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    bits = documents.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterable) -> Iterator:
        import pyarrow as pa

        release()
        packed = bits.value
        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            if packed is None:
                hit = np.arange(len(doc))
            else:
                at = _place(doc, 8 * len(packed))
                hit = np.flatnonzero(packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            texts = batch.column("text").take(pa.array(hit)).to_pylist()
            for i in range(0, len(hit), 1000):
                yield pa.RecordBatch.from_pydict({"id": pa.array(doc[hit[i : i + 1000]], pa.int64()), "x": pa.array([shingle_set(t, size).tobytes() for t in texts[i : i + 1000]], pa.binary())})

    found = documents.mapInArrow(sets, "id long, x binary").join(ids, "id", "left_semi").distinct()
    found = saved(found, "jaccard-sets")
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(found.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")

    def check(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i, (xa, xb) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (xa, xb))
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                common = int(np.count_nonzero(z[1:] == z[:-1]))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in ("a", "b")], names=["a", "b"])

    links = saved(both.select("a", "b", "xa", "xb").mapInArrow(check, "a long, b long").distinct(), "jaccard-links")
    dropped(ids, found)
    return links


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of each node's component, a written table. Alternates large and small stars until nothing
    changes; each round is a written table, nothing is collected."""
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "component-edges")
    while True:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = saved(small, "component-edges")
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        dropped(edges)
        edges = new
        if same:
            break
    labels = saved(edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label"), "component-labels")
    dropped(edges)
    return labels


def _lacking_pairs(documents: DataFrame, ids: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates among the few sets whose hash left too few segments to choose from. Any other partner is sure to find them by its
    own signatures, so only two such sets can miss each other: the tokens of smallest hash of each, one more than a partner may
    lack, are joined."""

    def prefixes(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = shingle_set(text, size)
                first = x[: len(x) - (len(x) * percent + 99) // 100 + 1]
                yield pa.RecordBatch.from_pydict({"id": pa.array([doc] * len(first), pa.int64()), "token": pa.array(first.astype(np.int64))})

    first = documents.join(ids, "doc_id", "left_semi").mapInArrow(prefixes, "id long, token long").distinct()
    both = first.select(F.col("id").alias("a"), "token").join(first.select(F.col("id").alias("b"), "token"), "token")
    return both.where("a < b").select("a", "b").distinct()


def _members(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, doc_id, n, sketch, block, blocks: the sets beside each hub and the hub itself. A hub's members stand in blocks of about
    BLOCK, so that no task holds a large group; the hub is in each."""
    stars = saved(stars.distinct(), "jaccard-stars")
    counts = stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = counts.select("hub", F.col("hub").alias("doc_id"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rest = stars.join(counts, "hub").select("hub", "doc_id", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"))
    out = saved(rest.unionByName(own).join(sets, "doc_id"), "jaccard-members")
    dropped(stars)
    return out


def jaccard_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of `documents` (doc_id, text): near duplicates of all whole texts.

    Texts are compared by their sets of word shingles (see shingle_set); two link at a Jaccard similarity of percent / 100
    or more; component_id is the smallest doc_id that links reach. Equal sets are one set from the first shuffle on.
    Every link between components is verified exactly. Pairs within a component that is found already aren't listed: the
    sets under a signature first meet the one of the smallest id, their hub; then the members of each hub meet each other
    where they are in different components, once for all signatures that they share. What sizes and parity sketches rule
    out isn't listed. A set of no words links with nothing. Rows of one doc_id are one node with several texts. Null ids
    have no component (null). An empty table gives no rows.
    """
    schemes = Schemes(percent)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = slim.where("doc_id IS NOT NULL")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(total / 6 * 0.8) // BUCKET + 1)
    spread = _postings(named, schemes, size, buckets)
    fields = "kind long, doc_id long, n_shingles long, rep long, lacking boolean, sketch binary, part long, " + _fields(_SHARED)
    shared = saved(spread.groupBy("bucket").applyInArrow(_share(buckets), fields), "jaccard-shared")
    docs = saved(shared.where("kind = 0").select("doc_id", "n_shingles", "rep"), "jaccard-docs")
    asked = shared.where("kind = 1").select("part", *_SHARED).groupBy("part").applyInArrow(_allocate(schemes, buckets), "part long, bucket long, " + _fields(_ASKED))
    asked = saved(asked, "jaccard-asked")
    lacking = shared.where("kind = 0 AND lacking AND doc_id = rep").select("doc_id").union(asked.where("bucket IS NULL").select("part")).distinct()
    sets = shared.where("kind = 0 AND doc_id = rep AND n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "sketch").distinct()
    stars = asked.where("bucket IS NOT NULL").select("bucket", *_ASKED).groupBy("bucket").applyInArrow(_hubs, "hub long, doc_id long")
    members = _members(stars, sets)
    cells = max(1, members.count() // CELL)
    cell = lambda *by: F.pmod(F.xxhash64(*by), F.lit(cells))
    pairs = members.groupBy(cell("hub", "block").alias("cell")).applyInArrow(_star_pairs(percent), "a long, b long")
    pairs = saved(pairs.union(_lacking_pairs(named, lacking, size, percent)).distinct(), "jaccard-pairs")
    dropped(shared, asked)
    links = _verified(named, pairs, size, percent)
    labels = components(links)
    # Members of hubs that stand in several components: each block meets each block, itself included.
    known = members.join(labels, F.col("doc_id") == F.col("id"), "left").select("hub", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    open_ = known.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("hub")
    left = members.join(open_, "hub", "left_semi").join(labels, F.col("doc_id") == F.col("id"), "left").withColumn("label", F.coalesce("label", "doc_id"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("hub", "doc_id", "n", "sketch", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    more = left.groupBy(cell("hub", "i", "j").alias("cell")).applyInArrow(_cross_pairs(percent), "a long, b long").distinct()
    more = saved(more.join(pairs, ["a", "b"], "left_anti"), "jaccard-more")
    found = None if more.isEmpty() else _verified(named, more, size, percent)
    edges = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
    # A repeated doc_id joins the sets of its texts.
    several = docs.groupBy("doc_id").agg(F.countDistinct("rep").alias("k")).where("k > 1").select("doc_id")
    joined = docs.join(several, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    again = joined if found is None else joined.union(found)
    if not again.isEmpty():
        first, labels = labels, components(edges.union(again))
        dropped(first)
    result = docs.join(labels, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))

    def bare(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n_shingles": pa.array([len(shingle_set(t, size)) for t in batch.column("text").to_pylist()], pa.int64())})

    none = slim.where("doc_id IS NULL").select("text").mapInArrow(bare, "n_shingles long")
    result = saved(result.unionByName(none.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))), "jaccard-components")
    dropped(docs, members, pairs, links, more, labels, *([] if found is None else [found]))
    return result


def deduplicate(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, in their own columns, of which one of each component stays: that with the smallest doc_id.
    Rows of one doc_id stay or go together; rows with a null id stay, as do texts without words."""
    found = jaccard_components(documents.select("doc_id", "text"), size, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return documents.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
