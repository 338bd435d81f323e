"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def ok_vector(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def vector_links(rows, threshold=0.95):
    """{id: (n_links, component)}"""
    ids = [i for i, v in rows if ok_vector(v)]
    x = np.array([v for _, v in rows if ok_vector(v)], float).reshape(len(ids), -1)
    x /= np.linalg.norm(x, axis=1)[:, None] if len(x) else 1
    near = (x @ x.T) >= threshold
    u, n = Union(), Counter()
    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        n[ids[a]] += 1
        n[ids[b]] += 1
        u.join(ids[a], ids[b])
    return {i: (n[i], u.root(i)) for i, _ in rows}


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_copies(rows, width=2, percent=80):
    """{id: (set size, component)}"""
    sets = {i: shingle_set(t, width) for i, t in rows}
    ids, u = [i for i in sets if sets[i]], Union()
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = len(sets[a]), len(sets[b])
            if 100 * min(x, y) >= percent * max(x, y):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (x + y - both):
                    u.join(a, b)
    return {i: (len(s), u.root(i)) for i, s in sets.items()}


def repeated_bytes(data, length=200):
    """For each byte string which of its bytes a repeated string of ``length`` bytes covers."""
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    out = []
    for d, gone in zip(data, repeated_bytes(data, length), strict=True):
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def without_repeats(texts, length=200):
    """Each text without the characters of which every byte repeats; null stays null."""
    out = []
    for t, gone in zip(texts, repeated_bytes([(t or "").encode() for t in texts], length), strict=True):
        left, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not gone[at : at + n].all():
                left.append(c)
            at += n
        out.append(t if t is None else "".join(left))
    return out


def mixed(rows, most=3):
    """How often each row (id, text, source) is taken."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    target, free = {}, set(names)
    while free:
        left, w = sum(own.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > most * own[s]}
        for s in over or free:
            target[s] = most * own[s] if over else left * weight[s] / w
        free -= over or free
    out = []
    for n, (i, _, s) in zip(size, rows, strict=True):
        rate = target[s] / own[s] if own[s] else 0.0
        key = "|".join(["mix", "null" if i is None else str(i), str(n), "null" if s is None else s])
        draw = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        out.append(int(rate) + (draw < rate - int(rate)))
    return out


def nearest(rows, is_query, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if ok_vector(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, v in good:
        if is_query(i):
            s = (x @ v) / (norm * np.sqrt(v @ v))
            out[i] = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
    return out


def check_packing(got, texts, path, room=2048):
    """Checks every piece against the library; returns (sequences, least possible)."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = {}
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), room)):
            part = ids[at : at + room]
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= room
    return len(by), -(-sum(w[1] for w in want.values()) // room)


def hard_negatives(rows, is_anchor, positives=5, negatives=3):
    """(anchor, positive, rank, negative, positive score, negative score) from rows (id, label, vector)."""
    good = [(i, lab, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, lab, v in dict.fromkeys((i, lab, tuple(v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v))]
    out = []
    for a, lab, c in good:
        if is_anchor(a):
            scored = sorted((-int(c @ x), i, other) for i, other, x in good if len(x) == len(c))
            for p, i, _ in [s for s in scored if s[2] == lab and s[1] != a][:positives]:
                some = [s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
                out += [(a, i, k + 1, j, -p, -n) for k, (n, j, _) in enumerate(some)]
    return sorted(out)


def spelling(docs, shortest=5, least=3):
    """(word, form, root, n, n_near, form_n) from rows (id, text)."""
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, count = {}, {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        count[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n.get(form[w])))
    return sorted(out, key=str)
