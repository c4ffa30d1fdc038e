"""Plain versions of the operators, for small inputs."""

import hashlib


def order_key(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def repeated_mask(seqs, length):
    """seqs: {key: sequence} with sortable keys; a mask of positions covered by a window that starts earlier."""
    seen, masks = set(), {}
    for key in sorted(seqs):
        s = seqs[key]
        mask = [False] * len(s)
        for p in range(len(s) - length + 1):
            w = tuple(s[p:p + length])
            if w in seen:
                mask[p:p + length] = [True] * length
            seen.add(w)
        masks[key] = mask
    return masks


def suffix_rows(rows, length=100):
    keys = sorted({(order_key(i), t or "") for i, t in rows})
    masks = repeated_mask({k: (k[1]).encode() for k in keys}, length)
    out = []
    for i, t in rows:
        b, m = (t or "").encode(), masks[(order_key(i), t or "")]
        spans = sum(1 for p, x in enumerate(m) if x and (p == 0 or not m[p - 1]))
        kept = bytes(c for c, x in zip(b, m) if not x)
        out.append((i, len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return out


def split_words(text):
    return (text or "").encode().split()


def fm_rows(rows, length=20):
    keys = sorted({(order_key(i), t or "") for i, t in rows})
    masks = repeated_mask({k: split_words(k[1]) for k in keys}, length)
    out = []
    for i, t in rows:
        w, m = split_words(t), masks[(order_key(i), t or "")]
        out.append((i, len(w), sum(m), hashlib.sha256(b" ".join(x for x, g in zip(w, m) if not g)).hexdigest()))
    return out


def fingerprint(text, size=3):
    import xxhash
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = low.split()
    grams = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, near):
    """Least value reachable from each over ``near`` pairs."""
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for a in values:
        for b in values:
            if a < b and near(a, b):
                ra, rb = find(a), find(b)
                label[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in values}
