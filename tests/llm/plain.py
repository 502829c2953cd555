"""Plain, slow versions of the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def secret_spans(text):
    rules = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16))
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(rules) for m in p.finditer(text) if len(m[g]) >= least]
    return [(rules[k][0], a, b) for a, k, b in sorted(found)]


def kept_words(docs, words=20):
    """docs: (doc_id, text) with different ids; a list of (doc_id, n_words, n_removed, kept)."""
    seen, out = set(), []
    for doc, text in sorted(docs):
        w = text.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            g = tuple(w[i:i + words])
            if g in seen:
                gone[i:i + words] = [True] * words
            seen.add(g)
        out.append((doc, len(w), sum(gone), b" ".join(x for x, y in zip(w, gone) if not y).decode()))
    return out


def fingerprint(text, width=4):
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def near_groups(docs, most=4):
    """{doc_id: (fingerprint, smallest doc_id reachable)}"""
    prints = {d: fingerprint(t) for d, t in docs}
    ids, above = sorted(prints), {d: d for d in prints}

    def root(d):
        while above[d] != d:
            d = above[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {d: (prints[d], root(d)) for d in ids}


def learns(doc_id, n=10):
    return zlib.crc32(str(doc_id).encode()) % n != 0


def base_scores(docs, n=10):
    counts = Counter()
    for d, t in docs:
        if learns(d, n):
            counts.update(t.encode().lower().split() + [b""])
    total, norm = sum(counts.values()), math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    out = {}
    for d, t in docs:
        w = t.encode().lower().split() + [b""]
        out[d] = (not learns(d, n), len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10(counts[x] + 0.1) - norm for x in w))
    return out


def ppm_scores(docs, scored, order, n=10):
    tries = [defaultdict(Counter) for _ in range(order + 1)]
    for d, t in docs:
        if learns(d, n):
            raw = t.encode().lower() + b"\xff"
            for i in range(len(raw)):
                for j in range(min(i, order) + 1):
                    tries[j][raw[i - j:i]][raw[i]] += 1

    def score(text):
        raw, log = text.encode().lower() + b"\xff", 0.0
        for i in range(len(raw)):
            out: set[int] = set()
            for j in range(min(i, order), -1, -1):
                known = tries[j].get(raw[i - j:i])
                if not known:
                    continue
                left = {s: c for s, c in known.items() if s not in out}
                weight = sum(left.values()) + len(left)
                if raw[i] in left:
                    log += math.log10(left[raw[i]] / weight)
                    break
                if weight:
                    log += math.log10(len(left) / weight)
                out |= set(known)
            else:
                log -= math.log10(256 - len(tries[0][b""]))
        return log

    return {d: score(t) for d, t in scored}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rule_counts(text):
    w = text.encode().split()
    lines, again, seen = text.split("\n"), 0, set()
    for line in lines:
        if line.encode().split():
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), again, len(repeated)


def draws(docs, target, percent=10, least=20, buckets=10_000, seed=2024):
    """docs: (doc_id, text); rows (doc_id, n_features, weight, score, rank), ranked rows first."""
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
    hashed = lambda t: [zlib.crc32(w) % buckets for w in words(t)]
    s, t = Counter(b for _, x in docs for b in hashed(x)), Counter(b for x in target for b in hashed(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    rows = []
    for d, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, hashed(x)))
        rows.append((d, len(words(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    return [(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < least]


def divergences(docs, least=10, top=10):
    """docs: (lang, source, text); the rows of the audit."""
    found = defaultdict(lambda: defaultdict(Counter))
    documents = defaultdict(Counter)
    for lang, source, text in docs:
        terms = [x.decode() for x in re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())]
        found[lang][source].update(terms)
        documents[lang].update(set(terms))
    out = set()
    for lang, sources in found.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: shares(c) for s, c in sources.items()}
        q = shares(sum(sources.values(), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if sources[s][t] and p[s][t] > q[t]]
            ranked = lambda rows: enumerate(sorted(rows, key=lambda r: (-r[1], r[0].encode())), 1)
            out |= {(lang, s, "pair", o, x, k) for k, (o, x) in ranked(pairs)}
            out |= {(lang, s, "term", t, x, k) for k, (t, x) in ranked(terms) if k <= top}
    return out
