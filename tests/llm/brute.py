"""Plain Python versions of the contracts, written from their wording."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def pii(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    found.sort()
    n = Counter(k for *_, k in found)
    base = [f"{k}:{s}:{e}" for s, _, e, k in found]
    return [n["email"], n["ip"], n["card"], n["phone"], sha(",".join(base))], base


def licenses(text):
    words = ALNUM.findall(lower(text))
    starts, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return [len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))]


def contamination(docs, benchmark):
    items = {i: ALNUM.findall(lower(t)) for i, t in benchmark}
    windows = defaultdict(set)
    for i, w in items.items():
        if w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(i)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        words = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                got = windows.get(tuple(words[k : k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        out[doc] = [len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)]
    return out


def shingles(text):
    words = SPACED.findall(lower(text)) if text is not None else []
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {tuple(words)} if words else set()


def near_duplicates(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if 100 * len(sets[a]) < 80 * len(sets[b]):
                break
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: [len(sets[d]), find(d), find(d) == d] for d in sets}


def quality(text):
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(words)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n]


def repeats(docs, size=400):
    seen = defaultdict(list)
    data = [(d, (t or "").encode()) for d, t in docs]
    for k, (_, b) in enumerate(data):
        for i in range(len(b) - size + 1):
            seen[hash(b[i : i + size])].append((k, i))
    mark = [bytearray(len(b)) for _, b in data]
    for v in seen.values():
        if len(v) > 1:
            same = defaultdict(list)
            for k, i in v:
                same[data[k][1][i : i + size]].append((k, i))
            for w in same.values():
                if len(w) > 1:
                    for k, i in w:
                        mark[k][i : i + size] = b"\1" * size
    out = []
    for (d, b), m in zip(data, mark, strict=True):
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        spans = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((d, len(b), sum(m), spans, sha(kept)))
    return sorted(out, key=str)


def passages(docs, size=51):
    where = defaultdict(set)
    split = [(d, SPACED.findall(t or "")) for d, t in docs]
    for k, (_, w) in enumerate(split):
        for i in range(len(w) - size + 1):
            where[tuple(w[i : i + size])].add(k)
    out = []
    for d, w in split:
        mark = [False] * len(w)
        for i in range(len(w) - size + 1):
            if len(where[tuple(w[i : i + size])]) > 1:
                mark[i : i + size] = [True] * size
        out.append((d, len(w), sum(mark), sum(1 for i in range(len(w)) if mark[i] and (i == 0 or not mark[i - 1]))))
    return sorted(out)


def mix_targets(docs):
    sizes = defaultdict(int)
    for source, text in docs:
        sizes[source] += len(SPACED.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = budget - sum(target.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return sizes, target


def store_rows(docs, tokenizer, end_id):
    at, out = 0, {}
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out[doc] = [at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))]
        at += len(ids)
    return out


def bpe_ranks(path):
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def bpe_count(text, ranks, pattern, known):
    """Tokens of a text: pieces by the pattern, their bytes merged pair by pair, lowest rank first."""
    import regex

    total = 0
    for piece in regex.findall(pattern, text or ""):
        if piece not in known:
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known[piece] = len(parts)
        total += known[piece]
    return total
