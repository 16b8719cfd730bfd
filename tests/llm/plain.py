"""Plain versions of the operators, one document at a time."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SECRET = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def secrets(text):
    """(n_assign, n_access, n_hex, digest of the base spans)."""
    spans = []
    for i, (kind, p) in enumerate(SECRET.items()):
        for m in p.finditer(text or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                spans.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    n = [sum(s[1] == i for s in spans) for i in range(3)]
    return *n, sha(",".join(s[2] for s in sorted(spans)))


def tokens(rows, tokenizer):
    """[(doc_id, start, n_tokens, crc)] of (doc_id, text) in order."""
    out, start = [], 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def removed_lines(rows, least=5):
    """{doc_id: numbers of the lines with an earlier line of Jaccard similarity 4/5 or more}."""
    out, seen = {}, []
    for doc, text in sorted(rows):
        out[doc] = []
        for i, line in enumerate((text or "").split("\n")):
            words = SPACE.findall(line)
            if len(words) >= least:
                w = frozenset(words)
                if any(5 * len(w & s) >= 4 * len(w | s) for s in seen):
                    out[doc].append(i)
                seen.append(w)
    return out


def benchmark_hits(text, items, n=10):
    """(n_words, n_hit, n_items, digest of the items, contaminated)."""
    w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        x = ALNUM.findall((t or "").translate(LOWER))
        for i in range(max(len(x) - n + 1, min(len(x), 1))):
            g = x[i:i + n]
            for j in range(len(w) - len(g) + 1):
                if w[j:j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def fingerprint(text):
    w = SPACE.findall((text or "").translate(LOWER))
    s = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, bits=3):
    """Least reachable id of each row."""
    least = list(ids)
    while True:
        new = [min(m for m, q in zip(least, prints) if (p ^ q).bit_count() <= bits) for p in prints]
        if new == least:
            return least
        least = new


def licences(text):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    w, at, labels = ALNUM.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = text or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    grams, covered = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 3))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def runs(words):
    """All runs of a row of words: every stretch that keeps a period, unless a divisor of the period keeps it too."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(q % p == 0 and s <= i and s + m >= j + q for s, m, p in out):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(words):
    found = runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    return (len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, text):
    words = SPACE.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def copies(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(bare(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for b, members in groups.items():
        members.sort(key=lambda m: m[:3])
        out += [(m[3], members[0][3], len(members), i == 0, sha(b)) for i, m in enumerate(members)]
    return out


def conversations(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            k = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            out.setdefault(c, []).append((turn is not None, turn or 0, k, role, text))
    return {c: [t[3:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def trie(convs):
    """Rows of all nodes: every prefix of every conversation."""
    members, ends = {}, {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
        ends.setdefault(tuple(convs[c]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, rows = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[x] for x in kids.get(p, [])) or 1
        saved[p] = own + sum(saved[x] for x in kids.get(p, []))
        rows.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids.get(p, [])), leaves[p], saved[p],
                     sha(",".join(map(str, ends.get(p, []))))))
    return rows
