"""Plain versions of the operators, a document at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def contamination(docs, items, window=13):
    """docs, items: lists of (id, text). Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    index = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOW))
        k = min(window, len(w))
        for p in range(len(w) - k + 1) if k else ():
            index[tuple(w[p : p + k])].add(str(i))
    out = []
    for d, t in docs:
        w = ITEM_WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for k in {len(x) for x in index}:
            for p in range(len(w) - k + 1):
                if (own := index.get(tuple(w[p : p + k]))) is not None:
                    hit.update(range(p, p + k))
                    found |= own
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def near(docs, shingle=3, percent=85):
    """docs: (id, text). Per document: n_shingles, component_id, kept."""
    sets = []
    for _, t in docs:
        w = SPACE_WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter()
        for x in s:
            shared.update(post[x])
            post[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(docs)]


def crc(text):
    return zlib.crc32((text or "").encode())
