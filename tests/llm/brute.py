"""Plain versions of what the text operators compute, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    """(start, rank, end, kind) of the patterns' spans."""
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    found.sort()
    return found, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in found).encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def components(sets):
    """The least id reachable from each by links of similarity 0.8 or more."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = collections.Counter((a, b) for v in where.values() for k, a in enumerate(v) for b in v[k + 1 :])
    for (a, b), o in both.items():
        if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def repeated(texts, n=50):
    """The word positions of each text that repeats of n words cover."""
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    count = collections.Counter(tuple(w[k : k + n]) for w in words.values() for k in range(len(w) - n + 1))
    out = {i: {p for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for p in range(k, k + n)} for i, w in words.items()}
    return {i: v for i, v in out.items() if v}


def without_boilerplate(rows, ratio=0.1, least=3):
    """id -> text of rows (id, site, text) without the lines that more than ratio, and at least so many, of a site's rows have."""
    rows = [(i, site or "", text) for i, site, text in rows]
    total, seen = collections.Counter(site for _, site, _ in rows), collections.Counter()
    for _, site, text in rows:
        seen.update({(site, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    return {i: text and "\n".join(x for x in text.split("\n") if (site, x.strip(" ")) not in bad) for i, site, text in rows}
