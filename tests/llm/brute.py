"""Plain Python versions of the operators, for tests."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def line_dedup(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc_id is not None:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or doc_id == max(holders[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def exact_dedup(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for doc_id, text in rows:
        groups[norm(text)].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        g = groups[norm(text)]
        best = min(g)
        keep = None if best[1] else best[2]
        out.append((doc_id, keep, len(g), doc_id == keep, sha(norm(text))))
    return out


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    names = ("assign", "access", "hex")
    return [(names[k], a, b) for a, k, b in sorted(out)]


def all_spans(text, reach=300):
    """Base spans and linked weak ones, by looking at all parts of the text."""
    text = text or ""
    base = base_spans(text)
    weak = [("opaque", "secret", m) for m in re.finditer(r"[A-Za-z0-9+/]+", text) if len(m[0]) >= 20 and all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    weak += [("account", "identifier", m) for m in re.finditer(r"""(?:[cC][lL][iI][eE][nN][tT]|[uU][sS][eE][rR]|[aA][cC][cC][oO][uU][nN][tT]|[kK][eE][yY])_?(?:[iI][dD]|[nN][aA][mM][eE])["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", text) if len(m[1]) >= 3]
    weak += [("endpoint", "endpoint", m) for m in re.finditer(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", text) if len(m[0]) >= 10]
    weak = [(k, c, m.start(), m.end()) for k, c, m in weak if not any(a < m.end() and m.start() < b for _, a, b in base)]
    cls = {"assign": "secret", "hex": "secret", "access": "identifier"}
    parts = [(k, cls[k], a, b) for k, a, b in base] + weak
    names = ("assign", "access", "hex", "opaque", "account", "endpoint")

    def near(p, want):
        return any(q is not p and q[1] == want and (q[2], names.index(q[0])) != (p[2], names.index(p[0])) and ((q[2], names.index(q[0])) < (p[2], names.index(p[0])) and p[2] - q[3] <= reach or (q[2], names.index(q[0])) > (p[2], names.index(p[0])) and q[2] - p[3] <= reach) for q in parts)

    out = list(base)
    for p in weak:
        ok = near(p, "identifier") if p[1] == "secret" else near(p, "secret") if p[1] == "identifier" else near(p, "identifier") and near(p, "secret")
        if ok:
            out.append((p[0], p[2], p[3]))
    return sorted(out, key=lambda s: (s[1], names.index(s[0])))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows, threshold=0.8):
    """doc_id -> (class, links to other sets, copies); rows must have distinct doc_id."""
    sets = {d: shingle_set(t) for d, t in rows}
    distinct = [s for s in set(sets.values()) if s]
    index = defaultdict(set)
    for i, s in enumerate(distinct):
        for x in s:
            index[x].add(i)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = Counter()
    for i, s in enumerate(distinct):
        shared = Counter(j for x in s for j in index[x] if j > i)
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(distinct[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    place = {s: i for i, s in enumerate(distinct)}
    least, copies = {}, Counter(s for s in sets.values() if s)
    for d, s in sets.items():
        if s:
            r = root(place[s])
            least[r] = min(d, least.get(r, d))
    return {d: (least[root(place[s])], links[place[s]], copies[s]) if s else (d, 0, 1) for d, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), limit=3):
    """source -> target by resharing again and again; sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, rest, capped = {}, sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        total = rest - sum(limit * sizes[s] for s in capped)
        out = {s: limit * sizes[s] if s in capped else total * w[s] / sum(w[x] for x in open_) for s in order}
        over = {s for s in open_ if out[s] > limit * sizes[s]}
        if not over:
            return out
        capped |= over


def sainte_lague(votes, seats):
    """Seats one at a time; votes: list in order of preference for ties."""
    got = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def pack_sizes(sizes, lengths, overhead):
    """Bins as lists of places in ``sizes`` (descending), and their final lengths, by looking at every bin and waiting part."""
    bins, when = [], []

    def held(length, at):
        """Words of a bin of this length opened for ``sizes[at]`` and filled with what fits of the rest."""
        room = length - sizes[at]
        for n in sizes[at + 1 :]:
            room -= n if n <= room else 0
        return length - room

    for at, size in enumerate(sizes):
        fits = [(c - sum(sizes[i] for i in held_), -when[b], b) for b, (c, held_) in enumerate(bins) if c - sum(sizes[i] for i in held_) >= size]
        if fits:
            b = min(fits)[2]
            bins[b][1].append(at)
            when[b] = at
        else:
            bins.append((min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / held(c, at), c)), [at]))
            when.append(at)
    return [h for _, h in bins], [min(c for c in lengths if c >= sum(sizes[i] for i in h)) for _, h in bins]


def mix(words, shards, begins, unit, quotas, passes_of):
    """Words taken of each document, block by block.

    ``words``: source -> shard -> [(doc, size)] in order; ``begins``: (source,
    shard) -> hash; ``quotas``: source -> blocks. Returns doc -> words taken.
    """
    taken = Counter()
    for source, by_shard in words.items():
        stream, shard_of = [], []
        for shard in shards[source]:
            for doc, size in by_shard[shard]:
                stream += [doc] * size
                shard_of += [shard] * size
        blocks = [(shard_of[i], stream[i : i + unit]) for i in range(0, len(stream), unit)]
        passes, rest = divmod(quotas[source], len(blocks))
        assert passes == passes_of[source]
        for doc in stream:
            taken[doc] += passes
        own = [[b for s, b in blocks if s == shard] for shard in shards[source]]
        for shard, mine, n in zip(shards[source], own, sainte_lague([len(x) for x in own], rest), strict=True):
            for k in range(n):
                taken.update(mine[(begins[source, shard] + k) % len(mine)])
    return taken


def cutoffs(rows, rules, risk=0.05, delta=0.05, cost=20):
    """(stratum, rule) -> certified cutoff; rows: (stratum, good, metrics by rule) of labelled documents past the base."""
    out, strata = {}, {s for s, good, _ in rows}
    for s in strata:
        good = [m for x, g, m in rows if x == s and g]
        bad = [m for x, g, m in rows if x == s and not g]
        for rule, _, grid in rules:
            best = None
            for cut in grid:
                g, b = (sum(m[rule] > cut for m in part) for part in (good, bad))
                p, n = Fraction(risk) / len(rules), len(good)
                tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(g + 1)) if g <= n * p else 1
                if tail * len(strata) > Fraction(delta) / len(rules):
                    break
                if b - cost * g > (best[0] if best else 0):
                    best = (b - cost * g, cut)
            if best:
                out[s, rule] = best[1]
    return out
